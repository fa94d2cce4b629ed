"""Column functions on boxes, points and regions of a frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def distance(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
    dx, dy = xb - xa, yb - ya
    return F.sqrt(dx * dx + dy * dy)


def diagonal(width: float, height: float) -> float:
    return (width * width + height * height) ** 0.5


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); without a union 0."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: F.greatest(zero, r[2] - r[0]) * F.greatest(zero, r[3] - r[1])
    union = area(a) + area(b) - inter
    return F.when(union <= 0, zero).otherwise(F.try_divide(inter, union))


def third(place: Column, size: float, names: tuple[str, str, str]) -> Column:
    """Which third of the frame a coordinate is in."""
    share = place / size
    return F.when(share < 1 / 3, names[0]).when(share < 2 / 3, names[1]).otherwise(names[2])


def horizontal(x: Column, width: float) -> Column:
    return third(x, width, ("left", "center", "right"))


def vertical(y: Column, height: float) -> Column:
    return third(y, height, ("top", "middle", "bottom"))


def region(x: Column, y: Column, width: float, height: float) -> Column:
    h, v = horizontal(x, width), vertical(y, height)
    return F.struct(h.alias("horizontal"), v.alias("vertical"), F.concat_ws("_", h, v).alias("combined"), F.round(x / width, 4).alias("normalized_x"), F.round(y / height, 4).alias("normalized_y"))


def transition(start: Column, end: Column, stay: str = "remained_in_") -> Column:
    return F.when(start == end, F.concat(F.lit(stay), start)).otherwise(F.concat(start, F.lit("_to_"), end))


def readable(region_name: Column) -> Column:
    return F.translate(region_name, "_", " ")


def spatial_sentence(class_name: Column, state: Column, start: Column, end: Column) -> Column:
    a, b = readable(start), readable(end)
    return (
        F.when((start == end) & (state == "stationary"), F.concat(class_name, F.lit(" remained stationary in the "), a, F.lit(" region")))
        .when(start == end, F.concat(class_name, F.lit(" remained within the "), a, F.lit(" region")))
        .otherwise(F.concat(class_name, F.lit(" moved from the "), a, F.lit(" region to the "), b, F.lit(" region")))
    )


#: The sectors of 45 degrees, from -157.5 on; what is beyond both ends goes to the left.
SECTORS = ["top_right_to_bottom_left", "top_to_bottom", "top_left_to_bottom_right", "left_to_right", "bottom_left_to_top_right", "bottom_to_top", "bottom_right_to_top_left"]
STILL, STILL_PATH, SLOW_PATH = 0.015, 0.025, 0.06


def direction(dx: Column, dy: Column, diag: float) -> Column:
    """The name of a displacement's direction; y grows downwards."""
    angle = F.degrees(F.atan2(-dy, dx))
    sector = F.floor((angle + 157.5) / 45).cast("int")
    named = F.when((angle < -157.5) | (angle >= 157.5), "right_to_left").otherwise(F.element_at(F.array(*map(F.lit, SECTORS)), F.least(F.greatest(sector, F.lit(0)), F.lit(6)) + 1))
    return F.when(F.sqrt(dx * dx + dy * dy) / diag < STILL, "stationary").otherwise(named)


def motion_state(displacement: Column, path: Column) -> Column:
    """From the displacement and the length of the path, both by the frame's diagonal."""
    return F.when((displacement < STILL) & (path < STILL_PATH), "stationary").when(path < SLOW_PATH, "slow_moving").otherwise("moving")


def crop(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """The box in whole pixels (cut towards zero) within the frame."""
    whole = lambda c: c.cast("int")
    return F.greatest(F.lit(0), whole(x1)), F.greatest(F.lit(0), whole(y1)), F.least(F.lit(width), whole(x2)), F.least(F.lit(height), whole(y2))
