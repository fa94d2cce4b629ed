"""Column functions for scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions import vocabulary as V


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ladder(x: Column, steps: list[tuple], otherwise, at_least: bool = True) -> Column:
    """The value of the first step that x reaches (or stays below)."""
    out = None
    for bound, value in steps:
        test = x >= bound if at_least else x < bound
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))


def points(*pairs: tuple[Column, float]) -> Column:
    """The sum of the values whose condition holds."""
    out = F.lit(0.0)
    for test, value in pairs:
        out = out + F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    return out


def size_score(area: Column, frame_area: float) -> Column:
    return F.least(area / (0.20 * max(frame_area, 1.0)), F.lit(1.0))


def center_score(x: Column, y: Column, width: float, height: float) -> Column:
    hw, hh = max(width / 2, 1.0), max(height / 2, 1.0)
    dx, dy = (x - width / 2) / hw, (y - height / 2) / hh
    return 1 - F.least(F.sqrt(dx * dx + dy * dy), F.lit(1.0))


def sharpness_score(variance: Column) -> Column:
    """From the variance of the Laplacian; without pixels 0."""
    return F.coalesce(F.least(variance / 1000, F.lit(1.0)), F.lit(0.0))


def crop_score(confidence: Column, sharpness: Column, size: Column, middle: Column, weights=(0.40, 0.25, 0.20, 0.15)) -> Column:
    return weights[0] * confidence + weights[1] * sharpness + weights[2] * size + weights[3] * middle


def persistence(observations: Column, class_name: Column) -> Column:
    target = F.when(class_name.isin(V.VEHICLE), 8.0).when(class_name.isin(V.BICYCLE), 6.0).otherwise(5.0)
    return clamp(observations / target)


def penalty(class_name: Column, observations: Column, crops: Column) -> tuple[Column, list[tuple[Column, str]]]:
    tests = [
        (class_name.isin(V.BICYCLE) & (observations < 4), 0.20, "short_bicycle_track"),
        (class_name.isin(V.VEHICLE) & (observations <= 2), 0.18, "very_short_vehicle_track"),
        ((class_name == "people") & (observations <= 2), 0.15, "short_group_track"),
        (crops == 1, 0.08, "single_representative_crop"),
    ]
    return points(*[(t, v) for t, v, _ in tests]), [(t, n) for t, _, n in tests]


def reliability_status(score: Column) -> Column:
    return ladder(score, [(0.65, "reliable"), (0.40, "review")], "reject")


def quality_label(score: Column) -> Column:
    return ladder(score, [(0.80, "high"), (0.60, "medium")], "low")


def similarity(distance: Column) -> Column:
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)), 4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(vector: Column) -> Column:
    """The vector by its length; one without length stays."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: (x / length).cast("float"))).otherwise(vector)
