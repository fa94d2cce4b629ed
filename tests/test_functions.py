import math

import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import scoring as S
from trackloom.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "angle, name",
    [(0, "left_to_right"), (22.4, "left_to_right"), (22.6, "bottom_left_to_top_right"), (90, "bottom_to_top"), (135, "bottom_right_to_top_left"), (157.6, "right_to_left"), (-157.6, "right_to_left"), (-150, "top_right_to_bottom_left"), (-90, "top_to_bottom"), (-45, "top_left_to_bottom_right"), (-22.6, "top_left_to_bottom_right")],
)
def test_direction(spark, angle, name):
    a = math.radians(angle)
    assert value(spark, G.direction(F.lit(100 * math.cos(a)), F.lit(-100 * math.sin(a)), 1000.0)) == name


def test_small_moves_are_none(spark):
    assert value(spark, G.direction(F.lit(14.9), F.lit(0.0), 1000.0)) == "stationary"
    assert value(spark, G.direction(F.lit(15.1), F.lit(0.0), 1000.0)) == "left_to_right"


@pytest.mark.parametrize("net, path, state", [(0.014, 0.024, "stationary"), (0.014, 0.025, "slow_moving"), (0.015, 0.02, "slow_moving"), (0.2, 0.06, "moving")])
def test_motion_state(spark, net, path, state):
    assert value(spark, G.motion_state(F.lit(net), F.lit(path))) == state


def test_iou(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert value(spark, G.iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert value(spark, G.iou(box(0, 0, 10, 10), box(20, 20, 30, 30))) == 0
    assert value(spark, G.iou(box(5, 5, 5, 5), box(5, 5, 5, 5))) == 0


@pytest.mark.parametrize("seconds, short, long", [(0.0, "00:00.000", "00:00:00.000"), (59.9996, "01:00.000", "00:01:00.000"), (3661.5, "01:01:01.500", "01:01:01.500"), (None, "00:00.000", None), (-1.0, "00:00.000", None)])
def test_clock(spark, seconds, short, long):
    s = F.lit(seconds).cast("double")
    assert value(spark, T.clock(s)) == short and value(spark, T.clock(s, True)) == long


@pytest.mark.parametrize("h, s, v, name", [(0, 200, 40, "black"), (0, 10, 200, "white"), (0, 10, 100, "gray"), (0, 10, 60, "black"), (0, 60, 210, "white"), (0, 60, 100, "gray"), (5, 60, 70, "red"), (172, 200, 200, "red"), (15, 200, 200, "orange"), (30, 200, 200, "yellow"), (60, 200, 200, "green"), (100, 200, 200, "blue"), (140, 200, 200, "purple"), (165, 200, 200, "pink")])
def test_hsv(spark, h, s, v, name):
    assert value(spark, T.hsv_color(F.lit(h), F.lit(s), F.lit(v))) == name


def test_loose_values(spark):
    assert value(spark, T.safe_double(F.lit("abc"), 0.5)) == 0.5
    assert value(spark, T.safe_double(F.lit("NaN"), 0.0)) == 0.0
    assert value(spark, T.csv_ids(F.lit("1, x,3,"))) == [1, 3]
    assert value(spark, T.slug(F.lit("  My Video-File (1).mp4 "))) == "my_video_file_1mp4"
    assert value(spark, T.slug(F.lit("!!!"))) == "video"
    assert value(spark, T.normalize(F.lit(" Left_to-Right  now"))) == "left to right now"
    assert value(spark, T.voice_language(F.lit("a Blue shirt"))) == "en"


def test_quality_thresholds(spark):
    assert [value(spark, S.quality_label(F.lit(x))) for x in (0.8, 0.79, 0.6, 0.59)] == ["high", "medium", "medium", "low"]
    assert [value(spark, S.reliability_status(F.lit(x))) for x in (0.65, 0.64, 0.4, 0.39)] == ["reliable", "review", "review", "reject"]
    assert value(spark, S.similarity(F.lit(2.5))) == -1.0


def test_sql_functions_are_the_column_functions(spark):
    from pyspark.sql import functions as F

    from trackloom.functions import geometry, scoring, sql
    from trackloom.operators import sampling

    assert len(sql.register(spark)) == len(sql.FUNCTIONS)
    df = spark.range(0, 300).selectExpr("id / 100.0D AS v", "(id % 7) * 1.0D AS a", "(id % 5) * 2.0D AS b")
    box = lambda x: (F.col(x), F.col(x), F.col(x) + 3, F.col(x) + 2)
    rows = df.select(
        F.expr("trackloom_similarity(v)"), scoring.similarity(F.col("v")), F.expr("trackloom_quality_label(v)"), scoring.quality_label(F.col("v")),
        F.expr("trackloom_reliability_status(v)"), scoring.reliability_status(F.col("v")), F.expr("trackloom_motion_level(v * 10)"), sampling.level(F.col("v") * 10),
        F.expr("trackloom_iou(a, a, a + 3, a + 2, b, b, b + 3, b + 2)"), geometry.iou(box("a"), box("b")),
    ).collect()
    assert all(r[k] == r[k + 1] for r in rows for k in range(0, 10, 2))


def test_saved_results(spark, tmp_path):
    import json

    from trackloom.sources import sinks

    sinks.save_result(spark, {"query": "q", "results": [{"rank": 1}]}, str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first().value)["results"] == [{"rank": 1}]
