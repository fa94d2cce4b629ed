"""The scalar functions of the engine for use in SQL text: temporary functions of the session,
expanded into the plan like the column functions of the same names."""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFIX = "trackloom_"
#: name -> (parameters, type, body)
FUNCTIONS = {
    "similarity": ("distance DOUBLE", "DOUBLE", "round(greatest(-1.0D, least(1.0D, 1 - distance)), 4)"),
    "quality_label": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.80D THEN 'high' WHEN score >= 0.60D THEN 'medium' ELSE 'low' END"),
    "reliability_status": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.65D THEN 'reliable' WHEN score >= 0.40D THEN 'review' ELSE 'reject' END"),
    "motion_level": ("score DOUBLE", "STRING", "CASE WHEN score < 2 THEN 'low' WHEN score < 12 THEN 'medium' ELSE 'high' END"),
    "iou": (
        "ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE", "DOUBLE",
        "coalesce(try_divide(greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1)), "
        "(ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1))), 0D)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [PREFIX + name for name in FUNCTIONS]
