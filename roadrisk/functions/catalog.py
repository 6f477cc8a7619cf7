"""SQL names for the library's functions."""
from pyspark.sql import SparkSession

# SQL functions stay visible to Catalyst; only the robust slope is a (vectorised) Python function
_SQL = {
    "ttc_band": ("ttc DOUBLE", "STRING", """CASE WHEN isnan(ttc) OR ttc >= 3 THEN 'SAFE' WHEN ttc >= 2 THEN 'WARNING'
      WHEN ttc >= 1.5 THEN 'DANGER' ELSE 'CRITICAL' END"""),
    "inverse_ttc": ("ttc DOUBLE", "DOUBLE", "CASE WHEN isnan(ttc) OR abs(ttc) = double('inf') THEN 0D ELSE 1 / greatest(0.1D, ttc) END"),
    "parse_ttc": ("text STRING", "DOUBLE", """CASE WHEN lower(trim(text)) IN ('inf', '+inf', 'infinity', '+infinity') THEN double('inf')
      WHEN try_cast(trim(text) AS DOUBLE) >= 0 AND try_cast(trim(text) AS DOUBLE) < double('inf') THEN try_cast(trim(text) AS DOUBLE) END"""),
    "bbox_iou": (
        "a STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>, b STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>", "DOUBLE",
        """coalesce(try_divide(
      greatest(0D, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0D, least(a.y1, b.y1) - greatest(a.y0, b.y0)),
      (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)
      - greatest(0D, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0D, least(a.y1, b.y1) - greatest(a.y0, b.y0))), 0D)"""),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make ttc_band, inverse_ttc, parse_ttc, bbox_iou and theil_sen(times, values) callable in SQL."""
    from roadrisk.operators.motion import _theil_sen

    for name, (args, result, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    spark.udf.register("theil_sen", _theil_sen)
    return [*_SQL, "theil_sen"]
