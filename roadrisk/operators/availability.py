"""Presence of fields in documents and tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_path_exists(text, path: str) -> Column:
    """Does a raw JSON text have the dotted path? A JSON null counts as present; ``[]`` after a
    name descends into an array, where one element suffices."""
    steps = path.split(".")

    def found(doc: Column, left) -> Column:
        name, array = left[0].removesuffix("[]"), left[0].endswith("[]")
        here = F.coalesce(F.array_contains(F.json_object_keys(doc), name), F.lit(False))
        if len(left) == 1 and not array:
            return here
        value = F.get_json_object(doc, f"$.{name}")
        if array:
            items = F.from_json(value, "array<string>")
            if len(left) == 1:
                return here & F.coalesce(F.size(items) > 0, F.lit(False))
            return here & F.coalesce(F.exists(items, lambda x: found(x, left[1:])), F.lit(False))
        return here & found(value, left[1:])

    return found(F.col(text) if isinstance(text, str) else text, steps)


def field_availability(df: DataFrame, fields, unit="trip_id", split="split") -> DataFrame:
    """Trips per split in which a field has any value: one row per field."""
    has = df.groupBy(unit, split).agg(*[(F.count(f) > 0).alias(f) for f in fields])
    long = has.unpivot([split], list(fields), "field", "present")
    return long.groupBy("field").agg(
        F.count_if(F.col("present") & (F.col(split) == "practice")).alias("practice"),
        F.count_if(F.col("present") & (F.col(split) == "scored")).alias("scored"))
