"""Joins on keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cuelark.llm.storage import local_table

#: A key is hot beyond one part in HOT_PARTS of the rows, and HOT_LEAST rows.
HOT_PARTS, HOT_LEAST = 1000, 256


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` (inner or left) with the rows of hot keys dealt over several tasks.

    A hot key has as many salts as it has parts of the rows; its ``right`` rows are
    repeated for each. All salts together are HOT_PARTS at most, so what is repeated
    and what is broadcast (the list of hot keys) has a bound. ``left`` is read more
    than once: it or ``counts(<on>, _c)``, the rows of each key, should be
    materialised; ``rows`` is their sum where it is known. Null keys meet nothing.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_c")) if counts is None else counts
    limit = max(HOT_LEAST, (left.count() if rows is None else rows) // HOT_PARTS)
    hot = [r for r in counts.where(F.col("_c") > limit).select(*on, F.ceil(F.col("_c") / limit).cast("int").alias("_salts")).collect() if None not in r]
    if not hot:
        return left.join(right, on, how)
    schema = StructType([*(left.schema[c] for c in on), StructField("_salts", IntegerType())])
    marks = F.broadcast(local_table(left.sparkSession, hot, schema))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(marks, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("_salts")
    copies = right.join(marks, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")
