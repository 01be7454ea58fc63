"""Joins that hold when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt into.
SALTS = 16


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: Column) -> DataFrame:
    """rows left-joined to one row for each key in groups. A hot key's rows are dealt out by
    a hash of spread, and each group is there once for each part; so groups should hold
    only the keys that need a join, such as those with more than one row."""
    parts = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    every = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", parts).join(every, [key, "_salt"], "left").drop("_salt")
