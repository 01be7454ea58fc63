"""Small helpers that all operators here use; intermediate tables go to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.batches import SLICE_BYTES, SLICE_ROWS, slices  # noqa: F401
from quernstone.operators.store import Work

#: Copies that a row of a small table gets, so that a hot key's rows spread over as many tasks.
SALTS = 16
#: Ids are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_IDS = 400_000

def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it has few rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without_dropped(docs: DataFrame, id_col: str, verdicts: DataFrame, mark, work: Work) -> DataFrame:
    """The rows of docs that verdicts (doc_id, kept, mark) don't drop.

    Ids whose rows all go are a narrow table, broadcast while it is small, so texts stay
    where they are. Where rows that share an id fare differently, mark tells them apart:
    mark(docs, name) adds a row's own mark as a column of that name; null ids count as one.
    """
    verdicts = work.table(verdicts.select("doc_id", "kept", "mark"), "verdicts")
    fates = verdicts.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("all")).where("not all")
    gone, own = unused(docs, "_dropped"), unused(docs, "_mark")
    fates = work.table(fates.select(F.col("doc_id").alias(gone), "some"), "fates")
    whole, split = fates.where("not some").select(gone), fates.where("some").select(gone)
    out = docs.join(broadcast_if_small(whole), F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
    if split.isEmpty():
        return out
    pairs = verdicts.where("not kept").join(split, F.col("doc_id").eqNullSafe(F.col(gone)), "left_semi")
    pairs = work.table(pairs.select(F.col("doc_id").alias(gone), F.col("mark").alias(own + "_")).distinct(), "pairs")
    same = F.col(id_col).eqNullSafe(F.col(gone)) & F.col(own).eqNullSafe(F.col(own + "_"))
    return mark(out, own).join(broadcast_if_small(pairs), same, "left_anti").select(*docs.columns)


def salt(key: Column) -> Column:
    """A salt in [0, SALTS) from a key that is spread well."""
    return F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")


def salted(small: DataFrame) -> DataFrame:
    """Each row once for every salt, in a column named salt."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
