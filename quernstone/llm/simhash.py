"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at ``RADIUS`` (2) or fewer differing bits. Every distinct fingerprint
emits itself and its 64 variants at half the radius, one bit away. Two fingerprints link
exactly if they share a variant, the point halfway, and all that meet at a variant are
within the radius of each other: a variant's group is a clique of at most 65. So an edge
from each member to the group's smallest holds it together; nothing is lost and no list
of all pairs is made. Edges are deduplicated, verified by their differing bits, and
their components found by rounds of smallest labels and pointer jumping over shuffled
tables. Exact copies of a text share a fingerprint and are one row all that time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.work import Work, salt, salted, slices, without_dropped

RADIUS, SEED, SHINGLE = 2, 42, 3
#: Bytes of text whose hashes are in memory at once.
SLICE = 1 << 20


def text_fingerprint(text: bytes | None) -> int:
    """64 bits from the 3-word shingles of a text in UTF-8, as an unsigned integer."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = ends - np.fromiter(map(len, words), np.int64, len(words))
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    ones, digest, step = np.zeros(64, np.int64), xxhash.xxh64_intdigest, SLICE // 64
    for at in range(0, len(starts), step):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + step].tolist(), ends[at : at + step].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(starts)).tolist())


def _fingerprints(batches):
    for batch in batches:
        for rows in slices(batch, 1):
            prints = [text_fingerprint(x) for x in rows.column(1).cast(pa.large_binary()).to_pylist()]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(signed)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and print (the fingerprint's bits as a long) of each row. Null and empty
    texts, and texts of blanks only, have fingerprint zero."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, print long")


def edges(prints: DataFrame) -> DataFrame:
    """Distinct verified links (a < b) that join what lies within RADIUS, as stars."""
    masks = F.array(*(F.lit(m) for m in [0, *((1 << k) - (1 << 64) * (k == 63) for k in range(64))]))
    balls = prints.select("print", F.explode(F.transform(masks, lambda m: F.col("print").bitwiseXOR(m))).alias("variant"))
    met = balls.withColumn("least", F.min("print").over(Window.partitionBy("variant"))).where("least != print")
    return met.select(F.col("least").alias("a"), F.col("print").alias("b")).distinct().where(F.expr(f"bit_count(a ^ b) <= {RADIUS}"))


def components(links: DataFrame, work: Work) -> DataFrame:
    """node and label, the smallest node of its component, for the nodes of links (a, b).

    A round gives each node the least label of itself and its neighbours, then that
    label's own label. Fingerprints have few neighbours, so the first join has no hot
    key; the second, where a label may be that of very many, is salted.
    """
    both = work.table(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = work.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = work.table(lower, "lower")
        up = salted(lower.select(F.col("node").alias("label"), F.col("label").alias("next")).join(lower.select("label").distinct(), "label", "left_semi"))
        jumped = lower.withColumn("salt", salt(F.col("node"))).join(up, ["label", "salt"]).select("node", "old", F.col("next").alias("label"))
        jumped = work.table(jumped, "jumped")
        settled = jumped.where("old != label").isEmpty()
        labels = work.table(jumped.select("node", "label"), "labels")
        if settled:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the
    smallest doc_id that links reach.

    Null and empty texts have fingerprint zero and link as any other. Repeated rows give
    repeated rows; a null id takes no part in choosing component_id, which is null only
    where all ids that it reaches are null. Other columns take no part. An empty table
    gives an empty result.
    """
    work = Work(docs.sparkSession, "simhash")
    prints = work.table(fingerprints(docs, id_col, text_col), "prints")
    distinct = work.table(prints.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct")
    found = components(work.table(edges(distinct.select("print")), "edges"), work)
    members = distinct.join(found, distinct["print"] == found["node"], "left")
    grouped = members.where("label is not null or n > 1").withColumn("root", F.coalesce("label", "print"))
    roots = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = grouped.withColumn("salt", salt(F.col("print"))).join(salted(roots), ["root", "salt"]).select("print", "component_id")
    out = prints.withColumn("salt", salt(F.col("doc_id"))).join(salted(named), ["print", "salt"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """docs with the fingerprint of each row as 16 hex digits in a new last column."""
    at, schema = docs.columns.index(text_col), docs.select("*", F.lit("").alias(name)).schema

    def run(batches):
        for batch in batches:
            for rows in slices(batch, at):
                prints = [f"{text_fingerprint(x):016x}" for x in rows.column(at).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(prints, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id names their component, with their own columns.

    Null, empty and blank texts are one group of copies. Rows that repeat the id that
    stays with its text all stay; a row that shares that id but is in another group is
    judged there. Rows with a null id stay only where no row of their group has an id.
    An empty table stays empty.
    """
    found = near_duplicates(docs, id_col, text_col)
    kept = F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept")
    verdicts = found.select("doc_id", kept, F.col("fingerprint").alias("mark"))
    return without_dropped(docs, id_col, verdicts, lambda rows, name: with_fingerprint(rows, name, text_col), Work(docs.sparkSession, "simhash-kept"))
