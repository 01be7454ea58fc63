"""Deduplication of documents and paragraphs by normalised hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import safe, squeeze, strip, words
from quernstone.operators.skew import join_groups


def content_hash(text: Column) -> Column:
    """MD5 of the text in lower case with white space collapsed."""
    return F.md5(squeeze(F.lower(safe(text))))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with content_hash, first_id (the smallest id of that hash) and is_duplicate.

    Only ids and hashes meet in the aggregation, which is partial before its shuffle. The
    hashes of more than one document join back, salted, as one may be that of very many.
    """
    hashed = docs.withColumn("content_hash", content_hash(F.col(text_col)))
    groups = hashed.groupBy("content_hash").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = join_groups(hashed, groups, "content_hash", F.col(id_col))
    return joined.withColumn("first_id", F.coalesce("_first", id_col)).drop("_first").withColumn("is_duplicate", F.col(id_col) != F.col("first_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document, by id, of each content hash."""
    return exact_duplicates(docs, id_col, text_col).where("not is_duplicate").select(docs.columns)


#: Paragraphs end at blank lines and at conversation marks.
PARAGRAPH_BREAK = r"\n\s*\n|<\|.*?\|>|###|<\|im_start\|>"


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """One row for each paragraph of over min_chars characters: id, pos, paragraph, hash."""
    parts = F.filter(F.transform(F.split(safe(F.col(text_col)), PARAGRAPH_BREAK), strip), lambda p: F.length(p) > min_chars)
    exploded = docs.select(id_col, F.posexplode(parts).alias("pos", "paragraph"))
    return exploded.withColumn("paragraph_hash", content_hash(F.col("paragraph")))


def duplicate_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_paragraphs, n_repeated: a paragraph is repeated if one of the same hash comes
    before it, by id and position."""
    parts = paragraphs(docs, id_col, text_col).select(id_col, "pos", "paragraph_hash")
    groups = parts.groupBy("paragraph_hash").agg(F.min(F.struct(id_col, "pos")).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    marked = join_groups(parts, groups, "paragraph_hash", F.col(id_col))
    repeated = (F.col(f"first.{id_col}") != F.col(id_col)) | (F.col("first.pos") != F.col("pos"))
    return marked.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(repeated).alias("n_repeated"))


def vocabulary_similarity(text: Column) -> Column:
    """Distinct words over distinct words plus 100: a stand-in for a similarity that
    only says how rich the vocabulary is."""
    n = F.size(F.array_distinct(words(F.lower(safe(text)))))
    return n / (n + 100)


def changed_files(now: DataFrame, before: DataFrame, key: str = "path") -> DataFrame:
    """key and change (created, modified, deleted) from two snapshots with content_hash."""
    joined = now.select(key, F.col("content_hash").alias("_new")).join(before.select(key, F.col("content_hash").alias("_old")), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return joined.select(key, change.alias("change")).where("change is not null")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with all rows of the keys in changes replaced by those of changes."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)


def upsert_counts(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """One row: replaced, the rows of table that upsert takes out, and inserted, those that
    it puts in."""
    gone = table.join(changes.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("replaced"))
    return gone.crossJoin(F.broadcast(changes.agg(F.count(F.lit(1)).alias("inserted"))))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")


def unexpired(rows: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    """Rows whose time has not come."""
    return rows.where(F.col(column) > now)
