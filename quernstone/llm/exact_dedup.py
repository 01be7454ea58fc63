"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is lower-cased (A-Z only) and cut where its content says so: at the first line or
sentence end that lies at least ``MIN_CHUNK`` characters after the last cut, or after
``MAX_CHUNK`` characters. Each chunk gets a 64-bit address, and addresses are verified:
the chunks' SHA-256 digests are gathered by address, pre-aggregated in each map task, and
an address that chunks with different digests share is ambiguous. A document is then its *recipe*, the ordered
list of its addresses. Only recipes are grouped and joined; long texts move no more.
Should any address be ambiguous, the documents that use it carry their SHA-256 beside
the recipe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.work import Work, salt, salted, without_dropped

#: Bounds of a chunk in characters. Copies are found whatever they are; they only set how
#: long a recipe is.
MIN_CHUNK, MAX_CHUNK = 1024, 8192

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is the empty text. In a text of ASCII only,
    lower() does the same and is much faster than translate()."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; none for an empty text."""
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[\n.!?]|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def address(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def ambiguous_addresses(norm: DataFrame, hasher=address) -> DataFrame:
    """Addresses that chunks of the texts in column norm with different SHA-256 have. A
    digest travels once from each map task that has its chunk."""
    made = norm.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    distinct = made.select(hasher(F.col("chunk")).alias("address"), F.unhex(F.sha2("chunk", 256)).alias("digest")).distinct()
    return distinct.groupBy("address").count().where("count > 1").select("address")


def with_proof(recipes: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Adds column proof: the text's SHA-256 where the recipe has an ambiguous address."""
    unsure = recipes.select("text_sha256", F.explode(F.array_distinct("recipe")).alias("address")).join(ambiguous, "address", "left_semi").select("text_sha256").distinct()
    unsure = salted(unsure.withColumn("proof", F.col("text_sha256")))
    return recipes.withColumn("salt", salt(F.col("doc_id"))).join(unsure, ["text_sha256", "salt"], "left").withColumn("proof", F.coalesce("proof", F.lit(""))).drop("salt")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hasher=address) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of texts that are equal after lower-casing A-Z, the row with the largest id stays.
    Null texts are empty, and all empty texts are equal. Null ids are never preferred
    to others; among null ids alone keep_id is null and the rows are kept. Rows that
    repeat an id with the same text share one fate: all count in group_size, and all
    are kept if the id is. Other columns of docs, whatever their names, take no part.
    An empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    recipe = F.transform(chunks(F.col("norm")), hasher)
    recipes = work.table(rows.select("doc_id", recipe.alias("recipe"), F.sha2("norm", 256).alias("text_sha256")), "recipes")
    ambiguous = work.table(ambiguous_addresses(rows.select("norm"), hasher), "ambiguous")
    proven = recipes.withColumn("proof", F.lit("")) if ambiguous.isEmpty() else with_proof(recipes, ambiguous)
    groups = proven.groupBy("recipe", "proof").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    matched = proven.withColumn("salt", salt(F.col("doc_id"))).join(salted(groups), ["recipe", "proof", "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return matched.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with their own columns.

    Null texts are empty texts, of which one stays. Of equal texts the largest id stays;
    rows that repeat that id with an equal text all stay, and rows that share an id with
    other texts are judged by their own. An empty table stays empty.
    """
    found = exact_duplicates(docs, id_col, text_col).withColumnRenamed("text_sha256", "mark")
    own = lambda rows, name: rows.withColumn(name, F.sha2(normalised(F.col(text_col)), 256))
    return without_dropped(docs, id_col, found, own, Work(docs.sparkSession, "exact-kept"))
