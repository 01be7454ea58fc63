"""Inputs that queries derive from the driver's tables, as documents there hold no blank
lines, hidden characters or headings. Each recipe has the same expression in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(text: Column) -> Column:
    """Each line that ends in a full stop becomes a paragraph."""
    return F.replace(text, F.lit(".\n"), F.lit(".\n\n"))


PARAGRAPHS_SQL = "replace(text, '.' || chr(10), '.' || chr(10) || chr(10))"


def adversarial(doc_id: Column, text: Column) -> Column:
    """Hidden characters, look-alikes, direction marks, bad decoding, phone and security
    numbers, each in every so many-th document."""
    out = F.when(doc_id % 7 == 0, F.concat(F.substring(text, 1, 10), F.lit("\u200b"), F.substring(text, 11, 2_000_000_000))).otherwise(text)
    out = F.when(doc_id % 11 == 0, F.regexp_replace(out, "^([^a]*)a", "$1\u0430")).otherwise(out)
    out = F.when(doc_id % 13 == 0, F.concat(out, F.lit("\u202e"))).otherwise(out)
    out = F.when(doc_id % 17 == 0, F.concat(out, F.lit("\ufffd"))).otherwise(out)
    out = F.when(doc_id % 19 == 0, F.concat(out, F.lit(" 555-123-4567"))).otherwise(out)
    return F.when(doc_id % 23 == 0, F.concat(out, F.lit(" 123-45-6789"))).otherwise(out)


ADVERSARIAL_SQL = """(SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN t5 || ' 123-45-6789' ELSE t5 END AS text FROM (
  SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN t4 || ' 555-123-4567' ELSE t4 END AS t5 FROM (
  SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN t3 || chr(65533) ELSE t3 END AS t4 FROM (
  SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN t2 || chr(8238) ELSE t2 END AS t3 FROM (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN regexp_replace(t1, '^([^a]*)a', '\\1' || chr(1072)) ELSE t1 END AS t2 FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 10) || chr(8203) || substr(text, 11) ELSE text END AS t1 FROM documents))))))"""


def book(docs: DataFrame, per: int = 20) -> DataFrame:
    """document_id, text: documents as chapters of books, `per` to a book, each with a
    heading and paragraphs; every seventh chapter of a book has lost its heading."""
    chapter = F.col("doc_id") % per + 1
    heading = F.when(F.col("doc_id") % 7 == 6, F.lit("")).otherwise(F.concat(F.lit("Chapter "), chapter.cast("string"), F.lit(": "), F.col("source"), F.lit("\n\n")))
    rows = docs.select(F.concat(F.lit("book_"), F.floor(F.col("doc_id") / per).cast("string")).alias("document_id"), "doc_id", F.concat(heading, paragraphs(F.col("text"))).alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    return rows.groupBy("document_id").agg(F.array_join(ordered, "\n\n").alias("text"))


BOOK_SQL = f"""(SELECT 'book_' || CAST(doc_id // 20 AS VARCHAR) AS document_id, string_agg(
  CASE WHEN doc_id % 7 = 6 THEN '' ELSE 'Chapter ' || CAST(doc_id % 20 + 1 AS VARCHAR) || ': ' || source || chr(10) || chr(10) END || {PARAGRAPHS_SQL}, chr(10) || chr(10) ORDER BY doc_id) AS text
  FROM documents GROUP BY 1)"""


def page_blocks(docs: DataFrame, per_page: int = 40) -> DataFrame:
    """Blocks of documents as printed pages: a line each, so many to a page, under a header
    that names the source and above a page number."""
    lines = docs.select(F.col("doc_id").cast("string").alias("document_id"), "source", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    body = lines.select("document_id", "source", (F.floor(F.col("n") / per_page) + 1).cast("int").alias("page_num"), (F.col("n") % per_page + 1).alias("slot"), "text")
    pages = body.select("document_id", "source", "page_num").distinct()
    header = pages.select("document_id", "source", "page_num", F.lit(0).alias("slot"), F.concat(F.lit("Corpus of "), "source").alias("text"))
    footer = pages.select("document_id", "source", "page_num", F.lit(per_page + 1).alias("slot"), F.concat(F.lit("Page "), F.col("page_num").cast("string")).alias("text"))
    rows = body.unionByName(header).unionByName(footer)
    top = F.col("slot") * (780.0 / (per_page + 1))
    box = F.struct(F.lit(0.0).alias("x0"), top.alias("y0"), F.lit(600.0).alias("x1"), (top + 15.0).alias("y1"))
    block_id = F.format_string("p%d_b%02d", F.col("page_num"), F.col("slot").cast("int"))
    return rows.select("document_id", block_id.alias("block_id"), "page_num", box.alias("bbox"), "text", F.lit(False).alias("is_heading"), F.lit(0).alias("heading_level"), F.lit(12.0).alias("font_size"), F.lit(False).alias("is_bold"), (F.col("page_num") * 1000 + F.col("slot")).cast("int").alias("reading_order_idx"))


PAGES_SQL = """(WITH body AS (
    SELECT CAST(doc_id AS VARCHAR) AS document_id, source, CAST((i - 1) // 40 + 1 AS INTEGER) AS page_num, (i - 1) % 40 + 1 AS slot, line AS text
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  pages AS (SELECT DISTINCT document_id, source, page_num FROM body)
  SELECT document_id, page_num, slot, text, slot * (780.0::DOUBLE / 41) AS y0, slot * (780.0::DOUBLE / 41) + 15 AS y1 FROM body
  UNION ALL SELECT document_id, page_num, 0, 'Corpus of ' || source, 0, 15 FROM pages
  UNION ALL SELECT document_id, page_num, 41, 'Page ' || CAST(page_num AS VARCHAR), 780, 795 FROM pages)"""


def asked(rows: DataFrame) -> DataFrame:
    """Conversation turns, every fourth of a user with a question mark."""
    return rows.withColumn("text", F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), F.concat("text", F.lit("?"))).otherwise(F.col("text")))


ASKED_SQL = "(SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn % 4 = 0 THEN text || '?' ELSE text END AS text FROM conversations)"


def calls(events: DataFrame) -> DataFrame:
    """Events as calls of three models: tokens by value, cost a thousandth of the value."""
    model = F.when(F.col("user_id") % 3 == 0, "gpt-3.5-turbo").when(F.col("user_id") % 3 == 1, "gpt-4").otherwise("other")
    return events.select("event_id", "ts", "event_type", model.alias("model"), F.floor(F.col("value") * 100).cast("long").alias("tokens_in"), F.floor(F.col("value") * 10).cast("long").alias("tokens_out"), "value")


CALLS_SQL = """(SELECT event_id, ts, event_type, CASE WHEN user_id % 3 = 0 THEN 'gpt-3.5-turbo' WHEN user_id % 3 = 1 THEN 'gpt-4' ELSE 'other' END AS model,
  CAST(floor(value * 100) AS BIGINT) AS tokens_in, CAST(floor(value * 10) AS BIGINT) AS tokens_out, value FROM events)"""


def quarantined(docs: DataFrame) -> DataFrame:
    """Documents as quarantine rows: level, status and time by id."""
    level = F.element_at(F.array(*map(F.lit, ("suspicious", "dangerous", "critical"))), (F.col("doc_id") % 3 + 1).cast("int"))
    status = F.when(F.col("doc_id") % 5 == 0, "approved").otherwise("pending")
    threats = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("homoglyphs")), F.when(F.col("doc_id") % 3 == 0, F.lit("direction_override")), F.lit("repeated_tokens")))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 600)
    return docs.select(F.concat(F.lit("q_"), F.col("doc_id").cast("string")).alias("entry_id"), F.md5("text").alias("content_hash"), F.col("text").alias("content"), level.alias("threat_level"), threats.alias("threats"), F.col("source").alias("source_file"), at.cast("timestamp_ntz").alias("timestamp"), status.alias("review_status"))


QUARANTINED_SQL = """(SELECT 'q_' || CAST(doc_id AS VARCHAR) AS entry_id, md5(text) AS content_hash, text AS content, ['suspicious', 'dangerous', 'critical'][doc_id % 3 + 1] AS threat_level,
  list_filter([CASE WHEN doc_id % 2 = 0 THEN 'homoglyphs' END, CASE WHEN doc_id % 3 = 0 THEN 'direction_override' END, 'repeated_tokens'], lambda x: x IS NOT NULL) AS threats,
  source AS source_file, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 600) AS timestamp, CASE WHEN doc_id % 5 = 0 THEN 'approved' ELSE 'pending' END AS review_status FROM documents)"""
