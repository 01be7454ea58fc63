"""Queries of blocks, furniture, sections, chunks, validation and retrieval, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.operators import chunk, retrieval, stats, structure, validate
from quernstone.operators.store import Work
from quernstone.plans import phases
from quernstone.plans.recipes import BOOK_SQL, PAGES_SQL, book, page_blocks, table
from quernstone.plans.text_queries import lit_sql, strip_sql, typed

#: Best chunks are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_BEST = 100_000
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def blocks(spark, sf_dir):
    return structure.plain_text_blocks(book(docs(spark, sf_dir)))


def pages(spark, sf_dir):
    return page_blocks(docs(spark, sf_dir))


def cleaned(spark, sf_dir):
    return structure.clean_furniture(blocks(spark, sf_dir))


_BLOCKS = f"""(SELECT document_id, CAST(i - 1 AS INTEGER) AS reading_order_idx, p AS text, CASE WHEN starts_with(p, '#') THEN least(3, length(regexp_extract(p, '^#+'))) WHEN regexp_matches(p, {lit_sql(structure.PLAIN_HEADING)}) THEN 1 ELSE 0 END AS heading_level
  FROM (SELECT document_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT document_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS ps FROM {BOOK_SQL})))"""


@query(f"SELECT document_id, reading_order_idx, 'txt_b' || CASE WHEN reading_order_idx < 1000 THEN lpad(CAST(reading_order_idx AS VARCHAR), 3, '0') ELSE CAST(reading_order_idx AS VARCHAR) END AS block_id, md5(text) AS text_md5, heading_level, heading_level > 0 AS is_heading, reading_order_idx * 50.0::DOUBLE AS y0 FROM {_BLOCKS}")
def text_blocks(spark, sf_dir):
    """Blocks of plain text with headings."""
    return blocks(spark, sf_dir).select("document_id", "reading_order_idx", "block_id", F.md5("text").alias("text_md5"), "heading_level", "is_heading", F.col("bbox.y0").alias("y0"))


def _any(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {lit_sql(p)})" for p in patterns) + ")"


_FIRST = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query(f"""
SELECT document_id, page_num, slot, CASE WHEN n = 0 OR n > 4 THEN 0 WHEN regexp_matches(f, {lit_sql(structure.NUMBERED_HEADING)}) THEN 1
  WHEN ({' OR '.join(f'contains(lower(bare), {lit_sql(k)})' for k in structure.HEADING_KEYWORDS)}) AND length(bare) < 80 THEN 2 WHEN regexp_matches(f, {lit_sql(structure.TIP)}) AND length(text) < 100 THEN 2
  WHEN size >= 15 AND length(text) < 120 THEN 1 WHEN (size >= 13.2 OR bold) AND length(text) < 100 AND NOT suffix(text, '.') THEN 2 ELSE 0 END AS heading_level
FROM (SELECT document_id, page_num, slot, text, {strip_sql('text')} AS bare, len({_FIRST}) AS n, coalesce({_FIRST}[1], '') AS f, CASE slot % 4 WHEN 0 THEN 15.5 WHEN 1 THEN 13.5 ELSE 12.0 END AS size, slot % 7 = 0 AS bold FROM {PAGES_SQL})""")
def heading_levels(spark, sf_dir):
    """Headings by wording and font, with fonts that alternate down the page."""
    rows = pages(spark, sf_dir).withColumn("slot", (F.col("reading_order_idx") % 1000).cast("long"))
    font = F.when(F.col("slot") % 4 == 0, 15.5).when(F.col("slot") % 4 == 1, 13.5).otherwise(12.0)
    return rows.select("document_id", "page_num", "slot", structure.classify_heading(F.col("text"), font, F.lit(12.0), F.col("slot") % 7 == 0).alias("heading_level"))


_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_FURNITURE = f"""(WITH b AS (SELECT *, {_NORM} AS furniture, greatest(800.0, max(y1) OVER (PARTITION BY document_id)) AS height FROM {PAGES_SQL}),
  z AS (SELECT *, CASE WHEN y0 <= height * 0.15 THEN 'header' WHEN y1 >= height * 0.85 THEN 'footer' END AS zone FROM b WHERE length(furniture) >= 3)
  SELECT document_id, zone, furniture FROM z WHERE zone IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page_num) >= 2)"""


@query(f"SELECT document_id, zone, furniture FROM {_FURNITURE}")
def furniture_repeats(spark, sf_dir):
    """Lines in the tops and bottoms of pages that repeat."""
    return structure.repeated_furniture(pages(spark, sf_dir))


@query(f"""SELECT document_id, page_num, slot, coalesce({_any(strip_sql('text'), structure.PAGE_NUMBERS)} AND length({strip_sql('text')}) < 20, false) AS is_page_number, """ + ", ".join(f"{_any('text', patterns)} AS is_{tag}" for tag, patterns in structure.TAGS.items()) + f" FROM {PAGES_SQL}")
def block_tags(spark, sf_dir):
    """Page numbers, and lines like contents lists, biographies or promotion."""
    t = F.col("text")
    return pages(spark, sf_dir).select("document_id", "page_num", (F.col("reading_order_idx") % 1000).cast("long").alias("slot"), structure.is_page_number(t).alias("is_page_number"), *(F.array_contains(structure.tags(t), tag).alias(f"is_{tag}") for tag in structure.TAGS))


@query()
def furniture_cleaning(spark, sf_dir):
    """What is removed from pages, and why, with near matches."""
    rows = structure.furniture_audit(structure.clean_furniture(pages(spark, sf_dir)))
    return rows.select("document_id", "page_num", "block_id", "removal_type", F.md5("removed_text").alias("text_md5"))


@query("""
WITH b AS (SELECT document_id, page_num, slot, CASE WHEN slot % 5 = 0 THEN 20.0 WHEN slot % 2 = 0 THEN 20.0 ELSE 320.0 END AS x0, CASE WHEN slot % 5 = 0 THEN 600.0 WHEN slot % 2 = 0 THEN 290.0 ELSE 600.0 END AS x1, y0 FROM """ + PAGES_SQL + """),
  s AS (SELECT *, CASE WHEN x1 - x0 > 612 * 0.7 THEN 0 WHEN x1 <= 326 THEN 1 WHEN x0 >= 286 THEN 2 ELSE 0 END AS side FROM b),
  c AS (SELECT *, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER p >= 2 AND sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) OVER p >= 2 AS two FROM s WINDOW p AS (PARTITION BY document_id, page_num))
SELECT document_id, page_num, slot, CAST(row_number() OVER (PARTITION BY document_id, page_num ORDER BY CASE WHEN two THEN side ELSE 0 END, CASE WHEN two THEN y0 ELSE round_even(y0 / 5, 0) * 5 END, x0, slot) - 1 AS INTEGER) AS reading_order_idx FROM c""")
def reading_order(spark, sf_dir):
    """Order of blocks on pages with two columns and spanning lines."""
    rows = pages(spark, sf_dir).withColumn("slot", (F.col("reading_order_idx") % 1000).cast("long"))
    wide, left = F.col("slot") % 5 == 0, F.col("slot") % 2 == 0
    box = F.struct(F.when(wide | left, 20.0).otherwise(320.0).alias("x0"), F.col("bbox.y0").alias("y0"), F.when(wide, 600.0).when(left, 290.0).otherwise(600.0).alias("x1"), F.col("bbox.y1").alias("y1"))
    return structure.reading_order(rows.withColumn("bbox", box)).select("document_id", "page_num", "slot", "reading_order_idx")


@query("SELECT document_id, list_sort(list(12.0 + slot % 5))[len(list(slot)) // 2 + 1] AS median_font FROM " + PAGES_SQL + f" WHERE {strip_sql('text')} <> '' GROUP BY document_id")
def median_font(spark, sf_dir):
    """The upper median of font sizes."""
    rows = pages(spark, sf_dir).select("document_id", "text", (12.0 + F.col("reading_order_idx") % 1000 % 5).alias("font_size"))
    return structure.median_font_size(rows)


# RE2's word boundaries know ASCII only: other letters stand as "_", a word's character that
# is none of a-z
_WORDS_ONLY = "regexp_replace(b, '[ªµºÀ-ÖØ-öø-ˁͰ-ϿЀ-ԯ]', '_', 'g')"
_CONTROLS = rf"(len(regexp_extract_all(b, '\p{{C}}')) - len(regexp_extract_all(b, '[\n\r\t]')))"
_SYMBOLS = f"(len(regexp_extract_all(b, {lit_sql(structure.ODD_SYMBOL)})) / length(b))"
_NOISE = f"""CASE WHEN length(b) < 4 THEN NULL WHEN regexp_matches(b, {lit_sql(structure.GLYPH_JUNK)}) THEN 'unmapped_glyph_sequence' WHEN {_CONTROLS} > 0 THEN 'contains_' || {_CONTROLS} || '_control_chars'
  WHEN n > 3 AND len(regexp_extract_all({_WORDS_ONLY}, {lit_sql(structure.BROKEN_WORDS)})) >= greatest(2, n // 3) THEN 'excessive_broken_word_spacing' WHEN length(b) > 15 AND {_SYMBOLS} > 0.35 THEN 'high_symbol_ratio' END"""


@query(rf"SELECT document_id, page_num, slot, {_NOISE} AS reason FROM (SELECT document_id, page_num, slot, {strip_sql('text')} AS b, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM {PAGES_SQL})")
def garbled_lines(spark, sf_dir):
    """Lines that look broken by extraction, and why."""
    slot = (F.col("reading_order_idx") % 1000).cast("long").alias("slot")
    reason = F.regexp_replace(structure.garbled_reason(F.col("text")), r"^(high_symbol_ratio).*", "$1")
    return pages(spark, sf_dir).select("document_id", "page_num", slot, reason.alias("reason"))


@query(f"""
WITH b AS (SELECT *, text AS t, {_FIRST}[1] AS f, len({_FIRST}) AS n FROM {_BLOCKS}),
  k AS (SELECT *, n <= 4 AND ({_any('f', structure.SECTION_HEADINGS)} OR heading_level = 1) AS opens FROM b),
  s AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY document_id ORDER BY reading_order_idx) AS sec FROM k)
SELECT document_id, CAST(sec AS BIGINT) AS sec, max(CASE WHEN opens THEN f END) AS title, count(*) FILTER (WHERE NOT opens) AS n_blocks FROM s GROUP BY document_id, sec""")
def section_counts(spark, sf_dir):
    """Sections of books by their headings, with the blocks under each."""
    rows = structure.assign_sections(cleaned(spark, sf_dir).withColumn("tags", F.array().cast("array<string>")))
    rows = rows.where("section_type in ('section', 'document')").withColumn("sec", F.coalesce(F.regexp_extract("section_id", r"_sec_(\d+)$", 1).try_cast("bigint"), F.lit(0)))
    return rows.groupBy("document_id", "sec").agg(F.max(F.when(F.col("sec") > 0, F.col("section_title"))).alias("title"), F.count_if("is_content").alias("n_blocks"))


_SPECIAL = f"""CASE WHEN {_any('text', structure.TAGS['toc'])} OR len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {lit_sql(structure.TOC_LINE)}))) >= 2 OR contains(lower(text), 'table of contents') THEN 'toc'
  WHEN {_any('text', structure.TAGS['biography'])} OR contains(lower(text), 'about the author') OR contains(lower(text), 'about us') THEN 'biography' WHEN {_any('text', structure.TAGS['promotional'])} THEN 'promotional' END"""
_FITS = f"(heading_level > 0 AND pos <= 5 AND length(f) BETWEEN 6 AND 99 AND later = 0 AND NOT {_any('f', structure.SECTION_HEADINGS + structure.SUBSECTION_HEADINGS)})"


@query(rf"""
WITH b AS (SELECT *, {_FIRST} AS own, {_FIRST}[1] AS f, {_SPECIAL} AS special, row_number() OVER w AS pos, coalesce(sum(CASE WHEN heading_level = 0 AND length(text) >= 80 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later
    FROM {_BLOCKS} WHERE NOT ({_any('text', structure.PAGE_NUMBERS)} AND length(text) < 20) WINDOW w AS (PARTITION BY document_id ORDER BY reading_order_idx)),
  t AS (SELECT document_id, coalesce(arg_min(CASE WHEN {_FITS} THEN f END, reading_order_idx) FILTER (WHERE {_FITS}), 'Book ' || regexp_extract(document_id, '\d+$')) AS title FROM b GROUP BY document_id),
  k AS (SELECT *, CASE WHEN special IS NOT NULL THEN 'special' WHEN len(own) <= 4 AND ({_any('f', structure.SECTION_HEADINGS)} OR heading_level = 1) THEN 'section' WHEN len(own) <= 4 AND ({_any('f', structure.SUBSECTION_HEADINGS)} OR heading_level = 2) THEN 'subsection' ELSE 'content' END AS kind,
    regexp_replace(trim(regexp_replace(f, '\s+', ' ', 'g')), '^#+\s*', '') AS heading FROM b JOIN t USING (document_id)),
  s AS (SELECT *, CAST(sum(CAST(kind = 'section' AS INTEGER)) OVER (PARTITION BY document_id ORDER BY reading_order_idx) AS INTEGER) AS sec FROM k),
  u AS (SELECT *, CAST(sum(CAST(kind = 'subsection' AS INTEGER)) OVER (PARTITION BY document_id, sec ORDER BY reading_order_idx) AS INTEGER) AS sub FROM s),
  h AS (SELECT *, max(CASE WHEN kind = 'section' THEN heading END) OVER (PARTITION BY document_id, sec) AS sec_title, max(CASE WHEN kind = 'subsection' THEN heading END) OVER (PARTITION BY document_id, sec, sub) AS sub_title,
    CASE WHEN sec > 0 THEN document_id || '_sec_' || format('{{:02d}}', sec) ELSE document_id || '_root' END AS sec_id, CASE special WHEN 'toc' THEN 'Table of Contents' WHEN 'biography' THEN 'About & Biography' WHEN 'promotional' THEN 'Promotional & External Links' END AS special_title,
    CASE WHEN kind IN ('section', 'subsection') THEN array_to_string(own[2:], chr(10)) ELSE text END AS body FROM u),
  r AS (SELECT document_id, body, kind NOT IN ('section', 'subsection') OR body <> '' AS is_content,
    CASE WHEN special IS NOT NULL THEN document_id || '_' || CASE special WHEN 'toc' THEN 'toc' WHEN 'biography' THEN 'bio' ELSE 'promo' END WHEN sub > 0 THEN sec_id || '_sub_' || format('{{:02d}}', sub) ELSE sec_id END AS section_id,
    CASE WHEN special IS NOT NULL OR (sub = 0 AND sec > 0) THEN document_id || '_root' WHEN sub > 0 THEN sec_id END AS parent_section_id, CASE WHEN special IS NOT NULL THEN title || ' > ' || special_title ELSE concat_ws(' > ', title, sec_title, sub_title) END AS section_path,
    CASE WHEN special IS NOT NULL THEN special WHEN sub > 0 THEN 'subsection' WHEN sec > 0 THEN 'section' ELSE 'document' END AS section_type, CASE WHEN special IS NOT NULL THEN 1 WHEN sub > 0 THEN 2 WHEN sec > 0 THEN 1 ELSE 0 END AS level FROM h)
SELECT document_id, section_id, parent_section_id, section_path, section_type, level, count(*) FILTER (WHERE is_content) AS n_blocks, CAST(sum(CASE WHEN is_content THEN length(body) ELSE 0 END) AS BIGINT) AS n_chars FROM r GROUP BY ALL""")
def section_hierarchy(spark, sf_dir):
    """All sections of books with their paths."""
    rows = structure.section_table(structure.assign_sections(cleaned(spark, sf_dir)))
    return rows.select("document_id", "section_id", "parent_section_id", "section_path", "section_type", "level", "n_blocks", "n_chars")


def _chunks(spark, sf_dir):
    return chunk.chunk_sections(structure.assign_sections(cleaned(spark, sf_dir)))


@query()
def structured_chunks(spark, sf_dir):
    """Structure-aware chunks of books."""
    return _chunks(spark, sf_dir).select("document_id", "chunk_id", "chunk_index", "section_path", "token_count", F.array_join("quality_flags", ",").alias("flags"), F.size("source_block_ids").alias("n_blocks"), "has_continuation", F.md5("embedding_text").alias("text_md5"))


@query()
def chunk_exports(spark, sf_dir):
    """Chat records of chunks."""
    return chunk.chat_records(_chunks(spark, sf_dir)).select("chunk_id", F.md5("record").alias("record_md5"))


@query()
def chunk_report(spark, sf_dir):
    """Validation of chunks, fates of blocks and coverage, for each book."""
    return phases.structured(book(docs(spark, sf_dir))).report


_UNITS = r"(?i)\b(step|chapter|part|module)\s+(\d{1,3})\b"


@query(f"""
WITH h AS (SELECT DISTINCT document_id, lower(regexp_extract(text, {lit_sql(_UNITS)}, 1)) AS kind, CAST(regexp_extract(text, {lit_sql(_UNITS)}, 2) AS INTEGER) AS n FROM {_BLOCKS} WHERE heading_level > 0),
  m AS (SELECT document_id, kind, max(n) AS most FROM h GROUP BY ALL)
SELECT document_id, kind, CAST(n AS INTEGER) AS n FROM (SELECT document_id, kind, unnest(range(1, most + 1)) AS n FROM m) ANTI JOIN h USING (document_id, kind, n)""")
def numbering_gaps(spark, sf_dir):
    """Chapter numbers that books skip."""
    rows = blocks(spark, sf_dir)
    return validate.numbering_gaps(rows, structure.document_titles(rows))


@query()
def unit_coverage(spark, sf_dir):
    """Expected chapters, and whether chunks name them."""
    clean = cleaned(spark, sf_dir)
    return validate.coverage(clean, structure.document_titles(clean), _chunks(spark, sf_dir))


@query(f"SELECT doc_id, CAST(place // 900 AS INTEGER) AS chunk_no, {strip_sql('substr(text, place + 1, 1000)')} AS text FROM (SELECT doc_id, text, unnest(range(0, length(text), 900)) AS place FROM documents) WHERE {strip_sql('substr(text, place + 1, 1000)')} <> ''")
def naive_chunks(spark, sf_dir):
    """Overlapping windows of 1,000 characters."""
    return chunk.naive_chunks(docs(spark, sf_dir))


def _ranked(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(docs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), queries)


# words by Unicode letters, of which those of ASCII count; RE2 has no such word boundary
_TERMS = r"list_transform(list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_-]+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: regexp_full_match(w, '[a-zA-Z0-9_-]{2,}')), lambda w: lower(w))"
_BM25 = f"""(WITH p AS (SELECT doc_id, term, count(*) AS tf, max(n) AS length FROM (SELECT doc_id, len({_TERMS}) AS n, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
  q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY term), k AS (SELECT count(*) AS n FROM documents)
  SELECT query_id, doc_id AS chunk_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / 150.0))) AS score FROM p JOIN q USING (term) JOIN f USING (term) CROSS JOIN k GROUP BY ALL)"""


@query(f"SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS INTEGER) AS rank FROM {_BM25}) WHERE rank <= 5")
def bm25_top5(spark, sf_dir):
    """The five best documents for each benchmark passage by BM25."""
    ranked = retrieval.top_chunks(_ranked(spark, sf_dir).withColumn("exact", F.col("score")).withColumn("score", F.round("score", 6)))
    return ranked.select("query_id", "rank", "chunk_id", F.round("exact", 4).alias("score"))


@query(f"""SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS INTEGER) AS rank FROM {_BM25}) WHERE rank <= 5 AND query_id % 2 = 0
UNION ALL SELECT item_id, CAST(rank AS INTEGER), doc_id, 0.0 FROM benchmark, (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE len({_TERMS}) > 0) WHERE item_id % 2 = 1 AND rank <= 5""")
def bm25_search(spark, sf_dir):
    """Five documents for each query, also for those that have no word in common with any."""
    words = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("qqqqzzzz"), F.col("item_id").cast("string")))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("query"))
    found = retrieval.search(docs(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id"), queries)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS})) AS term FROM documents) GROUP BY term")
def document_frequencies(spark, sf_dir):
    """In how many documents each term occurs."""
    return retrieval.document_frequencies(docs(spark, sf_dir))


@query()
def retrieval_comparison(spark, sf_dir):
    """Naive against structured chunks of books, on cases made from their sections."""
    work = Work(spark, "retrieval_comparison")
    books = book(docs(spark, sf_dir))
    assigned = work.table(phases.chunked(books, work=work)[0].sections.where("is_content"), "sections", tidy=True)
    work.drop("blocks")
    # together by document, as cases need them, so that texts move once
    content = assigned.repartition("document_id").groupBy("document_id", "section_id", "section_title", "section_type", "section_order").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reading_order_idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    cases = work.table(retrieval.cases_from_sections(content).withColumn("query_id", F.concat_ws("|", "document_id", "target_section")), "cases", tidy=True)
    packed = work.table(chunk.chunk_sections(assigned).select("chunk_id", "source_text", "section_path"), "chunks", tidy=True)
    work.drop("sections")
    structured = packed.withColumn("embedding_text", chunk.embedding(F.col("section_path"), F.col("source_text")))

    def windows(of):
        return chunk.naive_chunks(of, "document_id").select(F.concat_ws("_", "document_id", "chunk_no").alias("chunk_id"), F.col("text").alias("source_text"), F.lit("").alias("section_path"), F.col("text").alias("embedding_text"))

    asked = work.table(retrieval.bags(cases), "bags", tidy=True)
    expected = cases.join(asked, "query_id").select(F.col("query_id").alias("query"), "bag", "expected")
    rows = None
    for system, chunks in (("naive", windows(books)), ("structured", structured)):
        best = work.table(retrieval.best_by_bag(chunks, asked, Work(spark, system), text_col="embedding_text").select("bag", "rank", "chunk_id"), system, tidy=True)
        # five chunks for each distinct query, which are few here
        small = F.broadcast if best.count() <= BROADCAST_BEST else lambda df: df
        if system == "naive":
            chunks = windows(books.join(small(best.select(F.regexp_replace("chunk_id", r"_\d+$", "").alias("document_id")).distinct()), "document_id", "left_semi"))
        texts = work.table(chunks.join(small(best), "chunk_id").select("bag", "rank", "source_text", "embedding_text", "section_path"), f"{system}_texts", tidy=True)
        part = expected.join(texts, "bag").withColumn("system", F.lit(system))
        rows = part if rows is None else rows.unionByName(part)
    reports = retrieval.evaluate_rows(rows, ["Corpus of"])
    out = retrieval.compare(reports, "naive", "structured")
    return out.select("metric", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "change")


@query("SELECT document_id, reading_order_idx FROM (SELECT document_id, reading_order_idx, row_number() OVER (PARTITION BY document_id ORDER BY reading_order_idx) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM " + _BLOCKS + ") WHERE list_contains(list_transform(range(6), lambda j: CAST(floor(j * greatest(1.0, n / 6)) AS BIGINT)), i)")
def strided_blocks(spark, sf_dir):
    """Six blocks of each book, spread evenly."""
    return stats.strided(blocks(spark, sf_dir).select("document_id", "reading_order_idx"), 6, F.col("reading_order_idx"), by=["document_id"])


@query(f"SELECT document_id, reading_order_idx, CAST(count(*) FILTER (WHERE heading_level > 0) OVER (PARTITION BY document_id ORDER BY reading_order_idx) AS BIGINT) AS n_headings FROM {_BLOCKS}")
def heading_carry(spark, sf_dir):
    """Headings seen so far at each block."""
    order = Window.partitionBy("document_id").orderBy("reading_order_idx")
    return blocks(spark, sf_dir).select("document_id", "reading_order_idx", F.count_if("is_heading").over(order).alias("n_headings"))


ORACLES["text_blocks"] = typed(ORACLES["text_blocks"], "INTEGER", "heading_level")
ORACLES["median_font"] = typed(ORACLES["median_font"], "DOUBLE", "median_font")
