"""Validation of chunks, the manifest of blocks, and coverage of numbered units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import safe, strip
from quernstone.operators.structure import SECTION_STARTS, garbled_reason, starts

# Kinds of numbered units and number words.
KINDS = ("step", "chapter", "part", "module")
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
_NUMBER = r"\d{1,3}|" + "|".join(NUMBER_WORDS)
UNIT = rf"(?i)\b(step|chapter|part|module)\s+({_NUMBER})\b"
DECLARED = rf"(?i)\b({_NUMBER})[\s-]+(step|chapter|part|module)s?\b"
STEP = r"(?i)\b(Step\s+(?:One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|[0-9]+))\b"
MIN_BODY = 15


def number(token: Column) -> Column:
    """Value of digits or of a number word up to twenty."""
    words = F.create_map(*[x for k, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(k + 1))])
    return F.when(F.rlike(token, F.lit(r"^\d+$")), token.try_cast("int")).otherwise(F.try_element_at(words, F.lower(token)))


def units_in(text: Column) -> Column:
    """Distinct numbered units that the text names, as structs (kind, n)."""
    named = F.regexp_extract_all(safe(text), F.lit(UNIT), F.lit(0))
    return F.array_distinct(F.transform(named, lambda u: F.struct(F.lower(F.regexp_extract(u, UNIT, 1)).alias("kind"), number(F.regexp_extract(u, UNIT, 2)).alias("n"))))


def declared_units(title: Column) -> Column:
    """Numbers of units that a title promises ("Ten Step Plan"), as structs (kind, n)."""
    numbers, kinds = (F.regexp_extract_all(safe(title), F.lit(DECLARED), F.lit(k)) for k in (1, 2))
    return F.zip_with(kinds, numbers, lambda k, n: F.struct(F.lower(k).alias("kind"), number(n).alias("n")))


def checked(chunks: DataFrame, text_col: str = "embedding_text") -> DataFrame:
    """What validation needs of each chunk, without its texts: document_id, chunk_id,
    source_block_ids, sample_text, issues (structs of issue_type, severity, message) and
    units. chunk_issues, coverage, manifest and report take it in place of chunks."""
    return _with_issues(chunks, "source_block_ids", units_in(F.col(text_col)).alias("units"))


def _with_issues(chunks: DataFrame, *more) -> DataFrame:
    text = F.col("source_text")
    steps = F.array_distinct(F.transform(F.regexp_extract_all(safe(text), F.lit(STEP), F.lit(1)), lambda s: F.lower(F.regexp_replace(s, r"\s+", " "))))
    toc = F.exists("quality_flags", lambda f: F.contains(f, F.lit("toc")))
    issue = lambda kind, severity, message: F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), message.alias("message"))
    # columns first: both are used twice
    rows = chunks.select("document_id", "chunk_id", F.substring(safe(text), 1, 100).alias("sample_text"), garbled_reason(text).alias("_reason"), steps.alias("_steps"), toc.alias("_toc"), (F.length(strip(text)) < MIN_BODY).alias("_tiny"), (strip(F.col("section_path")) == "").alias("_detached"), *more)
    found = F.array_compact(
        F.array(
            F.when(F.col("_tiny"), issue("empty_body", "error", F.lit("Chunk has empty or trivial body content"))),
            F.when(F.col("_reason").isNotNull(), issue("garbled_text", "error", F.concat(F.lit("Garbled text detected: "), F.col("_reason")))),
            F.when(F.col("_detached"), issue("detached_heading", "warning", F.lit("Chunk has missing or empty section_path"))),
            F.when((F.size("_steps") > 1) & ~F.col("_toc"), issue("cross_section_leakage", "warning", F.concat(F.lit("Several steps in one chunk: "), F.array_join(F.sort_array("_steps"), ", ")))),
        )
    )
    return rows.withColumn("issues", found).drop("_reason", "_steps", "_toc", "_tiny", "_detached")


def chunk_issues(chunks: DataFrame) -> DataFrame:
    """One row for each issue: document_id, chunk_id, issue_type, severity, message,
    sample_text."""
    rows = (chunks if "issues" in chunks.columns else _with_issues(chunks)).select("document_id", "chunk_id", "sample_text", F.explode("issues").alias("i"))
    return rows.select("document_id", "chunk_id", "i.issue_type", "i.severity", "i.message", "sample_text")


def manifest(blocks: DataFrame, chunks: DataFrame, excluded: DataFrame) -> DataFrame:
    """The fate of each source block: document_id, block_id, fate (included, excluded,
    held) and reason. A heading whose body was kept counts as included with it."""
    used = chunks.select("document_id", F.explode("source_block_ids").alias("block_id")).select("document_id", F.regexp_replace("block_id", "_body$", "").alias("block_id")).distinct().withColumn("_used", F.lit(True))
    gone = excluded.select("document_id", "block_id", F.col("reason").alias("_reason")).dropDuplicates(["document_id", "block_id"])
    rows = blocks.select("document_id", "block_id").distinct().join(used, ["document_id", "block_id"], "left").join(gone, ["document_id", "block_id"], "left")
    fate = F.when(F.col("_used"), "included").when(F.col("_reason").isNotNull(), "excluded").otherwise("held")
    return rows.select("document_id", "block_id", fate.alias("fate"), F.when(fate == "excluded", F.col("_reason")).when(fate == "held", "unassigned_block").alias("reason"))


def expected_units(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """document_id, kind, n, source (heading or title) of units that a document should
    have: those of its headings, and 1 to the number that its title declares."""
    first = strip(F.substring_index(strip(F.col("text")), "\n", 1))
    headings = blocks.where(F.col("is_heading") | starts(first, SECTION_STARTS) & F.rlike(first, F.lit("^" + UNIT.replace("(?i)", "(?i:") + ")"))).select("document_id", F.explode(units_in(first)).alias("u"))
    named = titles.select("document_id", F.concat_ws(" ", F.translate("document_id", "_-", "  "), "title").alias("title")).select("document_id", F.explode(declared_units(F.col("title"))).alias("d"))
    promised = named.where("d.n > 0").select("document_id", F.col("d.kind").alias("kind"), F.explode(F.sequence(F.lit(1), F.col("d.n"))).alias("n"))
    return headings.select("document_id", "u.kind", "u.n", F.lit("heading").alias("source")).unionByName(promised.withColumn("source", F.lit("title"))).distinct()


def coverage(blocks: DataFrame, titles: DataFrame, chunks: DataFrame, text_col: str = "embedding_text", units: DataFrame | None = None) -> DataFrame:
    """document_id, kind, n, status of each expected unit: detected or missing (none of
    the chunks names it). units can hand over what expected_units gives."""
    expected = (expected_units(blocks, titles) if units is None else units).select("document_id", "kind", "n").distinct()
    named = F.col("units") if "units" in chunks.columns else units_in(F.col(text_col))
    seen = chunks.select("document_id", F.explode(named).alias("u")).select("document_id", "u.kind", "u.n").distinct().withColumn("_seen", F.lit(True))
    return expected.join(seen, ["document_id", "kind", "n"], "left").select("document_id", "kind", "n", F.when(F.col("_seen"), "detected").otherwise("missing").alias("status"))


def numbering_gaps(blocks: DataFrame, titles: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """document_id, kind, n of numbers that the headings themselves skip. units can hand
    over what expected_units gives."""
    observed = (expected_units(blocks, titles) if units is None else units).where("source = 'heading'").select("document_id", "kind", "n")
    up_to = observed.groupBy("document_id", "kind").agg(F.max("n").alias("most")).where("most > 0")
    return up_to.select("document_id", "kind", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("n")).join(observed, ["document_id", "kind", "n"], "left_anti")


def coverage_issues(covered: DataFrame, gaps: DataFrame) -> DataFrame:
    """Issues for missing units (errors) and for gaps (warnings), one for each kind."""
    listed = lambda: F.array_join(F.transform(F.sort_array(F.collect_list("n")), lambda n: n.cast("string")), ", ")
    missing = covered.where("status = 'missing'").groupBy("document_id", "kind").agg(listed().alias("ns")).select("document_id", F.concat("document_id", F.lit("_coverage")).alias("chunk_id"), F.lit("incomplete_coverage").alias("issue_type"), F.lit("error").alias("severity"), F.concat(F.lit("Document incomplete: missing "), "kind", F.lit(" "), "ns").alias("message"))
    skipped = gaps.groupBy("document_id", "kind").agg(listed().alias("ns")).select("document_id", F.concat("document_id", F.lit("_coverage")).alias("chunk_id"), F.lit("numbering_gap").alias("issue_type"), F.lit("warning").alias("severity"), F.concat(F.lit("Source numbering skips "), "kind", F.lit(" "), "ns").alias("message"))
    return missing.unionByName(skipped).withColumn("sample_text", F.lit(""))


def report(chunks: DataFrame, issues: DataFrame, fates: DataFrame) -> DataFrame:
    """One row for each document: chunks, valid and flagged ones, errors, is_valid, blocks
    by fate and inclusion_rate over distinct source blocks."""
    flagged = issues.groupBy("document_id", "chunk_id").agg(F.count_if(F.col("severity") == "error").alias("errors"))
    per_chunk = chunks.select("document_id", "chunk_id").join(flagged, ["document_id", "chunk_id"], "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("errors").isNotNull()).alias("flagged_chunks"))
    errors = issues.groupBy("document_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count(F.lit(1)).alias("n_issues"))
    blocks = fates.groupBy("document_id").agg(*(F.count_if(F.col("fate") == f).alias(f"n_{f}") for f in ("included", "excluded", "held")), F.count(F.lit(1)).alias("total_blocks"))
    joined = blocks.join(per_chunk, "document_id", "left").join(errors, "document_id", "left").na.fill(0, ["total_chunks", "flagged_chunks", "n_errors", "n_issues"])
    return joined.select("*", (F.col("total_chunks") - F.col("flagged_chunks")).alias("valid_chunks"), (F.col("n_errors") == 0).alias("is_valid"), (F.col("n_included") / F.col("total_blocks")).alias("inclusion_rate"))
