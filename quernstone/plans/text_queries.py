"""Queries of filters, deduplication, normalisation, sanitising and quality, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import filters, markup, normalise, personality, quality, sanitise, text, threats
from quernstone.operators import cascade as cascades
from quernstone.operators import dedup, legacy_chunk, secure
from quernstone.plans.recipes import ADVERSARIAL_SQL, PARAGRAPHS_SQL, adversarial, paragraphs, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query under its name, with SQL for the same rows where there is some."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def odd_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", adversarial(F.col("doc_id"), F.col("text")).alias("text"))


# SQL of common parts

def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sentences_sql(x: str, least: int = 1) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda s: {strip_sql('s')}), lambda s: len(s) >= {least})"


def hits_sql(x: str, phrases) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit_sql(p)}) AS INTEGER)" for p in phrases) + ")"


def lit_sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def contained_sql(x: str, phrases, prefix: str = "") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({x}, {lit_sql(p)}) THEN {lit_sql(prefix + p)} END" for p in phrases) + "], lambda v: v IS NOT NULL)"


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit_sql(pattern)}))"


COHERENCE_SQL = f"""(SELECT doc_id, CASE WHEN n < 2 THEN 0.5 ELSE greatest(0.0, 1 - list_sum(list_transform(sizes, lambda x: abs(x - mean))) / n / mean) END AS coherence
  FROM (SELECT doc_id, sizes, len(sizes) AS n, list_sum(sizes) / len(sizes) AS mean
    FROM (SELECT doc_id, list_transform({sentences_sql('text')}, lambda s: CAST(len({words_sql('s')}) AS DOUBLE)) AS sizes FROM documents)))"""
NORM_SQL = r"md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
PII_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {lit_sql(p)}) THEN {lit_sql(k)} END" for k, p in filters.PII_PATTERNS.items()) + "], lambda v: v IS NOT NULL)"


@query(f"""
WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY {NORM_SQL} ORDER BY doc_id) > 1 AS dup, len({PII_SQL}) > 0 AS pii FROM documents)
SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE NOT dup AND NOT pii AND coherence >= 0.5) AS n_kept, count(*) FILTER (WHERE dup) AS n_duplicate, count(*) FILTER (WHERE pii) AS n_pii, round(avg(coherence), 6) AS mean_coherence
FROM d JOIN {COHERENCE_SQL} c USING (doc_id) GROUP BY lang, source""")
def corpus_gate(spark, sf_dir):
    """Duplicates, personal data and coherence of documents, counted by language and source."""
    rows = dedup.exact_duplicates(docs(spark, sf_dir)).select("lang", "source", F.col("is_duplicate").alias("dup"), (F.size(filters.pii_types(F.col("text"))) > 0).alias("pii"), filters.coherence(F.col("text")).alias("coherence"))
    kept = ~F.col("dup") & ~F.col("pii") & (F.col("coherence") >= 0.5)
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("n_kept"), F.count_if("dup").alias("n_duplicate"), F.count_if("pii").alias("n_pii"), F.round(F.avg("coherence"), 6).alias("mean_coherence"))


_LOW = f"lower({strip_sql('text')})"


@query(f"""
SELECT doc_id, length(text) AS length, len(w) AS word_count, len(text) - len(replace(text, '?', '')) AS question_mark_count, len(text) - len(replace(text, '!', '')) AS exclamation_count,
  len(text) - len(replace(text, '.', '')) AS period_count, text <> '' AND upper(text[1]) = text[1] AND lower(text[1]) <> text[1] AS starts_with_capital,
  suffix(text, '?') AS ends_with_question, suffix(text, '.') AS ends_with_period, suffix(text, '!') AS ends_with_exclamation,
  {hits_sql(_LOW, text.QUESTION_WORDS)} > 0 AS has_question_words, {hits_sql(_LOW, text.MODAL_VERBS)} > 0 AS has_modal_verbs, {hits_sql(_LOW, text.IMPERATIVES)} > 0 AS has_imperative_words,
  CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(floor(len(w) * 1.33::DOUBLE) AS BIGINT)) END AS tokens_by_ratio, CAST(floor(len(w) * 0.75::DOUBLE) AS BIGINT) AS tokens_by_words, length(text) // 4 AS tokens_by_chars
FROM (SELECT doc_id, text, {words_sql('text')} AS w FROM documents)""")
def text_features(spark, sf_dir):
    """Twelve features of each document and three token estimates."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", text.features(t).alias("f"), text.tokens_by_ratio(t).alias("tokens_by_ratio"), text.tokens_by_words(t).alias("tokens_by_words"), text.tokens_by_chars(t).alias("tokens_by_chars")).select("doc_id", "f.*", "tokens_by_ratio", "tokens_by_words", "tokens_by_chars")


@query(rf"SELECT doc_id, len({sentences_sql('text')}) AS n_plain, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {strip_sql('s')} <> '')) AS n_capital FROM documents")
def sentence_counts(spark, sf_dir):
    """Sentences by marks alone, and by marks before a capital."""
    return docs(spark, sf_dir).select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_plain"), F.size(text.capital_sentences(F.col("text"))).cast("long").alias("n_capital"))


_GIBBERISH = "list_bool_or(list_transform(list_distinct(regexp_split_to_array(replace(text, chr(10), ''), '')), lambda c: c <> '' AND contains(text, repeat(c, 5))))"
_ISSUES = f"list_concat({contained_sql('lower(text)', filters.SPAM, 'spam:')}, CASE WHEN coalesce({_GIBBERISH}, false) THEN ['gibberish'] ELSE [] END, {contained_sql('lower(text)', filters.INCOMPLETE, 'incomplete:')})"


@query(f"SELECT doc_id, array_to_string({_ISSUES}, ',') AS issues FROM documents")
def quality_issues(spark, sf_dir):
    """Spam phrases, gibberish and incompleteness of each document."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(filters.quality_issues(F.col("text")), ",").alias("issues"))


_LANGUAGE = f"CASE WHEN text = '' THEN 0.0 ELSE least(1.0, {count_sql('text', filters.PLAIN_CHARS.replace(chr(92) + chr(34), chr(34)))} / length(text)) END"
_DOMAIN = f"{hits_sql('lower(text)', filters.DOMAIN_KEYWORDS)} / {len(filters.DOMAIN_KEYWORDS)}"
_SEMANTIC = f"""list_filter([CASE WHEN {_LANGUAGE} < 0.7 THEN 'low_language_score' END, CASE WHEN len({_ISSUES}) > 0 THEN 'quality_issue' END,
  CASE WHEN length({strip_sql('text')}) < 10 THEN 'too_short' END, CASE WHEN length(text) > 8192 THEN 'too_long' END], lambda v: v IS NOT NULL)"""


@query(f"""
SELECT doc_id, round({_LANGUAGE}, 9) AS language_score, round({_DOMAIN}, 9) AS domain_relevance, round(coherence, 9) AS coherence, array_to_string({_SEMANTIC}, ',') AS errors,
  array_to_string(list_filter([CASE WHEN {_DOMAIN} < 0.3 THEN 'low_domain_relevance' END, CASE WHEN coherence < 0.5 THEN 'low_coherence' END], lambda v: v IS NOT NULL), ',') AS warnings
FROM documents JOIN {COHERENCE_SQL} c USING (doc_id)""")
def semantic_filter(spark, sf_dir):
    """Language, domain and coherence scores, errors and warnings of the semantic filter."""
    t = F.col("text")
    rows = docs(spark, sf_dir).select("doc_id", F.round(filters.language_score(t), 9).alias("language_score"), F.round(filters.domain_relevance(t), 9).alias("domain_relevance"), F.round(filters.coherence(t), 9).alias("coherence"), filters.semantic_result(t).alias("r"))
    return rows.select("doc_id", "language_score", "domain_relevance", "coherence", F.array_join("r.errors", ",").alias("errors"), F.array_join("r.warnings", ",").alias("warnings"))


_POLICY = f"list_concat(list_transform({PII_SQL}, lambda k: 'pii:' || k), {contained_sql('lower(text)', filters.LICENSING, 'licence:')})"


@query(f"""
SELECT doc_id, array_to_string({_POLICY}, ',') AS errors,
  array_to_string(list_concat({contained_sql('lower(text)', filters.SENSITIVE, 'sensitive:')}, CASE WHEN (5 - {hits_sql('lower(text)', filters.UNSAFE)}) / 5 < 0.8 THEN ['unsafe'] ELSE [] END), ',') AS warnings,
  round((5 - {hits_sql('lower(text)', filters.UNSAFE)}) / 5, 6) AS safety
FROM {ADVERSARIAL_SQL}""")
def policy_filter(spark, sf_dir):
    """Personal data, licences, sensitive topics and safety of documents with planted numbers."""
    rows = odd_docs(spark, sf_dir).select("doc_id", filters.policy_result(F.col("text")).alias("r"), F.round(filters.content_safety(F.col("text")), 6).alias("safety"))
    return rows.select("doc_id", F.array_join("r.errors", ",").alias("errors"), F.array_join("r.warnings", ",").alias("warnings"), "safety")


@query(f"""
WITH d AS (SELECT doc_id, text, {NORM_SQL} AS h, array_to_string({_SEMANTIC}, ',') AS semantic, array_to_string({_POLICY}, ',') AS policy,
    CASE WHEN strlen(text) < 100 THEN 'too_small' WHEN strlen(text) > 10000000 THEN 'too_large' ELSE '' END AS gate FROM documents),
  f AS (SELECT h, min(doc_id) AS first_id FROM d WHERE gate = '' AND semantic = '' GROUP BY h)
SELECT doc_id, CASE WHEN gate <> '' THEN 'gate' WHEN semantic <> '' THEN 'semantic' WHEN first_id <> doc_id THEN 'dedup' WHEN policy <> '' THEN 'policy' END AS failed_layer,
  CASE WHEN gate <> '' THEN gate WHEN semantic <> '' THEN semantic WHEN first_id <> doc_id THEN 'duplicate' ELSE policy END AS reasons
FROM d LEFT JOIN f USING (h)""")
def filter_cascade(spark, sf_dir):
    """Gate, semantics, duplicates and policy; the first failing layer of each document."""
    return cascades.cascade(docs(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query(f"SELECT doc_id, {NORM_SQL} AS content_hash, min(doc_id) OVER (PARTITION BY {NORM_SQL}) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY {NORM_SQL}) AS is_duplicate FROM documents")
def normalised_dedup(spark, sf_dir):
    """Documents equal after case and white space; the first by id stays."""
    return dedup.exact_duplicates(docs(spark, sf_dir)).select("doc_id", "content_hash", "first_id", "is_duplicate")


@query(rf"""
WITH p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({PARAGRAPHS_SQL}, '\n\s*\n|<\|.*?\|>|###|<\|im_start\|>'), lambda x: {strip_sql('x')}), lambda x: length(x) > 20) AS ps FROM documents)),
  r AS (SELECT doc_id, row_number() OVER (PARTITION BY md5(trim(regexp_replace(lower(p), '\s+', ' ', 'g'))) ORDER BY doc_id, pos) AS k FROM p)
SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (WHERE k > 1) AS n_repeated FROM r GROUP BY doc_id""")
def paragraph_dedup(spark, sf_dir):
    """Paragraphs of each document, and those that occur before."""
    return dedup.duplicate_paragraphs(docs(spark, sf_dir).select("doc_id", paragraphs(F.col("text")).alias("text")))


@query(f"SELECT doc_id, round(n / (n + 100), 9) AS similarity FROM (SELECT doc_id, len(list_distinct({words_sql('lower(text)')})) AS n FROM documents)")
def vocabulary_similarity(spark, sf_dir):
    """The stand-in for a similarity: how rich a document's vocabulary is."""
    return docs(spark, sf_dir).select("doc_id", F.round(dedup.vocabulary_similarity(F.col("text")), 9).alias("similarity"))


_CHARS = "SELECT doc_id, length(text) AS n, unnest(regexp_split_to_array(text, '')) AS c FROM documents WHERE text <> ''"


@query(f"""
SELECT doc_id, round(sum(-(k / n) * log2(k / n)), 6) AS entropy, round(max(k) / max(n), 9) AS top_char_share
FROM (SELECT doc_id, c, count(*) AS k, max(n) AS n FROM ({_CHARS}) WHERE c <> '' GROUP BY doc_id, c) GROUP BY doc_id""")
def char_entropy(spark, sf_dir):
    """Shannon entropy and the share of the most frequent character."""
    return docs(spark, sf_dir).where("text != ''").select("doc_id", F.round(sanitise.entropy(F.col("text")), 6).alias("entropy"), F.round(sanitise.top_char_share(F.col("text")), 9).alias("top_char_share"))


@query(f"""
WITH w AS (SELECT doc_id, {words_sql('lower(text)')} AS ws FROM documents),
  k AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS token FROM w WHERE len(ws) >= 3)
SELECT doc_id, token, count(*) AS n FROM k GROUP BY doc_id, token HAVING count(*) > 3 AND count(*) > max(n) * 0.2""")
def repeated_tokens(spark, sf_dir):
    """Words that are over a fifth of a document."""
    rows = docs(spark, sf_dir).select("doc_id", F.explode(sanitise.repeated_tokens(F.col("text"))).alias("r"))
    return rows.select("doc_id", "r.token", F.col("r.count").cast("long").alias("n"))


def _found_sql(x: str, chars) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({x}, chr({ord(c)})) THEN 'U+{ord(c):04X}' END" for c in chars) + "], lambda v: v IS NOT NULL)"


_CLEAN = "translate(translate(text, " + " || ".join(f"chr({ord(c)})" for c in sanitise.INVISIBLE) + ", ''), " + " || ".join(f"chr({ord(c)})" for c in sanitise.HOMOGLYPHS) + f", '{''.join(sanitise.HOMOGLYPHS.values())}')"


@query(f"""
SELECT doc_id, array_to_string({_found_sql('text', sanitise.INVISIBLE)}, ',') AS invisible, array_to_string({_found_sql('text', sanitise.DIRECTION)}, ',') AS direction,
  array_to_string({_found_sql('text', sanitise.HOMOGLYPHS)}, ',') AS homoglyphs, md5({_CLEAN}) AS clean_md5, contains({_CLEAN}, chr(65533)) AS has_replacement FROM {ADVERSARIAL_SQL}""")
def hidden_characters(spark, sf_dir):
    """Invisible, direction and look-alike characters of planted documents, and the clean text."""
    t = F.col("text")
    clean = sanitise.latin_homoglyphs(sanitise.without_invisible(t))
    return odd_docs(spark, sf_dir).select("doc_id", *(F.array_join(sanitise.found_characters(t, chars), ",").alias(n) for n, chars in (("invisible", sanitise.INVISIBLE), ("direction", sanitise.DIRECTION), ("homoglyphs", sanitise.HOMOGLYPHS))), F.md5(clean).alias("clean_md5"), F.contains(clean, F.lit("\ufffd")).alias("has_replacement"))


_THREATS = f"""list_filter([CASE WHEN len({_found_sql('text', sanitise.INVISIBLE)}) > 0 THEN 'invisible_chars' END, CASE WHEN len({_found_sql('text', sanitise.DIRECTION)}) > 0 THEN 'direction_override' END,
  CASE WHEN len({_found_sql('text', sanitise.HOMOGLYPHS)}) > 0 THEN 'homoglyphs' END, CASE WHEN e.entropy < 2 THEN 'low_entropy' WHEN e.entropy > 7 THEN 'high_entropy' END,
  CASE WHEN {count_sql(_CLEAN, '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} > length({_CLEAN}) * 0.5 OR e.top > 0.3 THEN 'token_pollution' END, CASE WHEN r.doc_id IS NOT NULL THEN 'repeated_tokens' END,
  CASE WHEN contains(text, chr(65533)) THEN 'encoding_corruption' END], lambda v: v IS NOT NULL)"""


@query(f"""
WITH a AS {ADVERSARIAL_SQL}, c AS (SELECT doc_id, {_CLEAN} AS text FROM a),
  e AS (SELECT doc_id, sum(-(k / n) * log2(k / n)) AS entropy, max(k) / max(n) AS top FROM (SELECT doc_id, c, count(*) AS k, max(n) AS n FROM (SELECT doc_id, length(text) AS n, unnest(regexp_split_to_array(text, '')) AS c FROM c WHERE text <> '') WHERE c <> '' GROUP BY doc_id, c) GROUP BY doc_id),
  r AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, w, count(*) AS k, max(n) AS n FROM (SELECT doc_id, len({words_sql('lower(text)')}) AS n, unnest({words_sql('lower(text)')}) AS w FROM c) WHERE n >= 3 GROUP BY doc_id, w) WHERE k > 3 AND k > n * 0.2),
  t AS (SELECT a.doc_id, {_THREATS} AS threats FROM a LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, array_to_string(threats, ',') AS threats, CASE WHEN len(threats) = 0 THEN 'clean' WHEN list_contains(threats, 'direction_override') OR list_contains(threats, 'encoding_corruption') THEN 'dangerous' ELSE 'suspicious' END AS threat_level,
  CASE WHEN len(threats) = 0 THEN 'accept' WHEN list_contains(threats, 'direction_override') OR list_contains(threats, 'encoding_corruption') THEN 'reject' ELSE 'accept_with_warning' END AS action FROM t""")
def sanitise_documents(spark, sf_dir):
    """Threats, level and action of planted documents, without a Unicode normal form."""
    rows = odd_docs(spark, sf_dir).select("doc_id", sanitise.sanitise(F.col("text"), form=None).alias("s"))
    return rows.select("doc_id", F.array_join("s.threats", ",").alias("threats"), "s.threat_level", "s.action")


@query()
def sanitise_nfkc(spark, sf_dir):
    """The same with normal form NFKC, for which neither engine has a function."""
    rows = odd_docs(spark, sf_dir).select("doc_id", sanitise.sanitise(F.col("text")).alias("s"))
    return rows.select("doc_id", F.array_join("s.threats", ",").alias("threats"), "s.threat_level", "s.action", F.md5("s.sanitised_text").alias("clean_md5"))


@query()
def fine_tune_clean(spark, sf_dir):
    """Documents cleaned for fine-tuning, and what was removed."""
    return odd_docs(spark, sf_dir).select("doc_id", normalise.fine_tune_clean(F.col("text")).alias("c")).select("doc_id", F.md5("c.text").alias("text_md5"), "c.removed_control_chars", "c.removed_invisible_chars", "c.removed_noncharacters")


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), 'https?://\S+', '', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g'), '\s+', ' ', 'g'))) AS clean_md5 FROM documents""")
def clean_extracted(spark, sf_dir):
    """Documents on one line without links and addresses."""
    return docs(spark, sf_dir).select("doc_id", F.md5(normalise.clean_extracted(F.col("text"))).alias("clean_md5"))


_P1 = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[ \t\f\x0B\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{2,}', chr(1), 'g')"
_P2 = rf"replace(replace({_P1}, chr(10), ' '), chr(1), chr(10) || chr(10))"
_P3 = rf"regexp_replace(regexp_replace({_P2}, '([.!?])\s*([a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1. \2', 'g')"


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_P3}, '^\d+\.\s*', ''), '^[-*•]\s*', ''), '^>\s*', '')) AS clean_md5 FROM (SELECT doc_id, {PARAGRAPHS_SQL} AS text FROM documents)")
def preprocess_text(spark, sf_dir):
    """Soft line breaks undone, paragraphs kept, sentences parted."""
    return docs(spark, sf_dir).select("doc_id", F.md5(normalise.preprocess(paragraphs(F.col("text")))).alias("clean_md5"))


# Greedy packing only needs sizes: parts that are done, and the one being filled; a piece
# that is too large by itself comes with the sizes of its own parts.
def _packed_sql(pieces: str) -> str:
    step = """CASE WHEN x.now < 0 THEN {'done': list_concat(a.done, CASE WHEN a.now > 0 THEN [a.now] ELSE [] END, x.done), 'now': -1::BIGINT}
      WHEN a.now <= 0 THEN {'done': a.done, 'now': x.now} WHEN a.now + 1 + x.now <= 2000 THEN {'done': a.done, 'now': a.now + 1 + x.now} ELSE {'done': list_append(a.done, a.now), 'now': x.now} END"""
    return f"list_reduce({pieces}, lambda a, x: {step})"


def _parts_of(x: str) -> str:
    return f"list_concat({x}.done, CASE WHEN {x}.now > 0 THEN [{x}.now] ELSE [] END)"


_WORD_SIZES = f"list_transform({words_sql('s')}, lambda w: CASE WHEN strlen(w) > 2000 THEN {{'done': list_transform(range(0, strlen(w), 2000), lambda k: least(2000, strlen(w) - k)), 'now': -1::BIGINT}} ELSE {{'done': []::BIGINT[], 'now': strlen(w)}} END)"


def _fit_sql(x: str) -> str:
    return f"CASE WHEN strlen({x}) <= 2000 THEN strlen({x}) ELSE list_max(list_filter(list_transform(range(500, 2001), lambda k: strlen(substr({x}, 1, k))), lambda n: n <= 2000)) END"


@query(rf"""
WITH d AS (SELECT doc_id, text, {strip_sql('substr(text, 1, 550)')} || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || {strip_sql('right(text, 350)')} AS short FROM documents),
  p AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace({strip_sql('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM d WHERE strlen(text) > 2000)),
  l AS (SELECT doc_id, i, {_packed_sql(_WORD_SIZES)} AS w FROM p WHERE strlen(s) > 2000),
  q AS (SELECT p.doc_id, list(CASE WHEN strlen(s) > 2000 THEN {{'done': {_parts_of('l.w')}, 'now': -1::BIGINT}} ELSE {{'done': []::BIGINT[], 'now': strlen(s)}} END ORDER BY p.i) AS pieces FROM p LEFT JOIN l USING (doc_id, i) GROUP BY p.doc_id),
  r AS (SELECT doc_id, {_parts_of('x')} AS sizes FROM (SELECT doc_id, {_packed_sql('pieces')} AS x FROM q))
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 WHEN strlen(text) <= 2000 THEN 1 ELSE len(sizes) END AS INTEGER) AS n_parts, CAST(CASE WHEN text = '' THEN NULL WHEN strlen(text) <= 2000 THEN strlen(text) ELSE list_max(sizes) END AS INTEGER) AS largest,
  CAST({_fit_sql('text')} AS INTEGER) AS cut_bytes, CAST(CASE WHEN strlen(text) <= 2000 THEN strlen(text) ELSE {_fit_sql('short')} END AS INTEGER) AS clip_bytes FROM d LEFT JOIN r USING (doc_id)""")
def size_parts(spark, sf_dir):
    """Documents in parts of at most 2,000 bytes: split, truncated and clipped."""
    t = F.col("text")
    rows = docs(spark, sf_dir).select("doc_id", normalise.split_to_bytes(t, 2000).alias("parts"), normalise.fit_bytes(t, 2000).alias("cut"), normalise.clip_summary(t, 2000).alias("clip"))
    return rows.select("doc_id", F.size("parts").alias("n_parts"), F.array_max(F.transform("parts", F.octet_length)).alias("largest"), F.octet_length("cut").alias("cut_bytes"), F.octet_length("clip").alias("clip_bytes"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\b([a-zA-Z])\s+([a-zA-Z]{2,})\b', '\1\2', 'g'), '\b([a-zA-Z]{2,})\s+([a-zA-Z])\b', '\1\2', 'g')) AS fixed_md5 FROM documents")
def broken_words(spark, sf_dir):
    """Letters that stand alone joined to their words."""
    return docs(spark, sf_dir).select("doc_id", F.md5(normalise.repair_broken_words(F.col("text"))).alias("fixed_md5"))


def _fs(x: str) -> str:
    return sentences_sql(x, 6)


@query(f"""
WITH d AS (SELECT doc_id, text, lower(text) AS low, {words_sql('lower(text)')} AS ws, {_fs('text')} AS ss FROM documents)
SELECT doc_id, least(100.0, greatest(50.0, 80 + least(15.0, {hits_sql('low', quality.FACTUAL)} * 2.0) - least(20.0, {hits_sql('low', quality.UNCERTAIN)} * 3.0))) AS factuality,
  CASE WHEN len(ss) = 0 OR len(ws) = 0 THEN 0.0 WHEN len(ws) / len(ss) BETWEEN 10 AND 25 THEN 90.0 WHEN len(ws) / len(ss) BETWEEN 5 AND 35 THEN 75.0 ELSE 60.0 END AS readability,
  round(CASE WHEN len(ws) = 0 THEN 0.0 ELSE least(100.0, len(list_distinct(ws)) / len(ws) * 120) END, 6) AS diversity,
  CASE WHEN len(ss) < 2 THEN 70.0 ELSE least(100.0, 70.0 + 5.0 * len(list_filter(range(1, len(ss)), lambda i: list_has_any({words_sql('lower(ss[i])')}, {words_sql('lower(ss[i + 1])')})))) END AS natural_flow,
  round(CASE WHEN len(ss) = 0 THEN 0.0 ELSE least(100.0, 80 + len(list_filter(ss, lambda s: regexp_matches(s, '^\\p{{Lu}}'))) / len(ss) * 20) END, 6) AS grammar
FROM d""".replace("\\\\p", "\\p"))
def fluency_parts(spark, sf_dir):
    """Factuality, readability, diversity, flow and grammar scores."""
    t = F.col("text")
    rows = docs(spark, sf_dir).select("doc_id", quality.factuality(t).alias("factuality"), quality.fluency_parts(t).alias("f"))
    return rows.select("doc_id", "factuality", "f.readability", F.round("f.diversity", 6).alias("diversity"), "f.natural_flow", F.round("f.grammar", 6).alias("grammar"))


def _any_sql(x: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit_sql(p)})" for p in phrases) + ")"


def _hits(x: str, *phrases: str) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit_sql(p)}) AS INTEGER)" for p in phrases) + ")"


_QUALITY = f"""
WITH d AS (SELECT doc_id, text, lower(text) AS low, {strip_sql('text')} AS bare, {words_sql('lower(text)')} AS ws, {_fs('text')} AS ss FROM documents),
  e AS (SELECT *, len(ss) AS n, list_transform(ss, lambda s: {words_sql('lower(s)')}) AS sw FROM d),
  w AS (SELECT doc_id, i, len(u) AS size, unnest(u) AS word FROM (SELECT doc_id, i, list_distinct(x) AS u FROM (SELECT doc_id, unnest(sw) AS x, generate_subscripts(sw, 1) AS i FROM e WHERE n > 1))),
  pairs AS (SELECT x.doc_id, count(*) AS k, max(x.size) + max(y.size) AS sizes FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i GROUP BY x.doc_id, x.i, y.i),
  topics AS (SELECT doc_id, sum(k / (sizes - k)) AS overlap FROM pairs GROUP BY doc_id),
  f AS (SELECT *, CASE WHEN n < 2 THEN 0.5 ELSE coalesce(overlap, 0) / (n * (n - 1) / 2) END AS topic, list_transform(sw, lambda x: len(x)) AS sizes,
      CASE WHEN n < 2 THEN 0 ELSE len(list_filter(range(1, n), lambda i: list_has_any(sw[i], sw[i + 1]))) END AS shared,
      CASE WHEN n < 2 THEN 0 ELSE len(list_filter(range(1, n), lambda i: {_any_sql('substr(lower(ss[i + 1]), 1, 50)', 'because', 'since', 'therefore', 'thus', 'so')})) END AS leads FROM e LEFT JOIN topics USING (doc_id)),
  g AS (SELECT *, list_sum(sizes) / greatest(n, 1) AS mean FROM f),
  h AS (SELECT *, CASE WHEN n < 2 OR mean = 0 THEN 0 ELSE least(15.0, list_sum(list_transform(sizes, lambda x: (x - mean) * (x - mean))) / (n - 1) / mean * 10) END AS penalty FROM g),
  m AS (SELECT doc_id,
    CASE WHEN n < 2 THEN 50.0 ELSE least(100.0, greatest(0.0, 70 + least(20.0, 2 * {_hits('low', 'however', 'therefore', 'furthermore', 'moreover', 'additionally', 'consequently', 'meanwhile', 'subsequently', 'nevertheless', 'thus')})
      + least(10, len(list_filter(ws, lambda v: v IN ('it', 'this', 'that', 'these', 'those', 'they', 'them')))) + topic * 15 + least(1.0, (leads + shared * 0.5) / greatest(1, n - 1)) * 10 - penalty)) END::DOUBLE AS coherence,
    least(100.0, greatest(50.0, 80 + least(15, 2 * {_hits('low', 'is', 'are', 'was', 'were', 'has', 'have', 'will', 'can', 'cannot')}) - least(20, 3 * {_hits('low', 'maybe', 'perhaps', 'possibly', 'might', 'could', 'seems')})))::DOUBLE AS factuality,
    greatest(0, 100 - CASE WHEN contains(text, '<|user|>') THEN 0 ELSE 50 END - CASE WHEN contains(text, '<|assistant|>') THEN 0 ELSE 50 END - CASE WHEN regexp_matches(text, '(?s)<\\|user\\|>\\s*.+?\\s*<\\|assistant\\|>\\s*.') THEN 0 ELSE 30 END)::DOUBLE AS compliance,
    25.0::DOUBLE * (CAST({_any_sql('low', 'in conclusion', 'finally', 'to summarize', 'overall', 'therefore')} AS INTEGER) + CAST(NOT ({_any_sql('low', '...', '[truncated]', 'continued')} OR regexp_matches(low, '\\bmore\\s*$')) AS INTEGER)
      + CAST(regexp_matches(bare, '[.!?]["'')\\]]*$') AS INTEGER) + CAST(length(bare) >= 50 AS INTEGER)) AS completeness,
    0.3::DOUBLE * CASE WHEN n = 0 THEN 0.0 ELSE least(100.0, 80 + len(list_filter(ss, lambda s: regexp_matches(s, '^\\p{{Lu}}'))) / n * 20) END
      + 0.3::DOUBLE * CASE WHEN n = 0 OR len(ws) = 0 THEN 0.0 WHEN len(ws) / n BETWEEN 10 AND 25 THEN 90.0 WHEN len(ws) / n BETWEEN 5 AND 35 THEN 75.0 ELSE 60.0 END
      + 0.2::DOUBLE * CASE WHEN n < 2 THEN 70.0 ELSE least(100.0, 70.0 + 5.0 * shared) END + 0.2::DOUBLE * CASE WHEN len(ws) = 0 THEN 0.0 ELSE least(100.0, len(list_distinct(ws)) / len(ws) * 120) END AS fluency, 75.0::DOUBLE AS relevance FROM h),
  o AS (SELECT *, round(0.15::DOUBLE * coherence + 0.4::DOUBLE * factuality + 0.2::DOUBLE * compliance + 0.1::DOUBLE * completeness + 0.1::DOUBLE * fluency + 0.05::DOUBLE * relevance, 6) AS overall FROM m)
SELECT doc_id, round(coherence, 6) AS coherence, factuality, compliance, completeness, round(fluency, 6) AS fluency, relevance, overall,
  CASE WHEN overall >= 95 THEN 'premium' WHEN overall >= 85 THEN 'standard' WHEN overall >= 70 THEN 'basic' ELSE 'remediation' END AS tier,
  concat_ws(',', CASE WHEN coherence < 75 THEN 'coherence' END, CASE WHEN factuality < 95 THEN 'factuality' END, CASE WHEN compliance < 90 THEN 'compliance' END, CASE WHEN completeness < 80 THEN 'completeness' END, CASE WHEN fluency < 75 THEN 'fluency' END) AS shortfalls,
  CASE WHEN overall < 70 THEN 'remediate' ELSE 'accept' END AS route FROM o"""


@query(_QUALITY)
def quality_scores(spark, sf_dir):
    """All six metrics, the overall score, its tier and what falls short."""
    rows = docs(spark, sf_dir).select("doc_id", quality.scored(F.col("text"), "qwen").alias("s")).select("doc_id", "s.*")
    return rows.withColumns({x: F.round(x, 6) for x in ("coherence", "fluency", "overall")}).withColumn("shortfalls", F.array_join("shortfalls", ","))


RULES_SQL = f"""(SELECT doc_id, accuracy, fluency, 50.0 AS personality_depth, coherence, ready AS training_readiness, (accuracy + fluency + 50 + coherence + ready) / 5 AS overall FROM (
  SELECT doc_id, least(100.0, greatest(0.0, 70 + (w - 50) * 0.1::DOUBLE)) AS accuracy, least(100.0, greatest(0.0, 60.0 + s * 2)) AS fluency, least(100.0, greatest(0.0, 65.0 + (s - 3) * 3)) AS coherence, CASE WHEN w BETWEEN 20 AND 200 THEN 70.0 ELSE 40.0 END AS ready FROM (
  SELECT doc_id, len({words_sql('text')}) AS w, len(list_filter(string_split(text, '.'), lambda x: {strip_sql('x')} <> '')) AS s FROM documents)))"""
TIER_SQL = "CASE WHEN overall >= 95 THEN 'premium' WHEN overall >= 85 THEN 'standard' WHEN overall >= 70 THEN 'basic' ELSE 'remediation' END"


def _rules(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", quality.rule_scores(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"SELECT doc_id, round(accuracy, 6) AS accuracy, round(fluency, 6) AS fluency, round(personality_depth, 6) AS personality_depth, round(coherence, 6) AS coherence, round(training_readiness, 6) AS training_readiness, round(overall, 6) AS overall, {TIER_SQL} AS tier FROM {RULES_SQL}")
def rule_quality(spark, sf_dir):
    """Scores by counts of words and sentences."""
    rows = _rules(spark, sf_dir)
    return rows.select("doc_id", *(F.round(c, 6).alias(c) for c in rows.columns[1:]), quality.tier(F.col("overall")).alias("tier"))


@query(rf"""
SELECT doc_id, round(greatest(0.0, 1 - 0.1 * (g1 + g2 + g3)), 6) AS grammar, round(CASE WHEN w / n BETWEEN 10 AND 20 THEN 1.0 WHEN w / n BETWEEN 5 AND 30 THEN 0.8 ELSE 0.5 END, 6) AS clarity,
  round(CASE WHEN w = 0 THEN 0.0 ELSE (CAST(ended AS DOUBLE) + least(1.0, w / 20)) / 2 END, 6) AS completeness, round(CASE WHEN k >= 3 THEN 1.0 WHEN k = 2 THEN 0.8 WHEN k = 1 THEN 0.6 ELSE 0.0 END, 6) AS structure
FROM (SELECT doc_id, {count_sql('text', chr(92) + 's{2,}')} AS g1, {count_sql('text', chr(92) + 's[,.!?]')} AS g2, {count_sql('text', chr(92) + 'bi' + chr(92) + 'b')} AS g3, len({words_sql('text')}) AS w, len({sentences_sql('text')}) AS k, greatest(1, len({sentences_sql('text')})) AS n, regexp_matches({strip_sql('text')}, '[.!?]$') AS ended FROM documents)""")
def text_quality(spark, sf_dir):
    """Grammar, clarity, completeness and structure of texts."""
    rows = docs(spark, sf_dir).select("doc_id", quality.text_quality(F.col("text")).alias("q"))
    return rows.select("doc_id", *(F.round(f"q.{c}", 6).alias(c) for c in ("grammar", "clarity", "completeness", "structure")))


_WORD = r"(?:^|\W)"


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\bdo not\b', 'don''t', 'gi'), '\bcannot\b', 'can''t', 'gi'), '\bwill not\b', 'won''t', 'gi')) AS casual_md5,
  md5(regexp_replace(regexp_replace(regexp_replace(t, '\bdon''t\b', 'do not', 'gi'), '\bcan''t\b', 'cannot', 'gi'), '\bwon''t\b', 'will not', 'gi')) AS formal_md5,
  md5(replace(replace(replace(replace(t, 'do not', 'don''t'), 'cannot', 'can''t'), 'It is', 'It''s'), 'You are', 'You''re')) AS literal_md5
FROM (SELECT doc_id, text || ' I do not know and cannot say; It is late. I don''t mind.' AS t FROM documents)""")
def voices(spark, sf_dir):
    """Documents in a casual and a formal voice, by rules and by literal replacement."""
    t = F.concat("text", F.lit(" I do not know and cannot say; It is late. I don't mind."))
    return docs(spark, sf_dir).select("doc_id", F.md5(personality.rewrite(t, F.lit("casual"))).alias("casual_md5"), F.md5(personality.rewrite(t, F.lit("professional"))).alias("formal_md5"), F.md5(personality.literal_rewrite(t, F.lit("casual"))).alias("literal_md5"))


def _matches_any(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {lit_sql('(?i)' + p)})" for p in patterns) + ")"


@query(f"""
SELECT doc_id, NOT {_matches_any('text', personality.PLACEHOLDERS)} AS no_placeholders, NOT {_matches_any('text', personality.UNFINISHED)} AND length({strip_sql('text')}) >= 100 AND len({sentences_sql('text', 11)}) >= 2 AS complete,
  NOT ({hits_sql('lower(text)', personality.FORMAL_WORDS)} > 0 AND {hits_sql('lower(text)', personality.CASUAL_WORDS)} > 0) AS consistent, {hits_sql('lower(text)', personality.DEPTH_WORDS)} >= 5 AS deep FROM documents""")
def weakness_checks(spark, sf_dir):
    """Placeholders, completeness, tone and depth of documents."""
    rows = docs(spark, sf_dir).select("doc_id", personality.weakness_report(F.col("text"), F.lit(True)).alias("w"))
    return rows.select("doc_id", "w.no_placeholders", "w.complete", "w.consistent", "w.deep")


def _domain_counts(name: str) -> str:
    return f"{hits_sql('lower(text)', legacy_chunk.SYMBOL_DOMAINS[name])} / {len(legacy_chunk.SYMBOL_DOMAINS[name])}"


@query("SELECT doc_id, " + ", ".join(f"round({_domain_counts(d)}, 9) AS {d}" for d in legacy_chunk.SYMBOL_DOMAINS) + ", " + ", ".join(f"{count_sql('lower(text)', p.replace('(', '(?:', 1))} AS {k}" for k, p in legacy_chunk.COMPLEXITY.items()) + " FROM documents")
def symbolic_analysis(spark, sf_dir):
    """Shares of symbolic domains' keywords and counts of complexity patterns."""
    rows = docs(spark, sf_dir).select("doc_id", legacy_chunk.symbolic_analysis(F.col("text")).alias("a"))
    value = lambda part, k: F.coalesce(F.try_element_at(F.col(f"a.{part}"), F.lit(k)), F.lit(0))
    return rows.select("doc_id", *(F.round(value("domains", d).cast("double"), 9).alias(d) for d in legacy_chunk.SYMBOL_DOMAINS), *(value("complexity", k).cast("long").alias(k) for k in legacy_chunk.COMPLEXITY))


@query("SELECT page_id, " + ", ".join(f"{count_sql('html', '(?i)<' + t + '[^>]*>')} AS tag_{t}" for t in markup.TAGS) + ", " + ", ".join(f"{count_sql('html', '(?i)' + a + chr(92) + 's*=')} AS attribute_{a}" for a in markup.ATTRIBUTES) + f", {count_sql('html', '<[a-zA-Z][^>]*>')} AS open_tags, {count_sql('html', '</[a-zA-Z][^>]*>')} AS close_tags, array_to_string({contained_sql('lower(html)', markup.URL_SCHEMES)}, ',') AS urls, (" + " + ".join(f"CAST(regexp_matches(html, {lit_sql('(?is)' + p)}) AS INTEGER)" for p in markup.INJECTIONS) + ") AS n_injections FROM pages")
def html_validation(spark, sf_dir):
    """Risky tags, attributes, injections and URLs of pages."""
    rows = table(spark, sf_dir, "pages").select("page_id", markup.html_result(F.col("html")).alias("r"))
    n = lambda part, k: F.coalesce(F.try_element_at(F.col(f"r.{part}"), F.lit(k)), F.lit(0)).cast("long")
    return rows.select("page_id", *(n("dangerous_tags", t).alias(f"tag_{t}") for t in markup.TAGS), *(n("dangerous_attributes", a).alias(f"attribute_{a}") for a in markup.ATTRIBUTES), F.col("r.open_tags").cast("long").alias("open_tags"), F.col("r.close_tags").cast("long").alias("close_tags"), F.array_join("r.suspicious_urls", ",").alias("urls"), F.size("r.injections").alias("n_injections"))


@query(r"""
WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][^\s>]*)[^>]*>', 1))) AS tag, 1 AS k FROM pages UNION ALL SELECT page_id, lower(unnest(regexp_extract_all(html, '</([a-zA-Z][^>]*)>', 1))), -1 FROM pages)
SELECT page_id, tag, CAST(sum(k) AS INTEGER) AS balance FROM t GROUP BY page_id, tag HAVING sum(k) <> 0""")
def unbalanced_tags(spark, sf_dir):
    """Tags of pages that open and close unequally often."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(markup.unbalanced_tags(F.col("html"))).alias("u")).select("page_id", "u.tag", "u.balance")


@query(r"""
SELECT event_id, true AS is_valid, '' AS issues, len(regexp_extract_all(broken, '"')) % 2 <> 0 AS odd_quotes, len(regexp_extract_all(broken, '\{')) <> len(regexp_extract_all(broken, '\}')) AS odd_braces FROM (SELECT event_id, substr(props, 1, length(props) - 1) AS broken FROM events)""")
def json_validation(spark, sf_dir):
    """Properties of events as JSON, and what is found wrong once their last brace is gone."""
    rows = table(spark, sf_dir, "events").select("event_id", markup.json_result(F.col("props")).alias("r"), markup.json_issues(F.expr("left(props, length(props) - 1)")).alias("issues_cut"))
    return rows.select("event_id", "r.is_valid", F.array_join("r.issues", ",").alias("issues"), F.array_contains("issues_cut", "unbalanced_quotes").alias("odd_quotes"), F.array_contains("issues_cut", "unbalanced_braces").alias("odd_braces"))


@query()
def markup_kinds(spark, sf_dir):
    """Which validators pages go to, and what the Markdown, code and XML ones find."""
    h = F.col("html")
    language = markup.code_language(h)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(markup.markup_kinds(h), ",").alias("kinds"), markup.markdown_result(h)["links"].alias("links"), language.alias("language"), F.size(markup.code_errors(h, language)).alias("n_code_errors"), markup.xml_result(h)["is_valid"].alias("is_xml"))


_LETTERS = ("аαɑａ", "еεｅ", "оοｏ", "рρｐ", "сϲｃ", "хχｘ", "уγｙ", "іιｉ", "пηｎ", "мμｍ", "һηｈ", "кκｋ", "вβｂ", "тτｔ", "гρｒ", "ѕσｓ")
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Han", "Hebrew", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari")
# RE2 has no back references: what is repeated is looked for by itself
_GRAMS = lambda n: f"list_distinct(list_transform(range(1, length(text) - {n - 2}), lambda i: substr(text, i, {n})))"
_RUN_OF = lambda n: f"len(list_filter({_GRAMS(n)}, lambda g: length(g) = {n} AND NOT contains(g, chr(10)) AND contains(text, repeat(g, 21)))) > 0"
_WORDY = "0-9A-Z_a-zªµºÀ-ÖØ-öø-ˁͰ-ϿЀ-ԯ"
_TRIPLES = rf"""len(list_filter(range(1, len(tokens) - 1), lambda i: regexp_full_match(tokens[i + 1], '\w+') AND suffix(tokens[i], tokens[i + 1]) AND starts_with(tokens[i + 2], tokens[i + 1])
  AND NOT regexp_matches(right(left(tokens[i], length(tokens[i]) - length(tokens[i + 1])), 1), '[{_WORDY}]') AND NOT regexp_matches(substr(tokens[i + 2], length(tokens[i + 1]) + 1, 1), '[{_WORDY}]'))) > 0"""
_NAMED = {
    "leetspeak": rf"regexp_matches(regexp_replace(text, '[ªµºÀ-ÖØ-öø-ˁͰ-ϿЀ-ԯ]', '_', 'g'), '\b[a-z]*[0-9]+[a-z]*[0-9]+[a-z]*\b')",
    "zalgo_text": r"regexp_matches(text, '[\x{0300}-\x{036F}]{3,}')",
    "fullwidth": r"regexp_matches(text, '[\x{FF00}-\x{FFEF}]{5,}')",
    "enclosed": r"regexp_matches(text, '[\x{2460}-\x{24FF}]{3,}')",
    "mathematical": r"regexp_matches(text, '[\x{1D400}-\x{1D7FF}]{5,}')",
    "variation_selectors": r"regexp_matches(text, '[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]')",
    "char_run": "len(list_filter(list_distinct(regexp_split_to_array(text, '')), lambda c: c <> '' AND c <> chr(10) AND contains(text, repeat(c, 11)))) > 0",
    "word_run": _TRIPLES,
    "non_ascii_run": r"regexp_matches(text, '[^\x00-\x7F]{20,}')",
    "punctuation_run": r"regexp_matches(text, '[\x{2000}-\x{206F}]{3,}')",
    "dingbat_run": r"regexp_matches(text, '[\x{2700}-\x{27BF}]{5,}')",
    "emoji_run": r"regexp_matches(text, '[\x{1F600}-\x{1F64F}]{10,}')",
    "capital_run": "regexp_matches(text, '[A-Z]{50,}')",
    "digit_run": r"regexp_matches(text, '\d{100,}')",
    "symbol_run": "regexp_matches(text, '[!@#$%^&*()]{20,}')",
    "pattern_run": f"({_RUN_OF(1)} OR {_RUN_OF(2)} OR {_RUN_OF(3)})",
}
_MIXTURES = (
    r"CASE WHEN letters > 0 AND len(regexp_extract_all(text, '\p{Latin}')) / letters > 0.1 AND len(regexp_extract_all(text, '\p{Cyrillic}')) / letters > 0.1 THEN 1 ELSE 0 END",
    r"CAST(regexp_matches(text, '[\x{0400}-\x{04FF}].*[a-zA-Z]|[a-zA-Z].*[\x{0400}-\x{04FF}]') AS INTEGER)",
    r"CAST(regexp_matches(text, '[\x{0600}-\x{06FF}].*[a-zA-Z]|[a-zA-Z].*[\x{0600}-\x{06FF}]') AS INTEGER)",
    r"CAST(regexp_matches(text, '[\x{4E00}-\x{9FFF}].*[a-zA-Z]|[a-zA-Z].*[\x{4E00}-\x{9FFF}]') AS INTEGER)",
    r"CAST(regexp_matches(text, '[\x{E0}-\x{F6}\x{F8}-\x{FD}\x{FE}\x{FF}]{10,}') AS INTEGER)",
)


@query(rf"""
WITH a AS (SELECT doc_id, text, {words_sql('text')} AS tokens, len(regexp_extract_all(text, '\p{{L}}')) AS letters FROM {ADVERSARIAL_SQL}),
  k AS (SELECT doc_id, count(*) FILTER (WHERE n > 0.2 * size) AS outliers FROM (SELECT doc_id, c, count(*) AS n, max(size) AS size FROM (SELECT doc_id, length(text) AS size, unnest(regexp_split_to_array(text, '')) AS c FROM a) WHERE c <> '' GROUP BY doc_id, c) GROUP BY doc_id),
  w AS (SELECT doc_id, place, unnest(regexp_split_to_array(substr(text, place + 1, 50), '')) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text) - 49, 25)) AS place FROM a)),
  e AS (SELECT doc_id, place, sum(-(n / 50) * log2(n / 50)) AS bits FROM (SELECT doc_id, place, c, count(*) AS n FROM w WHERE c <> '' GROUP BY ALL) GROUP BY doc_id, place),
  v AS (SELECT doc_id, CASE WHEN count(*) > 1 THEN var_samp(bits) ELSE 0 END > 2 AS high, min(bits) < 1 AS low, max(bits) > 6 AS top FROM e GROUP BY doc_id),
  f AS (SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _NAMED.items())}) AS patterns,
    concat_ws(',', CASE WHEN regexp_matches(text, '[ \t]{{2,}}') THEN 'unusual_whitespace' END, CASE WHEN regexp_matches(text, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]') THEN 'zero_width_chars' END) AS hidden,
    least(20.0, ({' + '.join(f"len(regexp_extract_all(text, '[{x}]'))" for x in _LETTERS)}) / greatest(1, length(text)) * 50) AS alike,
    CASE WHEN {' + '.join(f"CAST(regexp_matches(text, '{chr(92)}p{{{x}}}') AS INTEGER)" for x in _SCRIPTS)} > 1 THEN {' + '.join(_MIXTURES)} ELSE 0 END AS mixtures FROM a),
  s AS (SELECT doc_id, patterns, hidden, round(least(100.0, alike + mixtures * 10 + coalesce(outliers, 0) * 5 + len(list_filter(string_split(patterns, ','), lambda x: x <> '')) * 15
    + CASE WHEN high THEN 10 ELSE 0 END + CASE WHEN low THEN 15 ELSE 0 END + CASE WHEN top THEN 10 ELSE 0 END + len(list_filter(string_split(hidden, ','), lambda x: x <> '')) * 8)::DOUBLE, 6) AS score FROM f LEFT JOIN k USING (doc_id) LEFT JOIN v USING (doc_id))
SELECT doc_id, score, patterns, hidden, CASE WHEN score < 10 THEN 'low' WHEN score < 30 THEN 'medium' WHEN score < 60 THEN 'high' ELSE 'critical' END AS rank FROM s""")
def threat_scores(spark, sf_dir):
    """Threat score and rank of planted documents."""
    rows = odd_docs(spark, sf_dir).select("doc_id", threats.threat_score(F.col("text"), forms=False).alias("score"), F.array_join(threats.adversarial_patterns(F.col("text")), ",").alias("patterns"), F.array_join(threats.hidden_writing(F.col("text"), forms=False), ",").alias("hidden"))
    return rows.withColumn("rank", threats.threat_rank(F.col("score"))).withColumn("score", F.round("score", 6))


@query()
def secure_documents(spark, sf_dir):
    """Planted documents through sanitiser, detectors and markup to a final action."""
    rows = secure.secure(odd_docs(spark, sf_dir), form=None)
    return rows.select("doc_id", "threat_level", F.round("threat_score", 6).alias("threat_score"), F.array_join("markup", ",").alias("markup"), "action", F.md5("sanitised_text").alias("text_md5"))


def typed(sql: str, kind: str, *columns: str) -> str:
    """The same rows with the columns cast: DuckDB takes numbers with a point as decimals."""
    casts = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


ORACLES["fluency_parts"] = typed(ORACLES["fluency_parts"], "DOUBLE", "factuality", "natural_flow", "readability")
ORACLES["rule_quality"] = typed(ORACLES["rule_quality"], "DOUBLE", "personality_depth", "training_readiness", "coherence", "fluency")
ORACLES["text_quality"] = typed(ORACLES["text_quality"], "DOUBLE", "clarity", "structure", "grammar")
