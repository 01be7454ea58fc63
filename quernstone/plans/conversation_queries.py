"""Queries of conversations: classifying, rendering, parsing and converting, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import formats, text
from quernstone.operators import conversation, legacy_chunk
from quernstone.plans.recipes import ASKED_SQL, asked, paragraphs, table
from quernstone.plans.text_queries import hits_sql, lit_sql, strip_sql, words_sql
from quernstone.sources import readers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


_LOW = f"lower({strip_sql('text')})"
_QUESTION = f"least(10, CASE WHEN suffix(text, '?') THEN 8 ELSE 0 END + CASE WHEN {hits_sql(_LOW, text.QUESTION_WORDS)} > 0 THEN 3 ELSE 0 END + CASE WHEN {hits_sql(_LOW, text.MODAL_VERBS)} > 0 THEN 2 ELSE 0 END + CASE WHEN {hits_sql(_LOW, text.IMPERATIVES)} > 0 THEN 2 ELSE 0 END + CASE WHEN len({words_sql('text')}) < 20 THEN 1 ELSE 0 END)"
_STARTS = " OR ".join(f"starts_with({_LOW}, {lit_sql(s)})" for s in text.ANSWER_STARTS)
_ANSWER = f"least(10, CASE WHEN suffix(text, '.') THEN 4 ELSE 0 END + CASE WHEN {_STARTS} THEN 4 ELSE 0 END + CASE WHEN {hits_sql(_LOW, text.ANSWER_PHRASES)} > 0 THEN 2 ELSE 0 END + CASE WHEN len({words_sql('text')}) > 15 THEN 2 ELSE 0 END + CASE WHEN length(text) - length(replace(text, '.', '')) > 1 THEN 1 ELSE 0 END)"


def _patterns(patterns) -> str:
    return "least(10, 2 * (" + " + ".join(f"CAST(regexp_matches({_LOW}, {lit_sql(p)}) AS INTEGER)" for p in patterns) + "))"


CLASSIFIED_SQL = f"""(WITH s AS (SELECT conv_id, turn, text, {_QUESTION} AS q, {_ANSWER} AS a, {_patterns(text.QUESTION_PATTERNS)} AS pq, {_patterns(text.ANSWER_PATTERNS)} AS pa, suffix({strip_sql('text')}, '?') AS asks FROM {ASKED_SQL}),
  l AS (SELECT *, lag(asks OR q > a) OVER (PARTITION BY conv_id ORDER BY turn) AS after_user FROM s),
  f AS (SELECT *, q * 7 + pq * 3 + CASE WHEN NOT after_user THEN 20 ELSE 0 END + CASE WHEN asks THEN 50 ELSE 0 END AS ask, a * 7 + pa * 3 + CASE WHEN after_user THEN 30 ELSE 0 END AS tell FROM l)
  SELECT conv_id, turn, text, CASE WHEN ask > tell AND ask > 40 THEN 'user' WHEN tell > 30 THEN 'assistant' WHEN after_user THEN 'assistant' ELSE 'user' END AS role FROM f)"""


@query(f"SELECT conv_id, turn, role FROM {CLASSIFIED_SQL}")
def classify_turns(spark, sf_dir):
    """Roles of turns by scores, patterns and the turn before."""
    return conversation.classify_segments(asked(turns(spark, sf_dir)), "conv_id", "turn").select("conv_id", "turn", "role")


@query(f"SELECT conv_id, turn, {_QUESTION} / 10 AS question_score, {_ANSWER} / 10 AS answer_score, CASE WHEN {_QUESTION} > {_ANSWER} THEN 'user' ELSE 'assistant' END AS rule_role, round(least(0.95, greatest(0.1, abs({_QUESTION} / 10 - {_ANSWER} / 10))), 6) AS confidence FROM {ASKED_SQL}")
def segment_scores(spark, sf_dir):
    """Question and answer scores of turns, the role they give, and how sure it is."""
    t = F.col("text")
    return asked(turns(spark, sf_dir)).select("conv_id", "turn", text.question_score(t).alias("question_score"), text.answer_score(t).alias("answer_score"), conversation.rule_role(t).alias("rule_role"), F.round(conversation.rule_confidence(t), 6).alias("confidence"))


@query("SELECT conv_id, turn, count(*) OVER w AS n_context, md5(coalesce(string_agg(text, chr(10)) OVER w, '')) AS context_md5 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def context_windows(spark, sf_dir):
    """The five turns before each turn."""
    rows = conversation.context_window(turns(spark, sf_dir), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.size("context").cast("long").alias("n_context"), F.md5(F.array_join("context", "\n")).alias("context_md5"))


def _joined(line: str, separator: str) -> str:
    return f"SELECT conv_id, string_agg({line}, {separator} ORDER BY turn) AS formatted FROM conversations GROUP BY conv_id"


_NL, _NL2 = "chr(10)", "chr(10) || chr(10)"
# each answer with the user turn before it, if no answer came between
_PAIRS = """(SELECT conv_id, turn, q, text AS a FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER b AS asked_at, max(CASE WHEN role = 'assistant' THEN turn END) OVER b AS answered,
    last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER b AS q FROM conversations WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE role = 'assistant' AND asked_at IS NOT NULL AND (answered IS NULL OR answered < asked_at) AND q <> '')"""


def _paired(line: str, separator: str) -> str:
    return f"SELECT conv_id, coalesce(formatted, '') AS formatted FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, string_agg({line}, {separator} ORDER BY turn) AS formatted FROM {_PAIRS} GROUP BY conv_id) USING (conv_id)"


_JSON = "SELECT conv_id, {0} || string_agg(to_json({{'role': role, 'content': text}})::VARCHAR, ',' ORDER BY turn) || ']' AS formatted FROM conversations GROUP BY conv_id"
_RENDER_SQL = {
    "qwen": _joined("'<|' || role || '|> ' || text", _NL2),
    "alpaca": _paired(f"'### Instruction:' || {_NL} || q || {_NL2} || '### Response:' || {_NL} || a", f"{_NL2} || '---' || {_NL2}"),
    "chatml": _joined(f"'<|im_start|>' || role || {_NL} || text || {_NL} || '<|im_end|>'", _NL),
    "sharegpt": _JSON.format("'['"),
    "llama2": _paired("'<s>[INST] ' || q || ' [/INST] ' || a || ' </s>'", "' '"),
    "zephyr": _joined(f"'- role: ' || role || {_NL} || '  content: ' || text", _NL),
    "instruct": _paired(f"'Question: ' || q || {_NL} || 'Answer: ' || a", _NL2),
    "openai": _JSON.format("""'[{"role":"system","content":"You are a helpful assistant."},'"""),
    "claude": _joined("CASE WHEN role = 'user' THEN 'Human' ELSE 'Assistant' END || ': ' || text", _NL2),
    "minimalist": _joined("CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text", _NL),
}


def _render(target: str):
    def run(spark, sf_dir):
        return conversation.render_conversations(turns(spark, sf_dir), target)

    run.__name__, run.__doc__ = f"render_{target}", f"Conversations in {target} format."
    return run


for _target in formats.FORMATS:
    query(_RENDER_SQL[_target])(_render(_target))

# the parsers' roles are user and assistant; what they drop is not in the text they read
_KEPT = "(SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"


# one of these formats has no place for a system's turns, and writes them as an assistant's
_READ_BACK = {t: _KEPT for t in ("qwen", "chatml", "sharegpt")} | {"claude": "(SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role FROM conversations)"}


@query(" UNION ALL ".join(f"SELECT conv_id, '{t}' AS source, count(*) AS n_segments, md5(string_agg(role || '|' || {strip_sql('text')}, {_NL2} ORDER BY turn)) AS segments_md5 FROM {kept} GROUP BY conv_id" for t, kept in _READ_BACK.items()))
def parse_roundtrip(spark, sf_dir):
    """Conversations rendered, then parsed again; most parsers leave out a system's turns."""
    rows = conversation.conversations(turns(spark, sf_dir))
    out = None
    for target in ("qwen", "chatml", "sharegpt", "claude"):
        parsed = rows.select("conv_id", formats.parse(formats.render(F.col("segments"), target), target).alias("p"))
        lines = F.array_join(F.transform("p", lambda x: F.concat(x["role"], F.lit("|"), text.strip(x["content"]))), "\n\n")
        part = parsed.select("conv_id", F.lit(target).alias("source"), F.size("p").cast("long").alias("n_segments"), F.md5(lines).alias("segments_md5"))
        out = part if out is None else out.unionByName(part)
    return out


_FOR_DETECTION = ("qwen", "alpaca", "chatml", "sharegpt", "llama2", "claude", "minimalist")


def _detect_sql(x: str) -> str:
    head = f"substr({x}, 1, 1000)"
    has = lambda *marks: " AND ".join(f"contains({head}, {lit_sql(m)})" for m in marks)
    return f"""CASE WHEN {has('<|user|>')} OR {has('<|assistant|>')} THEN 'qwen' WHEN {has('<|im_start|>', '<|im_end|>')} THEN 'chatml' WHEN {has('[INST]', '[/INST]')} THEN 'llama2' WHEN {has('### Instruction:', '### Response:')} THEN 'alpaca'
      WHEN {has('Human:', 'Assistant:')} THEN 'claude' WHEN {has('User:', 'Assistant:')} THEN 'minimalist' WHEN regexp_matches({head}, '^\\s*[\\[{{]') AND json_valid({x}) THEN 'sharegpt' END"""


@query(" UNION ALL ".join(f"SELECT conv_id, '{t}' AS rendered, {_detect_sql('formatted')} AS detected FROM ({_RENDER_SQL[t]})" for t in _FOR_DETECTION))
def detect_formats(spark, sf_dir):
    """Which format rendered conversations are found to be in."""
    rows = conversation.conversations(turns(spark, sf_dir))
    out = None
    for target in _FOR_DETECTION:
        part = rows.select("conv_id", F.lit(target).alias("rendered"), formats.detect(formats.render(F.col("segments"), target)).alias("detected"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT conv_id, string_agg('<|im_start|>' || role || {_NL} || {strip_sql('text')} || {_NL} || '<|im_end|>', {_NL} ORDER BY turn) AS converted FROM {_KEPT} GROUP BY conv_id")
def convert_qwen_to_chatml(spark, sf_dir):
    """Conversations converted from one format to another by what is detected."""
    rows = conversation.conversations(turns(spark, sf_dir))
    return rows.select("conv_id", formats.convert(formats.render(F.col("segments"), "qwen"), "chatml")["text"].alias("converted"))


@query("SELECT target, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok FROM (" + " UNION ALL ".join("SELECT '{}' AS target, {} AS ok FROM ({})".format(t, " AND ".join(f"contains(formatted, {lit_sql(m)})" for m in formats.PROTOCOLS[t][2]), _RENDER_SQL[formats.PROTOCOLS[t][0]]) for t in ("qwen", "llama2", "alpaca", "chatml", "instruct", "claude", "zephyr", "minimalist", "mistral", "gemma")) + ") GROUP BY target")
def protocol_markers(spark, sf_dir):
    """How many conversations have the markers that each training target needs."""
    rows = conversation.conversations(turns(spark, sf_dir))
    names = ("qwen", "llama2", "alpaca", "chatml", "instruct", "claude", "zephyr", "minimalist", "mistral", "gemma")
    checks = F.array(*(F.struct(F.lit(t).alias("target"), formats.has_markers(formats.render(F.col("segments"), formats.protocol(t)[0]), t).alias("ok")) for t in names))
    return rows.select(F.explode(checks).alias("c")).groupBy("c.target").agg(F.count(F.lit(1)).alias("n"), F.count_if("c.ok").alias("n_ok"))


@query(f"SELECT conv_id, count(*) AS n_pairs, md5(string_agg('<|user|>' || {_NL} || q || {_NL} || '<|assistant|>' || {_NL} || a, {_NL} ORDER BY turn)) AS formatted_md5 FROM {_PAIRS} GROUP BY conv_id")
def multi_turn(spark, sf_dir):
    """Questions with their answers in multi-turn writing."""
    rows = conversation.conversations(turns(spark, sf_dir)).select("conv_id", formats.pairs(F.col("segments")).alias("p")).where(F.size("p") > 0)
    return rows.select("conv_id", F.size("p").cast("long").alias("n_pairs"), F.md5(formats.render_multi(F.col("p"), "qwen")).alias("formatted_md5"))


@query(rf"""
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, s AS text FROM (SELECT conv_id, turn, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT conv_id, turn,
  list_filter(list_transform(flatten(list_transform(string_split(text, chr(10) || chr(10)), lambda p: string_split(regexp_replace({strip_sql('p')}, '\?\s+([A-Z])', '?' || chr(1) || '\1', 'g'), chr(1)))), lambda x: {strip_sql('x')}), lambda x: length(x) >= 10) AS ss
  FROM (SELECT conv_id, turn, replace(text, '. ', '? ') AS text FROM conversations)))""")
def split_segments(spark, sf_dir):
    """Turns split at paragraphs and after question marks."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(text.segments(F.replace("text", F.lit(". "), F.lit("? ")))).alias("pos", "text"))
    return rows.select("conv_id", "turn", "pos", "text")


@query()
def document_conversations(spark, sf_dir):
    """Documents split, classified and rendered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", paragraphs(F.col("text")).alias("text"))
    rows = conversation.documents_to_conversations(docs)
    return rows.select("doc_id", F.size("segments").alias("n_segments"), F.md5("formatted").alias("formatted_md5"))


@query(f"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, q AS question, a AS answer FROM (
  SELECT conv_id, turn, {strip_sql('text')} AS q, {strip_sql('next')} AS a FROM (SELECT *, lead(text) OVER w AS next, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant') WHERE q <> '' AND a <> ''""")
def question_answer_pairs(spark, sf_dir):
    """All users' turns and the answers to them, read back from "Q: A:" text."""
    after = "OVER (PARTITION BY conv_id ORDER BY turn)"
    rows = turns(spark, sf_dir).withColumn("next", F.expr(f"lead(text) {after}")).withColumn("next_role", F.expr(f"lead(role) {after}"))
    asked_and_told = rows.where("role = 'user' and next_role = 'assistant'").withColumn("pair", F.concat(F.lit("Q: "), "text", F.lit("\nA: "), "next"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "pair"))), lambda x: x["pair"])
    written = asked_and_told.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("text"))
    return written.select("conv_id", F.posexplode(readers.qa_pairs(F.col("text"))).alias("pos", "p")).select("conv_id", "pos", "p.question", "p.answer")


@query(r"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, 'Please explain the following information:' AS question, p AS answer FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(CASE WHEN len(a) > 1 THEN a ELSE b END, lambda x: length(x) > 20) AS ps FROM (
  SELECT doc_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS b
  FROM (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS t FROM documents))))""")
def paragraph_pairs(spark, sf_dir):
    """Paragraphs as answers to one question."""
    return legacy_chunk.paragraph_pairs(table(spark, sf_dir, "documents").select("doc_id", paragraphs(F.col("text")).alias("text")))


@query()
def chunk_strategies(spark, sf_dir):
    """Pairs of each document by all four chunking strategies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Overview\n"), paragraphs(F.col("text")), F.lit("\nQ: What is it?\nA: A text.")).alias("text"))
    out = None
    for name in legacy_chunk.STRATEGIES:
        part = legacy_chunk.pairs(docs, name).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.length("answer")).alias("n_chars")).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def packed_chunks(spark, sf_dir):
    """Chunks of documents by sentences, facts and tokens, and statistics of them."""
    out = None
    for mode in legacy_chunk.MODES:
        part = legacy_chunk.chunk_stats(legacy_chunk.chunks(table(spark, sf_dir, "documents"), mode)).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def subject_chunks(spark, sf_dir):
    """Optimised chunks with their metrics, subject and priority."""
    rows = legacy_chunk.subject_chunks(table(spark, sf_dir, "documents"), keep_all=True)
    return rows.select("doc_id", "chunk_no", "n_words", "n_sentences", F.round("density", 6).alias("density"), "completeness", F.round("coherence", 6).alias("coherence"), "subject", "priority")
