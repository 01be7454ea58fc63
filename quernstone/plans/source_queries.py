"""Queries of readers, sinks, contracts, voices and ledgers, with SQL.

Readers of files get the driver's tables as files first, written to the shared folder.
The SQL spells its constants out, so that a slip in the engine's own doesn't pass.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import normalise, personality, quality, text
from quernstone.operators import contract, conversation, cost, dedup, quarantine, stats
from quernstone.operators.store import Work
from quernstone.plans.recipes import CALLS_SQL, QUARANTINED_SQL, calls, quarantined, table
from quernstone.sources import readers, sinks

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


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


# A user's turn with the assistant's that comes next, as columns of a table.
_PAIRS = f"""(SELECT conv_id, turn, {_strip('text')} AS question, {_strip('next')} AS answer FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER w AS next, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def _pairs(spark, sf_dir):
    after = "OVER (PARTITION BY conv_id ORDER BY turn)"
    rows = turns(spark, sf_dir).withColumn("next", F.expr(f"lead(text) {after}")).withColumn("next_role", F.expr(f"lead(role) {after}"))
    rows = rows.where("role = 'user' and next_role = 'assistant'")
    return rows.select("conv_id", "turn", text.strip(F.col("text")).alias("question"), text.strip(F.col("next")).alias("answer"))


def _as_csv(rows, name: str) -> str:
    path = f"{Work(rows.sparkSession, 'files').root}/{name}"
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(path)
    return path


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, md5(text) AS text_md5 FROM conversations")
def csv_rows(spark, sf_dir):
    """Conversations written as CSV and read back, line ends and quotes included."""
    rows = readers.read_csv(spark, _as_csv(turns(spark, sf_dir).select("conv_id", "turn", "role", "text"), "turns"), ",")
    return rows.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query(f"SELECT md5(question) AS question_md5, md5(answer) AS answer_md5 FROM {_PAIRS} WHERE question <> '' AND answer <> ''")
def csv_questions(spark, sf_dir):
    """Questions and answers of a CSV, by the names of its columns."""
    rows = readers.read_csv(spark, _as_csv(_pairs(spark, sf_dir).select(F.col("turn").alias("No"), F.col("question").alias("User Question"), F.col("answer").alias("The Reply")), "pairs"), ",")
    return readers.csv_pairs(rows).select(F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query(f"SELECT md5('<|user|> ' || question) AS first_md5, md5('<|assistant|> ' || answer) AS second_md5 FROM {_PAIRS} WHERE question <> '' AND answer <> ''")
def csv_dialogue(spark, sf_dir):
    """Segments of a CSV with a question and an answer."""
    rows = readers.read_csv(spark, _as_csv(_pairs(spark, sf_dir).select("question", "answer"), "pairs"), ",")
    return readers.csv_segments(rows).select(F.md5(F.col("segments")[0]).alias("first_md5"), F.md5(F.col("segments")[1]).alias("second_md5"))


@query(f"SELECT 'text' AS \"column\", md5({_strip('text')}) AS segment_md5 FROM conversations WHERE length({_strip('text')}) > 20")
def csv_long_cells(spark, sf_dir):
    """Cells of a CSV of over twenty characters."""
    rows = readers.read_csv(spark, _as_csv(turns(spark, sf_dir).select("turn", "role", "text"), "turns"), ",")
    return readers.csv_cells(rows).select("column", F.md5("segment").alias("segment_md5"))


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def json_line_rows(spark, sf_dir):
    """Conversations written as JSON lines and read back."""
    path = f"{Work(spark, 'files').root}/turns"
    sinks.write_json(turns(spark, sf_dir).select("conv_id", "turn", "role", "text"), path)
    row = F.from_json("object", "conv_id long, turn long, role string, text string").alias("r")
    return readers.read_json_lines(spark, path).select(row).select("r.conv_id", "r.turn", "r.role", F.md5("r.text").alias("text_md5"))


@query("SELECT md5(substr(props, 1, length(props) - 1)) AS line_md5 FROM events WHERE event_id % 3 = 0 AND props <> ''")
def json_bad_lines(spark, sf_dir):
    """Lines that aren't JSON: properties of every third event have lost their last brace."""
    path = f"{Work(spark, 'files').root}/lines"
    cut = F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    table(spark, sf_dir, "events").select(cut.alias("value")).write.text(path)
    return readers.read_json_lines(spark, path, keep_bad=True).select(F.md5("line").alias("line_md5"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def json_objects(spark, sf_dir):
    """Items of JSON lists, a list to a file, by event type."""
    path = f"{Work(spark, 'files').root}/lists"
    events = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("o"), (F.col("event_id") % 16).alias("file"))
    lists = events.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ", "), F.lit("]")).alias("value"))
    lists.write.partitionBy("file").text(path)
    return readers.read_json_objects(spark, path).groupBy(F.get_json_object("object", "$.event_type").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


_OBJECT_SQL = "FROM (SELECT conv_id, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos FROM conversations WHERE role IN ('user', 'assistant'))"


def _objects(spark, sf_dir, message):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), message)
    return turns(spark, sf_dir).groupBy("conv_id").agg(ordered.alias("items"))


@query(f"SELECT conv_id, pos, role, md5(text) AS content_md5 {_OBJECT_SQL}")
def json_messages(spark, sf_dir):
    """Turns of JSON objects with messages; other roles than user and assistant go."""
    rows = _objects(spark, sf_dir, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    found = rows.select("conv_id", F.posexplode(readers.json_conversation(F.to_json(F.struct(F.col("items").alias("messages"))))).alias("pos", "s"))
    return found.select("conv_id", "pos", "s.role", F.md5("s.content").alias("content_md5"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, md5(text) AS content_md5 FROM conversations")
def json_from_value(spark, sf_dir):
    """Turns of JSON objects with from and value: human's are a user's, all others an
    assistant's."""
    rows = _objects(spark, sf_dir, lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    found = rows.select("conv_id", F.posexplode(readers.json_conversation(F.to_json(F.struct(F.col("items").alias("conversations"))))).alias("pos", "s"))
    return found.select("conv_id", "pos", "s.role", F.md5("s.content").alias("content_md5"))


_LONG = f"CASE WHEN length({_strip('text')}) > 20 THEN {_strip('text')} END"


@query(f"SELECT doc_id, md5(concat_ws('|', {_LONG}, {_LONG.replace('text', 'source')})) AS found_md5 FROM documents")
def json_text_fields(spark, sf_dir):
    """Values of known text fields of JSON objects, of over twenty characters."""
    record = F.to_json(F.struct(F.col("source").alias("description"), F.col("text"), F.col("text").alias("other")))
    return docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(readers.json_fields(record), "|")).alias("found_md5"))


@query(f"SELECT md5(question) AS question_md5, md5(answer) AS answer_md5 FROM {_PAIRS} WHERE question <> '' AND answer <> ''")
def json_questions(spark, sf_dir):
    """Questions and answers of JSON objects, by the names of their keys."""
    rows = _pairs(spark, sf_dir).select(F.to_json(F.struct("turn", F.col("question").alias("prompt"), F.col("answer").alias("completion"))).alias("object"))
    return readers.json_pairs(rows).select(F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query(f"SELECT conv_id, turn, md5(question || '|' || answer) AS pair_md5 FROM {_PAIRS} WHERE question <> '' AND answer <> ''")
def labelled_questions(spark, sf_dir):
    """Questions and answers in running text, marked Q: and A:."""
    marked = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
    rows = _pairs(spark, sf_dir).where("question != '' and answer != ''").select("conv_id", "turn", F.explode(readers.qa_pairs(marked)).alias("p"))
    return rows.select("conv_id", "turn", F.md5(F.concat("p.question", F.lit("|"), "p.answer")).alias("pair_md5"))


_KIND = "CASE lower(ext) WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'csv' WHEN 'json' THEN 'json' WHEN 'jsonl' THEN 'jsonl' WHEN 'ndjson' THEN 'jsonl' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'markdown' THEN 'text' END"
_EXTENSIONS = ("pdf", "CSV", "json", "jsonl", "ndjson", "txt", "MD", "markdown", "exe")


@query(f"SELECT doc_id, {_KIND} AS kind, CASE WHEN lower(ext) IN ('csv', 'json') THEN lower(ext) WHEN doc_id % 4 = 0 THEN 'faq' ELSE 'text' END AS preparation FROM (SELECT doc_id, {list(_EXTENSIONS)}[doc_id % {len(_EXTENSIONS)} + 1] AS ext FROM documents)")
def file_kinds(spark, sf_dir):
    """Which reader files go to by their names."""
    extension = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % len(_EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("/data.json/"), F.when(F.col("doc_id") % 4 == 0, "the_FAQ_").otherwise("file"), F.col("doc_id").cast("string"), F.lit("."), extension)
    return docs(spark, sf_dir).select("doc_id", readers.kind_of(path).alias("kind"), readers.preparation_kind(path).alias("preparation"))


_LINES = f"list_filter(list_transform(string_split({_strip('text')}, chr(10)), lambda x: {_strip('x')}), lambda x: length(x) > 20)"


@query(f"SELECT doc_id, len({_LINES}) AS n, md5(array_to_string({_LINES}, '|')) AS segments_md5 FROM documents WHERE len({_LINES}) > 0")
def line_segments(spark, sf_dir):
    """Lines of texts without paragraphs, of over twenty characters."""
    rows = readers.plain_segments(docs(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", "segment"))).alias("s"))
    return rows.select("doc_id", "n", F.md5(F.array_join(F.transform("s", lambda x: x["segment"]), "|")).alias("segments_md5"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_log(spark, sf_dir):
    """Events appended to a log in a folder for each day, read back by day."""
    path, events = f"{Work(spark, 'files').root}/log", table(spark, sf_dir, "events")
    for part in (0, 1):
        sinks.append_log(events.where(F.col("event_id") % 2 == part), path, "ts")
    rows = spark.read.schema("event_type string, value double, date date").json(path)
    return rows.groupBy(F.col("date").cast("string").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, CASE WHEN length(text) < 200 THEN 'error' ELSE 'archive' END AS folder FROM documents")
def outcome_folders(spark, sf_dir):
    """Documents to the archive, short ones to the error folder."""
    good, bad = sinks.split_outcome(docs(spark, sf_dir), F.length("text") < 200)
    return good.select("doc_id", F.lit("archive").alias("folder")).unionByName(bad.select("doc_id", F.lit("error").alias("folder")))


@query("""SELECT doc_id, md5('{"doc_id":' || doc_id || ',"lang":' || to_json(lang)::VARCHAR || ',"nothing":null,"source":' || to_json(source)::VARCHAR || '}') AS payload_md5 FROM documents""")
def canonical_payloads(spark, sf_dir):
    """Records as compact JSON with their nulls."""
    row = F.struct("doc_id", "lang", F.lit(None).cast("string").alias("nothing"), "source")
    return docs(spark, sf_dir).select("doc_id", F.md5(sinks.canonical_payload(row)).alias("payload_md5"))


_LINT = "'missing:format,missing:quality_score,missing:accuracy_score,missing:personality,missing:processing_timestamp,missing:validation_passed,missing:tier,missing:metadata,order,naming:Lang-Code'"


@query(f"SELECT 'doc_' || doc_id AS id, {_LINT} || CASE WHEN doc_id % 5 = 0 THEN ',null:content,empty_content' WHEN trim(text) = '' THEN ',empty_content' ELSE '' END AS lint FROM documents")
def payload_lint(spark, sf_dir):
    """What is wrong with records that lack fields, hold them in another order, and some of
    which have no content."""
    content = F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("content")
    rows = docs(spark, sf_dir).select(F.col("source").alias("source_file"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), content, F.col("lang").alias("Lang-Code"))
    return contract.lint(rows).select("id", F.array_join("lint", ",").alias("lint"))


_QUARTER = "length(text) // 4"


@query(f"""SELECT doc_id, concat_ws(',', CASE WHEN NOT regexp_matches(source, '^[a-z0-9.-]+$') THEN 'source:bad_pattern' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'lang:not_allowed' END,
  CASE WHEN {_QUARTER} > 300 THEN 'body:too_long' END, 'tone:missing') AS errors FROM documents""")
def prompt_slots(spark, sf_dir):
    """Errors of the values that fill a prompt's slots."""
    slots = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("body"), F.col("text"))
    rules = {"source": {"pattern": r"^[a-z0-9.-]+$"}, "lang": {"allowed": ("en", "de")}, "body": {"max_tokens": 300}, "tone": {"required": True}}
    return docs(spark, sf_dir).select("doc_id", F.array_join(contract.slot_errors(slots, rules), ",").alias("errors"))


_BARE = _strip("text")


@query(f"SELECT doc_id, CASE WHEN {_BARE} = '' THEN 'Input text is empty' WHEN length({_BARE}) < 10 THEN 'Input text is too short (minimum 10 characters)' WHEN NOT regexp_matches({_BARE}, '[a-zA-Z]') THEN 'Input text contains no alphabetic characters' ELSE '' END AS problem FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN regexp_replace(text, '[a-zA-Z]', '', 'g') WHEN doc_id % 10 = 0 THEN substr(text, 1, 5) ELSE text END AS text FROM documents)")
def input_problems(spark, sf_dir):
    """Why texts can't be formatted; some have lost their letters, some all but a few."""
    t = F.when(F.col("doc_id") % 9 == 0, F.regexp_replace("text", "[a-zA-Z]", "")).when(F.col("doc_id") % 10 == 0, F.substring("text", 1, 5)).otherwise(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", text.input_problem(t).alias("problem"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN 1 ELSE 0 END AS n_parts, CASE WHEN strlen(text) <= 2000 THEN md5(text) END AS text_md5 FROM documents")
def size_rejects(spark, sf_dir):
    """Documents of at most 2,000 bytes; larger ones are rejected."""
    return docs(spark, sf_dir).select("doc_id", normalise.cap(F.col("text"), 2000, "reject").alias("p")).select("doc_id", F.size("p").alias("n_parts"), F.md5(F.get("p", F.lit(0))).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'professional' WHEN doc_id % 3 = 1 THEN lang ELSE source END AS voice FROM (SELECT doc_id, lower(lang) AS lang, trim(lower(source)) AS source FROM documents)")
def voice_names(spark, sf_dir):
    """Names of voices without the prefix of custom ones."""
    name = F.when(F.col("doc_id") % 3 == 0, F.lit(" custom: ")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("CUSTOM:  "), "lang")).otherwise(F.col("source"))
    return docs(spark, sf_dir).select("doc_id", personality.resolve_name(F.ltrim(name)).alias("voice"))


@query("""SELECT doc_id, md5('Rewrite the text below in this voice, with moderate changes. Keep all facts.' || chr(10) || 'Voice: ' || lang || chr(10) || 'Text:' || chr(10) || text) AS prompt_md5 FROM (SELECT doc_id, text, 'calm' AS lang FROM documents)""")
def voice_prompts(spark, sf_dir):
    """Prompts that ask a model for a text in a voice."""
    return docs(spark, sf_dir).select("doc_id", F.md5(personality.voice_prompt(F.col("text"), "calm", 0.5)).alias("prompt_md5"))


_FILLED = "text"
for _pattern in (r"\[.*?\]", "<.*?>", r"\{.*?\}", "PLACEHOLDER", "TODO", "FIXME", "SYMBOLIC MEANING HERE", "INSERT.*HERE", "REPLACE.*WITH"):
    _FILLED = f"regexp_replace({_FILLED}, '{_pattern}', 'it', 'gi')"


@query(f"SELECT doc_id, md5({_FILLED}) AS filled_md5 FROM (SELECT doc_id, 'A [name] here, TODO, <b> and {{x}}; insert it here. ' || text AS text FROM documents)")
def filled_placeholders(spark, sf_dir):
    """Placeholders replaced by a filler."""
    t = F.concat(F.lit("A [name] here, TODO, <b> and {x}; insert it here. "), "text")
    return docs(spark, sf_dir).select("doc_id", F.md5(personality.fill_placeholders(t, "it")).alias("filled_md5"))


_ENDED = """CASE WHEN right(b, 1) IN ('.', '!', '?', '>', '}', ']', '"') THEN b ELSE b || '.' END"""


@query(rf"""SELECT doc_id, md5('<|user|>' || chr(10) || 'Please explain this information:' || chr(10) || '<|assistant|>' || chr(10) || {_ENDED}) AS qwen_md5, md5('<|im_start|>assistant' || chr(10) || {_ENDED} || chr(10) || '<|im_end|>') AS chatml_md5
  FROM (SELECT doc_id, {_strip(r"regexp_replace(text, '\[truncated\]|\.{3,}\s*$', '', 'g')")} AS b FROM documents)""")
def repaired_formats(spark, sf_dir):
    """Documents with the marks of a format put in, and a full stop at the end."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(personality.repair_format(t, "qwen")).alias("qwen_md5"), F.md5(personality.repair_format(t, "chatml")).alias("chatml_md5"))


_ROLES = "SELECT role, CASE WHEN turn % 3 = 0 THEN 'model' ELSE 'rules' END AS method, (turn % 10) / 10 AS confidence FROM conversations"


@query(f"SELECT role, method, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM ({_ROLES}) GROUP BY ROLLUP (role, method)")
def classification_totals(spark, sf_dir):
    """Segments and mean confidence by role and method, with totals."""
    rows = turns(spark, sf_dir).select("role", F.when(F.col("turn") % 3 == 0, "model").otherwise("rules").alias("method"), ((F.col("turn") % 10) / 10).alias("confidence"))
    return stats.classification_stats(rows).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("SELECT n, n_passed, round(cost, 4) AS cost, round(n_passed / greatest(1, n), 9) AS pass_rate, round(cost / nullif(n_passed, 0), 6) AS cost_per_passed FROM (SELECT count(*) AS n, count(*) FILTER (WHERE length(text) > 500) AS n_passed, sum(CAST(length(text) AS DOUBLE) / 1000) AS cost FROM documents)")
def batch_costs(spark, sf_dir):
    """Documents that passed, and what they cost."""
    found = stats.batch_summary(docs(spark, sf_dir).select((F.length("text") > 500).alias("passed"), (F.length("text") / 1000).alias("cost")))
    return found.select("n", "n_passed", F.round("cost", 4).alias("cost"), F.round("pass_rate", 9).alias("pass_rate"), F.round("cost_per_passed", 6).alias("cost_per_passed"))


@query("SELECT prefix, count(*) AS n FROM (SELECT unnest([event_type, 'user' || CAST(user_id % 15 AS VARCHAR)]) AS prefix FROM events) GROUP BY prefix ORDER BY n DESC, prefix LIMIT 10")
def frequent_corrections(spark, sf_dir):
    """The ten most frequent kinds of corrections."""
    made = F.array(F.concat("event_type", F.lit(": "), F.col("event_id").cast("string")), F.concat(F.lit("user"), (F.col("user_id") % 15).cast("string"), F.lit(":fixed")))
    return stats.common_corrections(table(spark, sf_dir, "events").select(made.alias("corrections")))


_RECALL = f"len(list_intersect(list_distinct({_words('lower(half)')}), list_distinct({_words('lower(text)')}))) / len(list_distinct({_words('lower(text)')}))"


@query(f"SELECT doc_id, 0.0::DOUBLE AS compliance, round(coalesce({_RECALL} * 100, 100.0), 6) AS preservation FROM (SELECT doc_id, text, substr(text, 1, length(text) // 2) AS half FROM documents)")
def preserved_words(spark, sf_dir):
    """How many of a document's words its first half keeps."""
    half = F.expr("substring(text, 1, length(text) div 2)")
    found = docs(spark, sf_dir).select("doc_id", quality.accuracy_metrics(half, F.col("text"), "llama2").alias("m"))
    return found.select("doc_id", F.col("m.compliance").cast("double").alias("compliance"), F.round("m.preservation", 6).alias("preservation"))


@query("""SELECT doc_id, a AS accuracy, CASE WHEN doc_id % 2 = 0 THEN f ELSE 50.0 END AS fluency, 50.0::DOUBLE AS coherence, CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
  FROM (SELECT doc_id, CAST(doc_id % 101 AS DOUBLE) AS a, CAST(doc_id % 97 AS DOUBLE) AS f FROM documents)""")
def model_replies(spark, sf_dir):
    """Scores read from a model's replies, in JSON or in words."""
    a, f = (F.col("doc_id") % 101).cast("string"), (F.col("doc_id") % 97).cast("string")
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('Here: {"accuracy": '), a, F.lit(', "fluency": '), f, F.lit(', "confidence": 0.9}.'))).otherwise(F.concat(F.lit("The accuracy: "), a, F.lit(" seems right.")))
    found = docs(spark, sf_dir).select("doc_id", quality.parsed_model_scores(reply).alias("s"))
    return found.select("doc_id", "s.accuracy", "s.fluency", "s.coherence", "s.confidence")


@query("""SELECT conv_id, turn, CASE WHEN mc > 0.8 THEN m WHEN rc > 0.6 THEN r WHEN m = r THEN m WHEN mc * 7 >= rc * 3 THEN m ELSE r END AS role,
  CASE WHEN mc > 0.8 THEN 'model' WHEN rc > 0.6 THEN 'rules' ELSE 'hybrid' END AS method, round(CASE WHEN mc > 0.8 THEN mc WHEN rc > 0.6 THEN rc ELSE mc * 0.7 + rc * 0.3 END, 6) AS confidence
  FROM (SELECT conv_id, turn, role AS r, 'user' AS m, CAST((turn + conv_id) % 10 AS DOUBLE) / 10 AS rc, CAST(turn % 10 AS DOUBLE) / 10 AS mc FROM conversations)""")
def hybrid_roles(spark, sf_dir):
    """Roles by rules and by a model, joined by how sure each is."""
    found = conversation.hybrid_role(F.col("role"), (F.col("turn") + F.col("conv_id")) % 10 / 10, F.lit("user"), F.col("turn") % 10 / 10)
    return turns(spark, sf_dir).select("conv_id", "turn", found.alias("h")).select("conv_id", "turn", "h.role", "h.method", F.round("h.confidence", 6).alias("confidence"))


def _latest(level: str, rank: int) -> str:
    return f"(SELECT entry_id, threat_level, {rank} AS rank FROM {QUARANTINED_SQL} WHERE threat_level = '{level}' ORDER BY timestamp DESC, entry_id LIMIT 25)"


@query(f"SELECT * FROM {_latest('critical', 0)} UNION ALL SELECT * FROM {_latest('dangerous', 1)}")
def gravest_entries(spark, sf_dir):
    """The latest critical and dangerous entries of the quarantine."""
    return quarantine.high_threats(quarantined(docs(spark, sf_dir))).select("entry_id", "threat_level", "rank")


@query("SELECT doc_id AS item_id, quality AS score, 'pending' AS status FROM labels WHERE doc_id % 3 = 0 AND quality IS NOT NULL ORDER BY score, item_id LIMIT 1")
def next_repair(spark, sf_dir):
    """The pending item with the lowest score."""
    rows = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("score"), F.when(F.col("doc_id") % 3 == 0, "pending").otherwise("completed").alias("status"))
    return quarantine.remediation_next(rows)


@query("""SELECT doc_id AS item_id, CASE WHEN s = 'pending' AND t = 'processing' OR s = 'processing' AND t IN ('completed', 'failed') OR s = 'failed' AND t = 'pending' THEN t ELSE s END AS status
  FROM (SELECT doc_id, ['pending', 'processing', 'failed', 'completed'][doc_id % 4 + 1] AS s, ['processing', 'completed', 'pending'][doc_id % 3 + 1] AS t FROM documents)""")
def repair_steps(spark, sf_dir):
    """Steps of items through the queue of repairs; only allowed ones are taken."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int")).alias("status")
    rows, ids = docs(spark, sf_dir), F.col("doc_id").alias("item_id")
    return quarantine.transition(rows.select(ids, pick("pending", "processing", "failed", "completed")), rows.select(ids, pick("processing", "completed", "pending")))


@query("""SELECT model, concat_ws(',', CASE WHEN hits < 0.3 THEN 'raise_cache_use' END, CASE WHEN spent > 0.8 THEN 'near_budget' END, CASE WHEN costly > 0.5 THEN 'use_cheaper_models' END, CASE WHEN n < 10 THEN 'batch_more' END) AS advice
  FROM (SELECT model, count(*) AS n, avg(CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 0.0 END) AS hits, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) AS spent, avg(CASE WHEN event_id % 3 > 0 THEN 1.0 ELSE 0.0 END) AS costly FROM """ + CALLS_SQL + """ GROUP BY model)""")
def cost_advice(spark, sf_dir):
    """What would lower the cost of each model's calls."""
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    rows = calls(table(spark, sf_dir, "events")).groupBy("model").agg(F.count(F.lit(1)).alias("n"), share(F.col("event_id") % 5 == 0).alias("hits"), share(F.col("value") > 10).alias("spent"), share(F.col("event_id") % 3 > 0).alias("costly"))
    return rows.select("model", F.array_join(cost.advice(F.col("n"), F.col("hits"), F.col("spent"), F.col("costly")), ",").alias("advice"))


@query("SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS replaced, (SELECT count(*) FROM documents WHERE doc_id % 8 = 0) + (SELECT count(*) FROM documents WHERE doc_id % 4 = 0) AS inserted FROM documents")
def upsert_sizes(spark, sf_dir):
    """Rows that an update of every fourth document takes out and puts in."""
    rows = docs(spark, sf_dir).select("doc_id", "lang")
    changes = rows.where("doc_id % 4 = 0").unionByName(rows.where("doc_id % 8 = 0"))
    return dedup.upsert_counts(rows, changes, "doc_id")
