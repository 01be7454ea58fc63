"""Queries of records, events, costs, quarantine and the star schema, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import quality
from quernstone.functions.text import words
from quernstone.operators import contract, cost, dedup, quarantine, stats
from quernstone.operators.store import Work
from quernstone.plans import phases, settings
from quernstone.plans.recipes import CALLS_SQL, QUARANTINED_SQL, book, calls, quarantined, table
from quernstone.plans.text_queries import RULES_SQL, TIER_SQL, lit_sql, words_sql
from quernstone.sources import sinks

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _rules(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quality.rule_scores(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"SELECT {TIER_SQL} AS tier, count(*) AS n FROM {RULES_SQL} GROUP BY 1")
def tier_distribution(spark, sf_dir):
    """Documents in each quality tier by rule scores."""
    return stats.tier_distribution(_rules(spark, sf_dir))


@query(f"""
SELECT n, round(accuracy, 6) AS accuracy, round(fluency, 6) AS fluency, round(coherence, 6) AS coherence, round(training_readiness, 6) AS training_readiness, round(overall, 6) AS overall,
  CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade,
  array_to_string(list_filter([CASE WHEN accuracy < 70 THEN 'improve_accuracy' END, CASE WHEN fluency < 70 THEN 'improve_fluency' END, CASE WHEN depth < 60 THEN 'improve_personality_depth' END, CASE WHEN coherence < 70 THEN 'improve_coherence' END, CASE WHEN training_readiness < 70 THEN 'improve_training_readiness' END,
    CASE WHEN overall > 85 THEN 'excellent' WHEN overall > 70 THEN 'good' ELSE 'insufficient' END], lambda v: v IS NOT NULL), ',') AS recommendations
FROM (SELECT count(*) AS n, avg(accuracy) AS accuracy, avg(fluency) AS fluency, avg(personality_depth) AS depth, avg(coherence) AS coherence, avg(training_readiness) AS training_readiness, avg(overall) AS overall FROM {RULES_SQL})""")
def quality_report(spark, sf_dir):
    """Mean scores, the grade and recommendations."""
    rows = stats.quality_averages(_rules(spark, sf_dir))
    return rows.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "fluency", "coherence", "training_readiness", "overall")), "grade", F.array_join("recommendations", ",").alias("recommendations"))


@query("""
WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, round(a, 6) AS first_half, round(b, 6) AS second_half, round(c, 6) AS current, CASE WHEN b > a THEN 'improving' ELSE 'declining' END AS direction
FROM (SELECT event_type, count(*) AS n, avg(value) FILTER (WHERE i <= n // 2) AS a, avg(value) FILTER (WHERE i > n // 2) AS b, avg(value) FILTER (WHERE i > n - 100) AS c FROM e WHERE n >= 10 GROUP BY event_type)""")
def score_trends(spark, sf_dir):
    """First against second half of each event type's values."""
    rows = stats.halves(events(spark, sf_dir), ["ts", "event_id"], "value", ["event_type"])
    return rows.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("first_half", "second_half", "current")), "direction")


_CUTOFF = "2024-01-15 00:00:00"


@query(f"""
SELECT event_type, nr AS n_recent, nb AS n_before, round(r, 6) AS recent, round(b, 6) AS before, coalesce(nr >= 10 AND nb >= 10 AND abs(r - b) > 0.5, false) AS drift, CASE WHEN nr >= 10 AND nb >= 10 THEN CASE WHEN r < b THEN 'decline' ELSE 'improvement' END END AS direction
FROM (SELECT event_type, count(*) FILTER (WHERE recent) AS nr, count(*) FILTER (WHERE NOT recent) AS nb, avg(value) FILTER (WHERE recent) AS r, avg(value) FILTER (WHERE NOT recent) AS b FROM (SELECT *, ts >= TIMESTAMP '{_CUTOFF}' - INTERVAL 72 HOURS AS recent FROM events) GROUP BY event_type)""")
def score_drift(spark, sf_dir):
    """Values of the last days against those before, by event type."""
    rows = stats.drift(events(spark, sf_dir), F.lit(_CUTOFF).cast("timestamp_ntz"), "value", hours=72, threshold=0.5, group=["event_type"])
    return rows.select("event_type", "n_recent", "n_before", F.round("recent", 6).alias("recent"), F.round("before", 6).alias("before"), F.coalesce("drift", F.lit(False)).alias("drift"), "direction")


def _priced(spark, sf_dir):
    priced = cost.with_cost(calls(events(spark, sf_dir)), cost.price_table(spark))
    return priced.withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))


_PRICE = "CASE model WHEN 'gpt-4' THEN tokens_in / 1000 * 0.03::DOUBLE + tokens_out / 1000 * 0.06::DOUBLE ELSE tokens_in / 1000 * 0.0015::DOUBLE + tokens_out / 1000 * 0.002::DOUBLE END"
_PRICED = f"(SELECT *, tokens_in + tokens_out AS tokens, {_PRICE} AS cost FROM {CALLS_SQL})"


@query(f"SELECT CAST(ts AS DATE) AS date, model, round(sum(cost), 8) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS requests FROM {_PRICED} GROUP BY ROLLUP (CAST(ts AS DATE), model)")
def cost_ledger(spark, sf_dir):
    """Costs by day and model, with totals."""
    return cost.ledger(_priced(spark, sf_dir)).withColumn("cost", F.round("cost", 8))


@query(f"SELECT model, round(sum(cost), 6) AS total_cost, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(*) AS total_requests, round(sum(cost) / 7, 6) AS average_daily_cost FROM {_PRICED} WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-10' GROUP BY ROLLUP (model)")
def cost_report(spark, sf_dir):
    """Costs of a week by model."""
    rows = cost.cost_report(_priced(spark, sf_dir), F.lit("2024-01-10").cast("date"))
    return rows.select("model", F.round("total_cost", 6).alias("total_cost"), "total_tokens", "total_requests", F.round("average_daily_cost", 6).alias("average_daily_cost"))


@query(f"""
WITH r AS (SELECT *, sum(cost) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM {_PRICED})
SELECT CAST(ts AS DATE) AS date, event_id, round(spent, 8) AS spent, a AS threshold FROM r, (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS a) WHERE spent >= a * 10 AND spent - cost < a * 10""")
def budget_alerts(spark, sf_dir):
    """The calls that first reach each alert level of a day's budget."""
    return cost.budget_alerts(_priced(spark, sf_dir), 10.0).withColumn("spent", F.round("spent", 8))


@query(f"SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS start, count(*) AS n FROM {CALLS_SQL} GROUP BY 1")
def request_rates(spark, sf_dir):
    """Calls in each minute."""
    return cost.rate(calls(events(spark, sf_dir)), slide="60 seconds")


@query(f"SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS priority FROM {CALLS_SQL}")
def batch_priorities(spark, sf_dir):
    """Calls by the priority of their kind."""
    kinds = F.when(F.col("event_type") == "click", "classification").when(F.col("event_type") == "view", "enhancement").otherwise("other")
    return cost.batch_order(calls(events(spark, sf_dir)).withColumn("kind", kinds)).select("event_id", "priority")


@query(r"""
SELECT doc_id, sha256('{"model":"gpt-4","prompt":' || to_json(CASE WHEN length(p) < 200 THEN lower(p) ELSE p END)::VARCHAR || ',"type":"general"}') AS cache_key FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM documents)""")
def cache_keys(spark, sf_dir):
    """Keys of documents as prompts."""
    return table(spark, sf_dir, "documents").select("doc_id", cost.cache_key(F.col("text"), F.lit("gpt-4")).alias("cache_key"))


_CACHE = "(SELECT CAST(user_id AS VARCHAR) AS cache_key, event_type AS response, user_id % 7 + 1 AS usage_count, value / 100 AS cost, value / 50 AS quality_score, ts AS created_at, ts + INTERVAL 10 DAYS AS expires_at, event_id FROM events)"
_NOW = "2024-01-15 00:00:00"


def _cache(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_type").alias("response"), (F.col("user_id") % 7 + 1).alias("usage_count"), (F.col("value") / 100).alias("cost"), (F.col("value") / 50).alias("quality_score"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"), "event_id")


_LATEST = f"(SELECT * FROM {_CACHE} QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC, event_id) = 1)"


@query(f"SELECT count(*) AS total_entries, CAST(sum(usage_count) AS BIGINT) AS total_usage, round(sum(cost), 6) AS total_cost, round(avg(quality_score), 6) AS avg_quality, count(*) FILTER (WHERE expires_at > TIMESTAMP '{_NOW}') AS active_entries FROM {_LATEST}")
def cache_analytics(spark, sf_dir):
    """The response cache: entries, uses, cost, quality."""
    latest = dedup.latest(_cache(spark, sf_dir), "cache_key", F.desc("created_at"), F.col("event_id"))
    rows = cost.cache_analytics(latest, F.lit(_NOW).cast("timestamp_ntz"))
    return rows.select("total_entries", "total_usage", F.round("total_cost", 6).alias("total_cost"), F.round("avg_quality", 6).alias("avg_quality"), "active_entries")


@query(f"SELECT cache_key, usage_count, round(cost, 6) AS cost FROM {_LATEST} WHERE expires_at > TIMESTAMP '{_NOW}' ORDER BY usage_count DESC, cache_key LIMIT 10")
def popular_cache(spark, sf_dir):
    """The ten most used entries that haven't expired."""
    latest = dedup.latest(_cache(spark, sf_dir), "cache_key", F.desc("created_at"), F.col("event_id"))
    return cost.popular(latest, F.lit(_NOW).cast("timestamp_ntz")).select("cache_key", "usage_count", F.round("cost", 6).alias("cost"))


@query(f"SELECT e.event_id, c.cache_key IS NOT NULL AS is_hit, c.response FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS cache_key FROM events) e LEFT JOIN (SELECT * FROM {_LATEST} WHERE expires_at > TIMESTAMP '{_NOW}') c USING (cache_key)")
def cache_lookup(spark, sf_dir):
    """Events as calls against the cache."""
    latest = dedup.latest(_cache(spark, sf_dir), "cache_key", F.desc("created_at"), F.col("event_id"))
    asked = events(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("cache_key"))
    return cost.cached(asked, latest, F.lit(_NOW).cast("timestamp_ntz")).select("event_id", "is_hit", "response")


@query(f"""
WITH q AS {QUARANTINED_SQL} SELECT 'total' AS measure, NULL AS key, count(*) AS n FROM q UNION ALL SELECT 'level', threat_level, count(*) FROM q GROUP BY 2 UNION ALL SELECT 'status', review_status, count(*) FROM q GROUP BY 2
UNION ALL SELECT 'recent', 'recent', count(*) FROM q WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 7 DAYS HAVING count(*) > 0""")
def quarantine_statistics(spark, sf_dir):
    """Quarantine entries in all, by level, by status, and of the last week."""
    return quarantine.statistics(quarantined(table(spark, sf_dir, "documents")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query(f"""
WITH t AS (SELECT threat, count(*) AS n FROM (SELECT unnest(threats) AS threat FROM {QUARANTINED_SQL} WHERE timestamp >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 7 DAYS) GROUP BY threat)
SELECT threat, n, (SELECT count(*) FROM t) AS n_distinct, CAST((SELECT sum(n) FROM t) AS BIGINT) AS n_total FROM t ORDER BY n DESC, threat LIMIT 10""")
def threat_report(spark, sf_dir):
    """The most frequent threats of the last week."""
    return quarantine.threat_report(quarantined(table(spark, sf_dir, "documents")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query(f"SELECT entry_id, timestamp, source_file FROM {QUARANTINED_SQL} WHERE threat_level = 'critical' AND review_status = 'pending' AND timestamp >= TIMESTAMP '2024-01-02 00:00:00' ORDER BY timestamp DESC, entry_id LIMIT 100")
def quarantine_search(spark, sf_dir):
    """The latest pending critical entries."""
    rows = quarantined(table(spark, sf_dir, "documents"))
    return quarantine.search(rows, "critical", "pending", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).select("entry_id", "timestamp", "source_file")


@query(f"SELECT entry_id, content_hash FROM {QUARANTINED_SQL} QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY timestamp DESC, entry_id) = 1")
def quarantine_store(spark, sf_dir):
    """The latest entry of each content."""
    return quarantine.store(None, quarantined(table(spark, sf_dir, "documents"))).select("entry_id", "content_hash")


@query(f"SELECT entry_id, timestamp, threat_level, array_to_string(threats, ';') AS threats, source_file, review_status, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS content_preview FROM {QUARANTINED_SQL} ORDER BY timestamp DESC, entry_id LIMIT 10000")
def quarantine_export(spark, sf_dir):
    """The latest ten thousand entries for export."""
    return quarantine.export(quarantined(table(spark, sf_dir, "documents")))


@query(f"SELECT entry_id FROM {QUARANTINED_SQL} WHERE NOT (timestamp < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 5 DAYS AND review_status <> 'pending')")
def quarantine_purge(spark, sf_dir):
    """Entries that stay when old reviewed ones go."""
    return quarantine.purge(quarantined(table(spark, sf_dir, "documents")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 5).select("entry_id")


@query(f"SELECT entry_id, CASE WHEN review_status = 'pending' AND CAST(substr(entry_id, 3) AS BIGINT) % 4 = 0 THEN 'rejected' ELSE review_status END AS review_status FROM {QUARANTINED_SQL}")
def quarantine_review(spark, sf_dir):
    """Every fourth entry rejected where its state allows that."""
    rows = quarantined(table(spark, sf_dir, "documents"))
    decisions = rows.where(F.substring("entry_id", 3, 20).cast("bigint") % 4 == 0).select("entry_id", F.lit("rejected").alias("review_status"), F.lit("").alias("reviewer_notes"))
    return quarantine.review(rows, decisions).select("entry_id", "review_status")


def _records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    target = F.element_at(F.array(*map(F.lit, ("qwen", "alpaca", "plain"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = docs.select(
        F.concat(F.lit("rec_"), F.col("doc_id").cast("string")).alias("id"),
        target.alias("format"),
        F.col("text").alias("content"),
        (F.col("doc_id") % 120).cast("double").alias("quality_score"),
        (F.col("doc_id") % 20 + 85).cast("double").alias("accuracy_score"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.lit("casual")).alias("personality"),
        F.col("source").alias("source_file"),
        F.lit("2024-01-01T00:00:00").alias("processing_timestamp"),
        F.lit(True).alias("validation_passed"),
        F.lit("standard").alias("tier"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"),
    )
    return rows


_RECORDS = """(SELECT doc_id, 'rec_' || CAST(doc_id AS VARCHAR) AS id, ['qwen', 'alpaca', 'plain'][doc_id % 3 + 1] AS format, text AS content, CAST(doc_id % 120 AS DOUBLE) AS quality_score, CAST(doc_id % 20 + 85 AS DOUBLE) AS accuracy_score,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'casual' END AS personality FROM documents)"""
_VIOLATIONS = f"""list_filter([CASE WHEN personality IS NULL THEN 'personality:missing' END, CASE WHEN length(id) < 8 THEN 'id:too_short' END, CASE WHEN format NOT IN {contract.DOMAINS['format']} THEN 'format:not_allowed' END,
  CASE WHEN length(content) < 10 THEN 'content:too_short' END, CASE WHEN length(content) > 8192 THEN 'content:too_long' END, CASE WHEN quality_score > 100 THEN 'quality_score:too_large' END,
  CASE WHEN accuracy_score < 95 THEN 'accuracy_score:too_small' END, CASE WHEN accuracy_score > 100 THEN 'accuracy_score:too_large' END], lambda v: v IS NOT NULL)"""


@query(f"SELECT id, array_to_string(list_sort({_VIOLATIONS}), ',') AS violations, len({_VIOLATIONS}) = 0 AS is_valid FROM {_RECORDS}")
def contract_violations(spark, sf_dir):
    """Documents as records against the contract."""
    return contract.validate(_records(spark, sf_dir)).select("id", F.array_join(F.sort_array("violations"), ",").alias("violations"), "is_valid")


@query(f"""
SELECT count(*) AS n_records, count(*) FILTER (WHERE len({_VIOLATIONS}) > 0) AS contract_failures, count(*) FILTER (WHERE accuracy_score < 95) AS below_95, round(avg(quality_score), 6) AS mean_quality, min(quality_score) AS min_quality, max(quality_score) AS max_quality,
  count(*) FILTER (WHERE len({_VIOLATIONS}) > 0) = 0 AND count(*) FILTER (WHERE accuracy_score < 95) = 0 AND avg(quality_score) >= 95 AS signed_off FROM {_RECORDS}""")
def dataset_sign_off(spark, sf_dir):
    """Whether the records are signed off as a set."""
    return contract.sign_off(_records(spark, sf_dir)).withColumn("mean_quality", F.round("mean_quality", 6))


@query()
def uniform_records(spark, sf_dir):
    """Records tidied, in canonical order, as payloads."""
    rows = contract.uniform(_records(spark, sf_dir))
    return rows.select("id", "is_final", F.md5("payload").alias("payload_md5"))


@query(f"SELECT count(*) AS processed, count(*) FILTER (WHERE len({_VIOLATIONS}) = 0) AS succeeded, count(*) FILTER (WHERE len({_VIOLATIONS}) > 0) AS failed, count(*) FILTER (WHERE len({_VIOLATIONS}) = 0) / greatest(1, count(*)) AS success_rate FROM {_RECORDS}")
def processing_counters(spark, sf_dir):
    """How many records pass."""
    return stats.progress(contract.validate(_records(spark, sf_dir)), F.col("is_valid"))


@query("SELECT total, succeeded, total - succeeded AS failed, succeeded / greatest(1, total) AS success_rate, array_to_string(names, ',') AS failed_names FROM (SELECT count(*) AS total, count(*) FILTER (WHERE length(text) > 100) AS succeeded FROM documents), (SELECT list_sort(list(n)) AS names FROM (SELECT CAST(doc_id AS VARCHAR) AS n FROM documents WHERE length(text) <= 100))")
def batch_report(spark, sf_dir):
    """Outcomes of a batch, with the names that failed."""
    outcomes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), (F.length("text") > 100).alias("success"))
    return sinks.batch_report(outcomes).withColumn("failed_names", F.array_join("failed_names", ","))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1::DOUBLE) AS BIGINT)) FROM documents)")
def head_sample(spark, sf_dir):
    """The first tenth of documents, which the reporting phase scores."""
    return stats.head_sample(table(spark, sf_dir, "documents").select("doc_id"), 0.1, F.col("doc_id"))


@query(f"SELECT a.doc_id, round(len(list_intersect(list_distinct({words_sql('lower(b.text)')}), list_distinct({words_sql('lower(a.text)')}))) / len(list_distinct({words_sql('lower(a.text)')})) * 100, 6) AS preservation FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def content_preservation(spark, sf_dir):
    """Share of each document's words that the next one has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(after, "doc_id").select("doc_id", F.round(quality.word_recall(F.col("next"), F.col("text")) * 100, 6).alias("preservation"))


@query(f"SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN b.h IS NULL THEN 'created' WHEN a.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3) a FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 4 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 5) b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def content_changes(spark, sf_dir):
    """Created, modified and deleted documents between two snapshots of the table."""
    docs = table(spark, sf_dir, "documents")
    now = docs.where("doc_id % 10 != 3").select(F.col("doc_id").alias("path"), F.md5("text").alias("content_hash"))
    before = docs.where("doc_id % 10 != 5").select(F.col("doc_id").alias("path"), F.md5(F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("content_hash"))
    return dedup.changed_files(now, before)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(text || '!') ELSE md5(text) END AS text_md5 FROM documents")
def document_upsert(spark, sf_dir):
    """All rows of changed documents replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changes = docs.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return dedup.upsert(docs, changes, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query("""
SELECT n_name, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""")
def revenue_by_nation(spark, sf_dir):
    """A star join, as a smoke test of the engine; the dimension is of fixed size."""
    read = lambda name: table(spark, sf_dir, name)
    orders = read("orders").where((F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    joined = read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"SELECT role, count(*) AS n, round(avg(n_words), 6) AS mean_words FROM (SELECT role, len({words_sql('text')}) AS n_words FROM conversations) GROUP BY role")
def role_counts(spark, sf_dir):
    """Turns and mean words of each role."""
    rows = table(spark, sf_dir, "conversations").select("role", F.size(words(F.col("text"))).alias("n_words"))
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_words"), 6).alias("mean_words"))


@query(f"SELECT doc_id, source FROM documents WHERE contains(lower(text), {lit_sql('license')})")
def phrase_search(spark, sf_dir):
    """Documents that contain a phrase."""
    return stats.search(table(spark, sf_dir, "documents"), ["text"], "license").select("doc_id", "source")


@query()
def phase_report(spark, sf_dir):
    """All four phases over books: extraction, chunks, rendering and the report."""
    work = Work(spark, "phase_report")
    # of chunks, which are read more than once, only these columns go on
    store = lambda name, frame: work.table(frame.select("document_id", "chunk_id", "source_text"), name, tidy=True) if name == "split" else frame
    done = phases.run(book(table(spark, sf_dir, "documents")), settings.Settings(training_target="alpaca", voice="casual"), store=store)
    rows = done.frames["assess"]
    return rows.select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "fluency", "coherence", "training_readiness", "overall")), "grade", F.array_join("recommendations", ",").alias("recommendations"))


@query("SELECT doc_id, CASE WHEN length(text) < 10 THEN 'too_short' WHEN length(text) > 1000000 THEN 'too_long' ELSE '' END AS violations, regexp_matches(lower(text), 'script') AS has_script FROM documents")
def content_rules(spark, sf_dir):
    """Documents against the content rules."""
    rows = table(spark, sf_dir, "documents").select("doc_id", settings.rule_violations(F.col("text")).alias("v"), settings.suspicious_keywords(F.col("text")).alias("k"))
    return rows.select("doc_id", F.array_join("v", ",").alias("violations"), F.array_contains("k", "script").alias("has_script"))
