"""Readers, writers, streams, phases, model calls, quarantine and cache in small."""

import datetime
import json
import re

from pyspark.sql import functions as F

from quernstone.functions import personality
from quernstone.operators import chunk, cost, model_calls, quarantine, stats, structure
from quernstone.plans import phases
from quernstone.plans.settings import PROFILES, Settings, migrated, profile_threats, rule_violations
from quernstone.sources import readers, sinks
from quernstone.streaming import watch


def test_texts_and_kinds(spark, tmp_path):
    (tmp_path / "one.txt").write_text("First paragraph of some length.\n\nSecond paragraph, also long.")
    (tmp_path / "two.md").write_text("# Title\n\nBody")
    found = {r["document_id"]: r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()}
    assert set(found) == {"one", "two"}
    kinds = {r["path"].rpartition("/")[2]: r["kind"] for r in readers.list_files(spark, str(tmp_path)).collect()}
    assert kinds == {"one.txt": "text", "two.md": "text"}
    assert readers.plain_segments(readers.read_texts(spark, str(tmp_path / "one.txt"))).count() == 2
    assert readers.with_checksum(spark, str(tmp_path)).where("length(sha256) = 64").count() == 2
    names = spark.createDataFrame([("a/b.CSV",), ("x.faq.txt",), ("n",)], "p string")
    assert [r[0] for r in names.select(readers.preparation_kind(F.col("p"))).collect()] == ["csv", "faq", "text"]


def test_csv(spark, tmp_path):
    (tmp_path / "qa.csv").write_text("name;question;answer\nx;What?;This.\ny;;None\n")
    rows = readers.read_csv(spark, str(tmp_path / "qa.csv"))
    assert [tuple(r) for r in readers.csv_pairs(rows).collect()] == [("What?", "This.")]
    assert readers.csv_segments(rows).first()["segments"] == ["<|user|> What?", "<|assistant|> This."]
    assert readers.find_column(["data", "a"], readers.ANSWER_NAMES) == "a" and readers.find_column(["date", "title"], readers.ANSWER_NAMES) is None
    (tmp_path / "plain.csv").write_text("title,body\nA,A text that is long enough to count\n")
    plain = readers.read_csv(spark, str(tmp_path / "plain.csv"))
    assert readers.csv_segments(plain).first()["segments"] == ["title: A | body: A text that is long enough to count"]
    assert readers.csv_cells(plain).first()["column"] == "body"


def test_json(spark, tmp_path):
    objects = [
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "a"}]},
        {"question": "a", "answer": "b"},
        {"conversations": [{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"messages": [{"role": "user", "content": "c"}, {"role": "assistant", "content": "d"}]}]},
        {"text": "a text that is long enough to be kept", "deep": {"x": ["another text that is long enough"]}},
    ]
    (tmp_path / "a.json").write_text(json.dumps(objects))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, objects)) + "\nnot json\n")
    rows = readers.read_json_objects(spark, str(tmp_path / "*.json")).orderBy("pos")
    sizes = [len(r[0]) for r in rows.select(readers.json_conversation(F.col("object"))).collect()]
    assert sizes == [2, 1, 2, 4, 0]
    lines = readers.read_json_lines(spark, str(tmp_path / "b.jsonl"))
    assert lines.count() == 5 and readers.read_json_lines(spark, str(tmp_path / "b.jsonl"), keep_bad=True).first()["line"] == "not json"
    last = lines.where(F.contains("object", F.lit("deep")))
    assert set(last.select(readers.json_texts(F.col("object"))).first()[0]) == {"a text that is long enough to be kept", "another text that is long enough"}
    assert last.select(readers.json_fields(F.col("object"))).first()[0] == ["a text that is long enough to be kept"]
    assert [tuple(r) for r in readers.json_pairs(lines.where(F.contains("object", F.lit('"question"')))).collect()] == [("a", "b")]


def test_questions_in_text(spark):
    one = lambda f, t: [tuple(x) for x in spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]]
    assert one(readers.qa_pairs, "Q: Who grinds? A: The miller.\nQ: When? A: Daily.") == [("Who grinds?", "The miller."), ("When?", "Daily.")]
    assert ("What is a mill?", "A house of stones and water.") in one(readers.faq_pairs, "Question: What is a mill? Answer: A house of stones and water.")
    assert one(readers.dialogue_pairs, "User: hello there\nMiller: hm\nAssistant: good day\nHuman: and you?\nAI: fine") == [("hello there", "good day"), ("and you?", "fine")]


def test_layout_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def parse(content):
        if content == b"broken":
            raise ValueError("no")
        for k, part in enumerate(content.decode().split("|")):
            yield {"block_id": f"b{k}", "page_num": 1, "bbox": {"x0": 0.0, "y0": 1.0, "x1": 2.0, "y1": 3.0}, "text": part, "reading_order_idx": k}

    rows = readers.read_layout(spark, str(tmp_path), parse).collect()
    assert {(r["document_id"], r["text"]) for r in rows} == {("a", "one"), ("a", "two"), ("b", "")}
    assert {r["extraction_source"] for r in rows} == {None, "error:ValueError"}
    tried = spark.createDataFrame([("@@##$$%%&&**++==@@##", "good clean text", "")], "a string, b string, c string")
    assert tried.select(readers.best_text(F.col("a"), F.col("b"), F.col("c"), garbled=structure.garbled_reason)).first()[0] == "good clean text"


def books(spark):
    text = "Chapter 1: Stones\n\n" + "The stones are dressed each spring by hand. " * 12 + "\n\nChapter 2: Water\n\n" + "Water turns the wheel when the gate is open. " * 12
    return spark.createDataFrame([("book", text)], "document_id string, text string")


def test_structured_and_sinks(spark, tmp_path):
    out = phases.structured(books(spark))
    assert out.report.first()["is_valid"] and out.chunks.count() == 2
    sinks.write_chunks(out.chunks, str(tmp_path / "chunks"))
    saved = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "chunks")).collect()]
    assert [list(s) for s in saved] == [list(chunk.EXPORT)] * 2
    sinks.write_chat(out.chunks, str(tmp_path / "chat"))
    record = json.loads(spark.read.text(str(tmp_path / "chat")).first()[0])
    assert [m["role"] for m in record["messages"]] == ["system", "user", "assistant"]
    sinks.write_validation(out.report, out.fates, out.issues, str(tmp_path / "report"))
    sinks.write_structure(out.blocks, out.cleaned, str(tmp_path / "structure"))
    assert spark.read.json(str(tmp_path / "report/manifest")).count() == 4
    parts = sinks.text_parts(books(spark), 300)
    assert parts.agg(F.max("n_bytes")).first()[0] <= 300 and parts.first()["name"] == "book_sanitized_part001.txt"
    sinks.write_text_parts(parts, str(tmp_path / "parts"))
    assert spark.read.json(str(tmp_path / "parts/manifest")).count() == parts.count()


def test_phases(spark):
    done = phases.run(books(spark), Settings(training_target="openai"))
    assert list(done.frames) == ["extract", "split", "render", "assess"] and done.stopped is None
    assert done.frames["render"].count() == 2 and done.frames["assess"].first()["n"] == 2
    assert json.loads(done.frames["render"].first()["formatted"])["messages"][0]["role"] == "user"
    assert phases.run(books(spark).limit(0)).stopped == "extract"
    assert phases.run(books(spark), Settings(training_target="nope")).problem == "training_target"
    assert phases.run(books(spark), abort=lambda: True).problem == "aborted"
    again = phases.run(books(spark), phases=("extract",))
    assert list(again.frames) == ["extract"]


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_report_reads_tables_made_once(spark):
    """Texts are cut into blocks and packed once, not for each part of the report."""
    out = phases.structured(books(spark))
    assert "InPandas" not in planned(out.report) and "MapInArrow" not in planned(out.report) and "posexplode" not in planned(out.report)


def test_texts_are_cleaned_and_sorted_once(spark):
    done, out = phases.run(books(spark), Settings()), phases.structured(books(spark))
    assert planned(done.frames["extract"]).count("normal_form(") == 1
    assert planned(phases.render(out.chunks, Settings(training_target="alpaca", voice="casual"))).count("do not") == 1
    assert not re.search(r"windowspecdefinition\(document_id#\d+, (sec|special)#", planned(out.sections))
    assert "RowFrame, 1, unboundedfollowing" not in planned(structure.document_titles(out.blocks))


def test_short_texts_and_odd_characters_go(spark):
    rows = spark.createDataFrame([("a", "x\u200by\ue000z\u0007 \t one  two\u00a0three \n\n\n\nfour"), ("b", "short"), ("c", None)], "document_id string, text string")
    found = phases.extract(rows, Settings()).collect()
    assert [(r["document_id"], r["part"], r["text"]) for r in found] == [("a", 0, "xyz one two three\n\nfour")]


def test_settings(spark):
    assert Settings.from_env({"QUERNSTONE_MAX_TOKENS": "900", "QUERNSTONE_STRICT_MARKERS": "no"}) == Settings(max_tokens=900, strict_markers=False)
    assert Settings(min_tokens=900).problems() == ["tokens"]
    assert migrated({"max_chunk_tokens": 150}) == {"target_tokens": 500, "max_chunk_tokens": 800}
    assert migrated({"max_chunk_tokens": 600})["max_chunk_tokens"] == 600 and migrated({"target_tokens": 1, "max_chunk_tokens": 5})["max_chunk_tokens"] == 5
    rows = spark.createDataFrame([("aaaaaaaaaaab", "x.exe")], "t string, p string")
    assert rows.select(profile_threats(F.col("t"), PROFILES["balanced"])).first()[0] == ["low_entropy", "repetition"]
    assert rows.select(rule_violations(F.col("t"), F.col("p"))).first()[0] == ["blocked_extension"]


def test_model_calls(spark):
    def echo(prompts):
        if any("fail" in p for p in prompts):
            raise TimeoutError
        return [f"<|user|> q <|assistant|> {len(p)}" for p in prompts]

    rows = spark.createDataFrame([("1", "aa"), ("2", "bb"), ("3", "aa")], "id string, prompt string")
    assert model_calls.call(rows, echo).where("error is null").count() == 3
    assert model_calls.call(spark.createDataFrame([("1", "fail")], rows.schema), echo).first()["error"] == "TimeoutError"
    now = F.lit("2024-01-02").cast("timestamp")
    key = rows.where("id = '2'").select(cost.cache_key(F.col("prompt"), F.lit("gpt-4"))).first()[0]
    cache = spark.createDataFrame([(key, "kept", datetime.datetime(2025, 1, 1)), ("old", "gone", datetime.datetime(2020, 1, 1))], "cache_key string, response string, expires_at timestamp")
    found = {r["id"]: r for r in model_calls.call_cached(rows, echo, cache, "gpt-4", now).collect()}
    assert found["2"]["is_hit"] and found["2"]["response"] == "kept" and found["1"]["response"] == found["3"]["response"] != "kept"
    broke = {r["id"]: r["error"] for r in model_calls.call_cached(rows, echo, cache.limit(0), "gpt-4", now, budget=0.0).collect()}
    assert set(broke.values()) == {"over_budget"}
    best = model_calls.best_of(rows, echo, "qwen").first()
    assert (best["score"], best["attempt"]) == (100.0, 1)
    worst = model_calls.best_of(rows, lambda ps: ["bad"] * len(ps), "qwen", attempts=2).first()
    assert (worst["score"], worst["attempt"]) == (0.0, 1)
    roles = model_calls.hybrid_classify(spark.createDataFrame([("1", "What turns?")], "id string, text string"), lambda ps: ["assistant"] * len(ps)).first()
    assert (roles["role"], roles["method"]) == ("assistant", "model")
    scored = model_calls.score_with_model(spark.createDataFrame([("1", "text")], "id string, text string"), lambda ps: ['{"overall": 77}'] * len(ps)).first()
    assert scored["overall"] == 77
    fill = model_calls.template("Say {x} to {y}", "x", "y")
    assert spark.createDataFrame([({"x": "hi"},)], "m map<string,string>").select(fill(F.col("m"))).first()[0] == "Say hi to "


def test_quarantine(spark):
    rows = spark.createDataFrame([("a", "dangerous"), ("a", "dangerous"), ("b", "critical")], "t string, l string")
    at = F.lit("2024-01-05").cast("timestamp")
    table = quarantine.store(None, quarantine.entries(rows, "t", F.col("l"), F.array(F.lit("x")), at, F.lit("f"), F.lit("reject")))
    assert table.count() == 2
    decisions = table.where("content = 'a'").select("entry_id", F.lit("approved").alias("review_status"), F.lit("fine").alias("reviewer_notes"))
    reviewed = quarantine.review(table, decisions)
    assert quarantine.pending(reviewed).count() == 1 and quarantine.purge(reviewed, F.lit("2024-03-05").cast("timestamp")).count() == 1
    assert [r["threat_level"] for r in quarantine.high_threats(table).orderBy("rank").collect()] == ["critical", "dangerous"]
    queue = spark.createDataFrame([("i1", "pending", 50.0), ("i2", "pending", 40.0), ("i3", "completed", 10.0)], "item_id string, status string, score double")
    assert quarantine.remediation_next(queue).first()["item_id"] == "i2"
    moved = quarantine.transition(queue, spark.createDataFrame([("i2", "processing"), ("i3", "pending")], "item_id string, status string"))
    assert {r["item_id"]: r["status"] for r in moved.collect()} == {"i1": "pending", "i2": "processing", "i3": "completed"}


def test_stats(spark):
    rows = spark.createDataFrame([("user", "rules", 0.5), ("user", "model", 0.9)], "role string, method string, confidence double")
    assert stats.classification_stats(rows).where("role is null").first()["n"] == 2
    results = spark.createDataFrame([(True, 2.0, ["tone: a", "tone: b"]), (False, 1.0, ["format: c"])], "passed boolean, cost double, corrections array<string>")
    assert stats.batch_summary(results).first()["cost_per_passed"] == 3.0
    assert [tuple(r) for r in stats.common_corrections(results).collect()] == [("tone", 2), ("format", 1)]


def test_stream_of_files(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for k, value in enumerate(("same text", "same text", "other text")):
        (folder / f"{k}.txt").write_text(value)
    stream = watch.first_seen(watch.watch_texts(spark, str(folder), files_per_batch=2))
    watch.run_available(stream, lambda rows, _: seen.extend(r["text"] for r in rows.collect()), str(tmp_path / "checkpoint")).awaitTermination()
    (folder / "3.txt").write_text("other text")
    (folder / "4.txt").write_text("new text")
    watch.run_available(stream, lambda rows, _: seen.extend(r["text"] for r in rows.collect()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(seen) == ["new text", "other text", "same text"]


def test_windows_and_budget_of_a_stream(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, 1, 0, k), "call", 1.0) for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").withColumn("cost", F.lit(0.4))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = watch.event_rates(stream, window="10 minutes").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["n"] for r in spark.sql("select * from rates").collect()} == {10} and spark.sql("select * from rates").count() == 3
    alerts = watch.budget_watch(stream, 10.0).writeStream.outputMode("append").format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    alerts.awaitTermination()
    assert [r["threshold"] for r in spark.sql("select * from alerts order by threshold").collect()] == [0.5, 0.8, 0.9]


def test_watched(spark):
    rows = spark.createDataFrame([("a/b.txt",), ("a/~b.txt",), ("a/c.tmp",)], "p string")
    assert [r[0] for r in rows.select(watch.watched(F.col("p"), ["*.txt"], ["~*", "*.tmp"])).collect()] == [True, False, False]


def test_within_budget(spark):
    calls = spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(0.5).alias("cost"))
    assert cost.within_budget(calls, 20.0, "k").count() == 40
    assert cost.within_budget(calls, 1e9, "k").count() == 500 and cost.within_budget(calls, 0.0, "k").count() == 0


def test_voice_descriptions(spark):
    custom = spark.createDataFrame([("Pirate", "Talk like one"), ("Pirate", "Talk like one")], "name string, description string")
    rows = spark.createDataFrame([("Pirate",), ("casual",), ("a description of over twenty letters",), ("odd",)], "voice string")
    found = {r["voice"]: r["voice_description"] for r in personality.with_description(rows, custom).collect()}
    assert len(found) == 4 and found["Pirate"] == "Talk like one" and found["casual"].startswith("Casual") and found["odd"] == "odd"


def test_folder_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    before = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    assert {tuple(r) for r in watch.folder_changes(now, before).collect()} == {("b", "modified"), ("c", "created"), ("d", "deleted")}


def test_searches_have_k_rows(spark):
    from quernstone.operators import retrieval

    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(["the mill", "stone bread", "", "mill stone", "rye"])], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "mill"), (2, "nothing like it"), (3, "!")], "query_id long, query string")
    found = {}
    for r in retrieval.search(chunks, queries, 3).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], r["score"] > 0))
    assert {k: sorted(v) for k, v in found.items()} == {1: [(1, 0, True), (2, 3, True), (3, 1, False)], 2: [(1, 0, False), (2, 1, False), (3, 3, False)]}


def test_update_counts(spark):
    from quernstone.operators import dedup

    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    changes = spark.createDataFrame([(1, "x"), (3, "y")], "k long, v string")
    assert tuple(dedup.upsert_counts(table, changes, "k").first()) == (2, 2)
    assert sorted(map(tuple, dedup.upsert(table, changes, "k").collect())) == [(1, "x"), (2, "c"), (3, "y")]


def test_alerts_are_those_of_one_running_sum(spark):
    import random

    from quernstone.operators import cost

    rng = random.Random(2)
    rows = [(k, f"2024-01-0{1 + k % 3} 0{rng.randint(0, 2)}:{rng.randint(10, 59)}:00", round(rng.random(), 3)) for k in range(300)]
    calls = spark.createDataFrame(rows, "event_id long, t string, cost double").selectExpr("event_id", "cast(t as timestamp) as ts", "cost")
    found = sorted((str(r["date"]), r["threshold"], r["event_id"]) for r in cost.budget_alerts(calls, 40.0).collect())
    wanted, spent = [], {}
    for k, t, c in sorted(rows, key=lambda r: (r[1], r[0])):
        day, before = t[:10], spent.get(t[:10], 0.0)
        spent[day] = before + c
        wanted += [(day, a, k) for a in cost.ALERTS if before < a * 40 <= before + c]
    assert len(found) > 5 and found == sorted(wanted)
