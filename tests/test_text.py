"""Goldens of text functions, filters, sanitiser, formats, quality and markup."""

import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from quernstone.functions import filters, formats, markup, normalise, personality, quality, sanitise, text, threats
from quernstone.operators import contract, conversation, cost, dedup, legacy_chunk


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]




@pytest.mark.parametrize(
    "raw,want",
    [("  Hello   world  ", "Hello world"), ("one line\nwrapped", "one line wrapped"), ("para one\n\n\npara two", "para one\n\npara two"), ("End.next", "End. next"), ("endStart", "end. Start"), ("1. item", "item"), ("• item", "item"), ("> quoted", "quoted"), (None, "")],
)
def test_preprocess(spark, raw, want):
    assert one(spark, normalise.preprocess(F.col("t")), raw) == want


@pytest.mark.parametrize("raw,starts", [("A sufficiently long text", ""), ("", "Input text is empty"), (None, "Input text is empty"), ("short", "Input text is too short"), ("12345678901", "Input text contains no")])
def test_input_problem(spark, raw, starts):
    assert one(spark, text.input_problem(F.col("t")), raw).startswith(starts)
    assert bool(one(spark, text.input_problem(F.col("t")), raw)) == bool(starts)


QUESTIONS = ["What is machine learning?", "How do I grind corn?", "Can you explain this?", "Why does the wheel turn?", "Please tell me about stones?"]
ANSWERS = ["The wheel turns because water pushes it.", "This is the way it has always been done.", "It depends on the season and the rain. Therefore we wait.", "You should dress the stone first.", "According to the miller, bread needs time."]


@pytest.mark.parametrize("value,role", [*((q, "user") for q in QUESTIONS), *((a, "assistant") for a in ANSWERS)])
def test_roles(spark, value, role):
    assert one(spark, conversation.classified_role(F.col("t"), F.lit(None).cast("string")), value) == role


def test_segments(spark):
    assert one(spark, text.segments(F.col("t")), "What is it? It is a mill by the river.\n\nshort\n\nAnother paragraph here.") == ["What is it?", "It is a mill by the river.", "Another paragraph here."]


def test_sentences_keep_abbreviations(spark):
    assert one(spark, text.prose_sentences(F.col("t")), "Mr. Miller e.g. grinds. He sleeps! Does he?") == ["Mr. Miller e.g. grinds.", "He sleeps!", "Does he?"]


def test_tokens(spark):
    assert [one(spark, text.tokens_by_ratio(F.col("t")), v) for v in (None, "", "one", "a b c d")] == [0, 0, 1, 5]


# filters


def test_language_score_counts_characters(spark):
    clean = "The stones grind seven times."
    assert one(spark, filters.language_score(F.col("t")), clean) == 1.0
    assert one(spark, filters.language_score(F.col("t"), compat=True), clean) < 0.1


def test_quality_issues(spark):
    assert one(spark, filters.quality_issues(F.col("t")), "Buy now!!!!! TODO") == ["spam:buy now", "gibberish", "incomplete:todo"]


def test_policy(spark):
    found = one(spark, filters.policy_result(F.col("t")), "Mail a@b.com or 555-123-4567; all rights reserved; my password")
    assert found["errors"] == ["pii:email", "pii:phone", "licence:all rights reserved"] and found["warnings"] == ["sensitive:password"] and not found["passed"]


def test_gate(spark):
    rows = spark.createDataFrame([("a.txt", 500), ("a.exe", 500), ("a.txt", 5), ("b.JSON", 20_000_000), (None, None)], "p string, n long")
    assert [r[0] for r in rows.select(filters.gate_result(F.col("p"), F.col("n"))["errors"]).collect()] == [[], ["bad_extension"], ["too_small"], ["too_large"], ["missing"]]


# sanitiser


def test_sanitise(spark):
    clean = one(spark, sanitise.sanitise(F.col("t")), "A perfectly ordinary sentence about milling the corn.")
    assert (clean["threat_level"], clean["threats"], clean["action"]) == ("clean", [], "accept")
    hidden = one(spark, sanitise.sanitise(F.col("t")), "Hid​den w‌ords about milling the corn are here today.")
    assert hidden["threats"] == ["invisible_chars"] and hidden["sanitised_text"].startswith("Hidden words")
    bidi = one(spark, sanitise.sanitise(F.col("t")), "Direction ‮ override in a sentence about corn.")
    assert (bidi["threat_level"], bidi["action"], bidi["sanitised_text"]) == ("dangerous", "reject", None)
    assert one(spark, sanitise.sanitise(F.col("t")), "ﬁne ﬂour for the bakers of the town")["sanitised_text"].startswith("fine flour")
    assert one(spark, sanitise.sanitise(F.col("t"), aggressive=True), "Hid​den words about milling corn are here.")["action"] == "reject"


def test_repeated_tokens(spark):
    assert [tuple(x) for x in one(spark, sanitise.repeated_tokens(F.col("t")), "go go Go go stop now please mill")] == [("go", 4)]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_byte_limits(spark, values):
    values = [v.encode("utf-8", "ignore").decode() for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", normalise.fit_bytes(F.col("t"), 17).alias("cut"), normalise.split_to_bytes(F.col("t"), 17).alias("parts")).collect()
    for r in rows:
        assert r["cut"] == r["t"].encode()[:17].decode(errors="ignore")
        assert all(len(p.encode()) <= 17 for p in r["parts"])
        assert "".join("".join(r["parts"]).split()) == "".join(r["t"].split()) or len(r["t"].encode()) <= 17


def test_fine_tune_clean(spark):
    found = one(spark, normalise.fine_tune_clean(F.col("t")), "a ​b\u0007 c\r\nd  \n\n\n\ne�")
    assert (found["text"], found["removed_control_chars"], found["removed_invisible_chars"], found["removed_noncharacters"]) == ("a b c\nd\n\ne", 1, 1, 2)


def test_sizes():
    assert [normalise.size_in_bytes(*x) for x in ((1, "kb"), ("2", "MB"), (-1, "mb"), ("x", "gb"), (3, "what"))] == [1024, 2 << 20, 0, 0, 3 << 20]


# formats

TURNS = [("user", "What turns?"), ("assistant", "The wheel."), ("user", "Why so?"), ("assistant", "Water.")]


@pytest.mark.parametrize("target,marker", [("qwen", "<|user|>"), ("alpaca", "### Instruction:"), ("chatml", "<|im_start|>"), ("sharegpt", '"role"'), ("llama2", "[INST]"), ("zephyr", "- role: user"), ("instruct", "Question:"), ("openai", "system"), ("claude", "Human:"), ("minimalist", "User:")])
def test_rendered_markers(spark, target, marker):
    rows = spark.createDataFrame([(TURNS,)], "s array<struct<role:string,content:string>>")
    formatted = rows.select(formats.render(F.col("s"), target).alias("x")).first()["x"]
    assert marker in formatted and ("<|user|>" in formatted) == (target == "qwen")


@pytest.mark.parametrize("target", formats.PARSERS)
def test_parse_of_rendered(spark, target):
    rows = spark.createDataFrame([(TURNS,)], "s array<struct<role:string,content:string>>")
    parsed = rows.select(formats.parse(formats.render(F.col("s"), target), target).alias("x"), formats.detect(formats.render(F.col("s"), target)).alias("d")).first()
    assert [tuple(x) for x in parsed["x"]] == TURNS and parsed["d"] == target


def test_unpaired_turns_are_left_out(spark):
    rows = spark.createDataFrame([([("system", "s"), ("assistant", "early"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d")],)], "s array<struct<role:string,content:string>>")
    assert [tuple(x) for x in rows.select(formats.pairs(F.col("s")).alias("x")).first()["x"]] == [("b", "c")]


def test_sharegpt_dialects_and_detection_of_long_json(spark):
    assert [tuple(x) for x in one(spark, formats.parse(F.col("t"), "sharegpt"), '[{"from":"human","value":"a"},{"role":"assistant","content":"b"},{"role":"system","content":"c"}]')] == [("user", "a"), ("assistant", "b")]
    assert one(spark, formats.detect(F.col("t")), '[{"role":"user","content":"' + "x" * 2000 + '"}]') == "sharegpt"
    assert one(spark, formats.convert(F.col("t"), "qwen"), "nothing here")["error"] == "no segments found"


def test_markers_of_chat_json(spark):
    good = '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'
    assert one(spark, formats.has_markers(F.col("t"), "openai"), good) and not one(spark, formats.has_markers(F.col("t"), "openai"), "{}") and not one(spark, formats.has_markers(F.col("t"), "gpt_jsonl"), "no")
    assert formats.protocol("unknown")[0] == "qwen" and formats.protocol("mistral")[0] == "chatml"


# quality


def test_rule_scores_and_grade(spark):
    found = one(spark, quality.rule_scores(F.col("t")), "word " * 60 + ". Two. Three.")
    assert (round(found["accuracy"], 6), found["fluency"], found["coherence"], found["training_readiness"]) == (71.3, 66.0, 65.0, 70.0)
    assert [one(spark, quality.grade(F.lit(float(x)))) for x in (95, 85, 75, 65, 5)] == list("ABCDF")


def python_coherence(value):
    import re
    import statistics

    ss = [s.strip() for s in re.split(r"[.!?]+", value) if len(s.strip()) > 5]
    if len(ss) < 2:
        return 50.0
    sizes = [len(s.split()) for s in ss]
    low = value.lower()
    sets = [set(s.lower().split()) for s in ss]
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    flow = 0.0
    for a, b in zip(ss, ss[1:], strict=False):
        flow += any(c in b.lower()[:50] for c in quality.CONNECTORS) + 0.5 * bool(set(a.lower().split()) & set(b.lower().split()))
    score = 70 + min(20, 2 * sum(w in low for w in quality.TRANSITIONS)) + min(10, sum(w in quality.PRONOUNS for w in low.split())) + 15 * sum(pairs) / len(pairs) + 10 * min(1, flow / (len(ss) - 1))
    return max(0, min(100, score - min(15, statistics.variance(sizes) / statistics.mean(sizes) * 10)))


@pytest.mark.parametrize("value", ["The wheel turns. The water pushes the wheel. However it stops, because they sleep.", "One short. Tiny.", "", "It grinds this corn! It grinds that corn? Therefore these stones wear out quickly in the long dry season."])
def test_coherence_score(spark, value):
    assert one(spark, quality.coherence(F.col("t")), value) == pytest.approx(python_coherence(value))


def test_compliance(spark):
    assert one(spark, quality.compliance(F.col("t"), "qwen"), "<|user|> a <|assistant|> b") == 100
    assert one(spark, quality.compliance(F.col("t"), "qwen"), "plain") == 0
    assert one(spark, quality.compliance(F.col("t"), "chatml"), "<|im_start|>a") == 20
    assert [one(spark, quality.compliance(F.col("t"), "sharegpt"), v) for v in ('[{"from":"a","value":"b"}]', '[{"x":1}]', '{"a":1}', "no")] == [100, 80, 50, 0]
    assert one(spark, quality.compliance(F.col("t"), "other"), "x") == 0


def test_completeness(spark):
    whole = "In conclusion, the stones were dressed and the wheel was turned by water."
    assert one(spark, quality.completeness(F.col("t")), whole) == 100
    assert one(spark, quality.completeness(F.col("t"), compat=True), whole) == 75


def test_tiers_and_routes(spark):
    assert [one(spark, quality.tier(F.lit(x))) for x in (96.0, 90.0, 75.0, 10.0)] == ["premium", "standard", "basic", "remediation"]
    scored = one(spark, quality.scored(F.col("t"), "qwen"), "Short text.")
    assert scored["route"] == "remediate" and "compliance" in scored["shortfalls"]


def test_model_scores(spark):
    assert one(spark, quality.parsed_model_scores(F.col("t")), 'Sure: {"accuracy": 90, "overall": 80, "confidence": 0.9} done')["overall"] == 80
    loose = one(spark, quality.parsed_model_scores(F.col("t")), "Accuracy: 90, fluency: 80, confidence: 2")
    assert (loose["accuracy"], loose["fluency"], loose["coherence"], loose["confidence"], loose["overall"]) == (90, 80, 50, 1.0, 64)
    assert one(spark, quality.parsed_model_scores(F.col("t")), None)["overall"] == 50


# markup and threats


def test_html(spark):
    found = one(spark, markup.html_result(F.col("t")), '<div onclick="x()"><script>eval(1)</script><p>')
    assert found["dangerous_tags"] == {"script": 1} and found["dangerous_attributes"] == {"onclick": 1}
    assert [tuple(x) for x in found["unbalanced_tags"]] == [("div", 1), ("p", 1)]
    assert r"eval\s*\(" in found["injections"]


def test_json_xml_markdown_code(spark):
    assert one(spark, markup.json_result(F.col("t")), '{"a": ["javascript:x"]}')["suspicious"] == ["a[0]: javascript:"]
    assert one(spark, markup.json_result(F.col("t")), "{'a': 1,}")["issues"] == ["trailing_comma", "single_quotes"]
    xml = one(spark, markup.xml_result(F.col("t")), "<a><b><c/></b><b/></a>")
    assert (xml["is_valid"], xml["root_tag"], xml["n_elements"], xml["max_depth"]) == (True, "a", 4, 2)
    assert not one(spark, markup.xml_result(F.col("t")), "<a>")["is_valid"] and not one(spark, markup.xml_result(F.col("t")), None)["is_valid"]
    md = one(spark, markup.markdown_result(F.col("t")), "# T\n[x](javascript:y) `c` ```\ncode")
    assert (md["headers"], md["links"], md["suspicious_links"], md["errors"]) == (1, 1, 1, ["unbalanced_code_block", "unbalanced_inline_code"])
    for value, language, errors in (("def f(:\n import x", "python", ["syntax"]), ("def f():\n    return 1\nimport x", "python", []), ("var x = {", "javascript", ["unbalanced {}"]), ("f(]", "unknown", ["mismatched ( ]"])):
        assert one(spark, markup.code_language(F.col("t")), value) == language
        assert one(spark, markup.code_errors(F.col("t"), markup.code_language(F.col("t"))), value) == errors


def test_threats(spark):
    assert one(spark, threats.look_alikes(F.col("t")), "pаss")["count"] == 1
    assert "latin_cyrillic" in one(spark, threats.script_mixing(F.col("t")), "hello привет")
    assert one(spark, threats.adversarial_patterns(F.col("t")), "h3ll0 w0rld h1") == ["leetspeak"]
    assert one(spark, threats.threat_score(F.col("t")), "An ordinary sentence about the mill and its wheel.") < 10
    assert one(spark, threats.threat_score(F.col("t")), "") is not None
    stats = one(spark, threats.character_stats(F.col("t")), "aabbbc")
    assert (stats["mean_frequency"], stats["median_frequency"], stats["outliers"]) == (2.0, 2.0, 2)


# personality, contract, costs, dedup, chunks


def test_voices(spark):
    assert one(spark, personality.rewrite(F.col("t"), F.lit("casual"), 0.8), "Hello, I do not know. Thank you") == "Hey, I don't know. Thanks"
    assert one(spark, personality.rewrite(F.col("t"), F.lit("formal"), 0.8), "Hey, I can't. Thanks") == "Hello, I cannot. Thank you"
    assert one(spark, personality.rewrite(F.col("t"), F.lit("friendly"), 0.8), "This is good") == "This is really good!"
    assert one(spark, personality.resolve_name(F.col("t")), "custom: Pirate") == "pirate" and one(spark, personality.resolve_name(F.col("t")), None) == "professional"


def test_repairs(spark):
    assert one(spark, personality.has_placeholder(F.col("t")), "a [thing] here") and not one(spark, personality.is_complete(F.col("t")), "to be continued...")
    assert one(spark, personality.repair_format(F.col("t"), "qwen"), "An answer") == "<|user|>\nPlease explain this information:\n<|assistant|>\nAn answer."


GOOD = dict(id="record_01", format="qwen", content="<|user|> a question <|assistant|> an answer", quality_score=96.0, accuracy_score=97.0, personality="casual", source_file="a.txt", processing_timestamp="2024-01-01T00:00:00", validation_passed=True, tier="premium", metadata={"a": "b"})


@pytest.mark.parametrize(
    "change,want",
    [({}, []), ({"id": "short"}, ["id:too_short"]), ({"id": "bad id here"}, ["id:bad_pattern"]), ({"format": "x"}, ["format:not_allowed"]), ({"content": None}, ["content:missing"]), ({"accuracy_score": 94.0}, ["accuracy_score:too_small"]), ({"quality_score": 101.0}, ["quality_score:too_large"]), ({"processing_timestamp": "now"}, ["processing_timestamp:bad_pattern"]), ({"metadata": None}, ["metadata:missing"])],
)
def test_contract(spark, change, want):
    rows = spark.createDataFrame([{**GOOD, **change}], contract.SCHEMA)
    assert contract.validate(rows).first()["violations"] == want


def test_sign_off_and_uniform(spark):
    rows = spark.createDataFrame([GOOD], contract.SCHEMA)
    assert contract.sign_off(rows).first()["signed_off"] and not contract.sign_off(rows.limit(0)).first()["signed_off"]
    assert contract.uniform(rows).first()["is_final"]
    shuffled = rows.select(*reversed(rows.columns)).withColumnRenamed("tier", "Tier-x")
    assert set(contract.lint(shuffled).first()["lint"]) == {"missing:tier", "order", "naming:Tier-x"}


def test_dedup(spark):
    docs = spark.createDataFrame([(2, "Same  Text"), (1, "same text "), (3, "other"), (4, None), (5, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in dedup.deduplicate(docs).collect()} == {1, 3, 4}
    again = dedup.deduplicate(dedup.deduplicate(docs))
    assert again.count() == 3


def test_cost_estimates():
    assert cost.daily_estimate(100, 4000, "gpt-4", "gpt-4", 100.0) == {"classification": pytest.approx(3.6), "enhancement": pytest.approx(2.7), "total": pytest.approx(6.3), "within_limit": True}


def test_chunk_packing():
    assert legacy_chunk._packed(["a b c d"] * 5, 6, 1) == ["a b c d a b c d"] * 4
    assert legacy_chunk._token_runs(" ".join(map(str, range(30))), 15, 0) == [" ".join(map(str, range(20))), " ".join(map(str, range(20, 30)))]
    runs = legacy_chunk._token_runs(" ".join(map(str, range(500))), 150, 1)
    assert set(" ".join(runs).split()) == set(map(str, range(500))) and len(runs) == 3


def test_strategies(spark):
    docs = spark.createDataFrame([(1, "BENEFITS\nMany of them.\nAnd more.\n1. How it works\nWell."), (2, "Q: Who?\nThe miller.\nA: He grinds.\nDaily."), (3, None)], "doc_id long, text string")
    assert [(r["question"], r["answer"]) for r in legacy_chunk.heading_pairs(docs.where("doc_id = 1")).orderBy("pos").collect()] == [("What are the benefits of benefits?", "Many of them. And more."), ("How does how it works work?", "Well.")]
    assert [(r["question"], r["answer"]) for r in legacy_chunk.marker_pairs(docs.where("doc_id = 2")).collect()] == [("Who?", "He grinds. Daily.")]
    with pytest.raises(ValueError):
        legacy_chunk.pairs(docs, "semantic")


def test_mean_overlap_of_sentences(monkeypatch):
    """All pairs by plain sets; by a matrix product and by lists of each word's sentences."""
    import random

    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        sets = [{rng.randrange(40) for _ in range(rng.randint(0, 8))} for _ in range(rng.randint(0, 30))]
        pairs = [(a, b) for k, a in enumerate(sets) for b in sets[k + 1 :]]
        wanted = sum(len(a & b) / max(1, len(a | b)) for a, b in pairs) / len(pairs) if pairs else 0.5
        words_of, sizes = np.array([x for s in sets for x in s], int), np.array([len(s) for s in sets], int)
        for rows in (2048, 0):
            monkeypatch.setattr(quality, "DENSE_ROWS", rows)
            assert abs(quality.mean_overlap(words_of, sizes) - wanted) < 1e-12


def test_window_entropies_by_counts():
    import math

    import numpy as np

    from quernstone.functions import threats

    text = "the mill grinds " * 9 + "\U0001f600" * 30 + "zzzzzzzzzz" * 4
    wanted = []
    for at in range(0, len(text) - 49, 25):
        window = text[at : at + 50]
        wanted.append(-sum(window.count(c) / 50 * math.log2(window.count(c) / 50) for c in set(window)))
    assert np.allclose(threats._entropies(sanitise.code_points(text), 50), wanted)
    assert len(threats._entropies(sanitise.code_points("short"), 50)) == 0


def test_long_text_of_many_sentences_is_scored(spark):
    """A text of five megabytes, in which all sentences share a word."""
    text = "".join(f"The w{k % 997} of v{k % 613} is here. " for k in range(25_000))
    row = spark.createDataFrame([(text,)], "t string").select(quality.scored(F.col("t"), "qwen").alias("s")).first()["s"]
    assert 0 < row["coherence"] <= 100
