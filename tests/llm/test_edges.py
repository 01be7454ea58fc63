"""Every query and stage on empty tables, and on nulls, ties and odd columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quernstone.llm import queries

LONG = "Grind the corn slowly. " * 20_000
TEXTS = [None, "", " ", ".", "\n\n\n", "!!!", "one", "É", "\U0001f600", "a\u0000b", LONG, LONG, "the same text here", "the same text here", "THE SAME TEXT HERE", "<p>markup & entities &amp;", "x" * 50_000, "1.2.3.4 a@b.co +1 (743) 555-3824"]


def tables(spark, folder, empty):
    docs = spark.createDataFrame([(k if k != 7 else None, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src", None) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "de", "src", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = {"label": F.lit(1), "salt": F.lit(2), "print": F.lit(3), "rank": F.lit(4), "_dropped": F.lit(5), "spans": F.lit("x"), "count": F.lit(6)}
    made = {
        "documents": docs.withColumns(odd),
        "pages": spark.createDataFrame([(0, None, None), (None, "http://a.b/c", "<p>x"), (1, "", ""), (1, "", ""), (2, "http://[", "<<<>>><div class='"), (3, "http://a.b/c", "<div>" * 3000 + "deep")], "page_id long, url string, html string").withColumns({"path": F.lit("p"), "host": F.lit("h"), "text": F.lit("t"), "salt": F.lit(1)}),
        "embeddings": spark.createDataFrame([(0, None, 1), (50, [1.0, None], 1), (100, [1.0, 2.0], 1), (150, [1.0, 2.0], None), (150, [1.0, 2.0], None), (None, [3.0], 1), (200, [5.0], 1)], "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "score": F.lit(2), "cb": F.lit(3)}),
        "labels": spark.createDataFrame([(1, None, None), (None, 1, 0), (10, 1, 0), (10, 0, 0), (12, 0, 1), (999, 1, 0)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("clash"), "domain": F.lit("d")}),
    }
    for name, df in made.items():
        (df.limit(0) if empty else df).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), True)


#: Rows (in order of their values as text) that hold whatever method gives them.
HELD = {
    "op1_language_id": lambda r: {x["lang_pred"] for x in r if x["doc_id"] in (0, 1, 2, 3, 4, 5)} == {"und"} and {x["score"] for x in r if x["doc_id"] in (0, 1, 2)} == {0.0},
    "op2_lm_score": lambda r: {(x["n_words"], x["score"]) for x in r if x["doc_id"] in (0, 1, 2, 4)} == {(0, 0.0)} and {x["n_words"] for x in r if x["doc_id"] in (10, 11)} == {80_000},
    "op3_pii": lambda r: {(x["n_email"], x["n_ip"], x["n_card"], x["n_phone"]) for x in r if x["doc_id"] == 17} == {(1, 1, 0, 1)} and {x["spans"] for x in r if x["doc_id"] in (0, 1)} == {""},
    "op4_html_text": lambda r: sorted(x["text"] for x in r) == ["", "", "", "<<<>>>", "deep", "x"],
    "op5_byte_bpe": lambda r: {x["n_tokens"] for x in r if x["doc_id"] in (0, 1)} == {0} and len({x["ids_sha256"] for x in r if x["doc_id"] in (10, 11)}) == 1,
    "op6_simhash": lambda r: {x["component_id"] for x in r if x["doc_id"] in (0, 1, 2, 4)} == {0} and {x["component_id"] for x in r if x["doc_id"] in (12, 13, 14)} == {12},
    "op7_top_k": lambda r: sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in r) == TOP,
    "op8_substring_dedup": lambda r: {x["text"] for x in r if x["doc_id"] in (0, 1, 11)} == {""} and all(x["n_removed"] == 0 for x in r if x["doc_id"] in (12, 13, 14)),
    "op9_exact_dedup": lambda r: {(x["keep_id"], x["group_size"]) for x in r if x["doc_id"] in (12, 13, 14)} == {(14, 3)} and sorted(x["kept"] for x in r if x["doc_id"] == 3) == [True, True],
    "op10_mixing": lambda r: all(x["rate"] >= 0 and x["copies"] in (int(x["rate"]), int(x["rate"]) + 1) for x in r) and {x["rate"] for x in r if x["n_tokens"] == 0} == {1.0},
}
# of 100 and twice 150: [1, 2]; 200: [5]; the rows of 150 ask together
_V = {100: [(256, 512)], 150: [(256, 512), (256, 512)], 200: [(1280, 0)]}
TOP = sorted((q, k + 1, v, -s) for q in _V for k, (s, v) in enumerate(sorted((-(a[0] * b[0] + a[1] * b[1]), v) for a in _V[q] for v in _V if v != q for b in _V[v])[:5]))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    if name == "op4_html_text":
        assert len(rows) == 6
    elif name != "op7_top_k":
        assert len(rows) == len(TEXTS) + 1
    assert HELD[name](rows), rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_pipeline_on_odd_rows(spark, odd):
    rows = corpus_pipeline.run(spark, odd).collect()
    assert {"doc_id", "n_tokens", "ids"} <= set(rows[0].asDict())


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, odd, k):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert corpus_pipeline.STAGES[k][1](spark, docs, odd).columns == docs.columns


def test_pipeline_against_its_stages(spark):
    """run() is the stages one after the other; what each drops or repeats takes effect."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        n.append(docs.count())
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == n[-1]
    assert n[1] < n[0] <= 200 and n[2] <= n[1]
