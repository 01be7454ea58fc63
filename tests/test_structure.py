"""Goldens of blocks, furniture, sections, chunks, validation and retrieval."""

import pytest
from pyspark.sql import functions as F

from quernstone.operators import chunk, retrieval, structure, validate
from quernstone.operators.store import Work

BLOCK = "document_id string, block_id string, page_num int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, is_heading boolean, heading_level int, font_size double, is_bold boolean, reading_order_idx int"


def blocks(spark, rows):
    """rows: (block_id, page, y0, y1, text[, heading_level])."""
    out = []
    for k, (block_id, page, y0, y1, text, *level) in enumerate(rows):
        n = level[0] if level else 0
        out.append(("doc", block_id, page, (50.0, float(y0), 550.0, float(y1)), text, n > 0, n, 16.0 if n else 12.0, n > 0, k))
    return spark.createDataFrame(out, BLOCK)


def test_furniture_goes_and_is_audited(spark):
    rows = blocks(spark, [("h1", 1, 20, 40, "Quarterly Mill Report"), ("b1", 1, 100, 140, "The stones were dressed in spring."), ("f1", 1, 750, 770, "Page 1"), ("h2", 2, 20, 40, "Quarterly Mill Report"), ("b2", 2, 100, 140, "The wheel was mended in autumn."), ("f2", 2, 750, 770, "Page 2")])
    cleaned = structure.clean_furniture(rows)
    assert {r["block_id"] for r in cleaned.where("removal_type is null").collect()} == {"b1", "b2"}
    audit = structure.furniture_audit(cleaned).collect()
    assert len(audit) == 4 and {r["removal_type"] for r in audit} == {"page_number", "running_header"}


def test_near_furniture_and_inline_furniture(spark):
    rows = blocks(spark, [("h1", 1, 20, 40, "Quarterly Mill Report"), ("x1", 1, 300, 320, "Quarterly Mill Reports"), ("h2", 2, 20, 40, "Quarterly Mill Report"), ("b2", 2, 300, 400, "Quarterly Mill Report\nThe wheel turns.")])
    found = {r["block_id"]: r for r in structure.clean_furniture(rows).collect()}
    assert found["x1"]["removal_type"] == "running_header"
    assert found["b2"]["removal_type"] == "running_header"  # the header is part of it
    names = spark.createDataFrame([("quarterly mill reprot", ["quarterly mill report"]), ("another line here", ["quarterly mill report"])], "t string, f array<string>")
    assert [r[0] for r in names.select(structure.resembles("t", "f")).collect()] == [True, False]


def test_one_page_has_no_furniture(spark):
    rows = blocks(spark, [("a", 1, 20, 40, "Same line"), ("b", 1, 60, 80, "Same line")])
    assert structure.repeated_furniture(rows).count() == 0


def test_tags(spark):
    rows = blocks(spark, [("bio", 1, 100, 120, "About the Author: a miller."), ("toc", 1, 130, 150, "Table of Contents"), ("promo", 1, 160, 180, "Visit our website at https://example.com")])
    found = {r["block_id"]: r["tags"] for r in structure.clean_furniture(rows).collect()}
    assert found == {"bio": ["biography"], "toc": ["toc"], "promo": ["promotional"]}


def test_titles(spark):
    chapters = blocks(spark, [("a", 1, 20, 40, "Chapter 1", 1), ("b", 1, 60, 90, "x" * 100)]).withColumn("document_id", F.lit("12-goals-guide"))
    assert structure.document_titles(chapters).first()["title"] == "Goals Guide"
    titled = blocks(spark, [("a", 1, 20, 40, "Milling Strategy Handbook", 1), ("b", 2, 60, 90, "x" * 100)])
    assert structure.document_titles(titled).first()["title"] == "Milling Strategy Handbook"


def hierarchy(spark, rows, title="Handbook"):
    cleaned = structure.clean_furniture(blocks(spark, rows))
    return structure.assign_sections(cleaned, spark.createDataFrame([("doc", title)], "document_id string, title string"))


STEPS = [
    ("s1", 1, 20, 40, "Step One: The Destination", 1),
    ("t1", 1, 60, 80, "Define Your Goals", 2),
    ("p1", 1, 90, 200, "Goals should be written down where everybody can see them."),
    ("s2", 2, 20, 40, "Step Two: The Audience", 1),
    ("p2", 2, 60, 80, "Know who eats the bread."),
    ("t2", 2, 90, 100, "Tools & Resources", 2),
    ("p3", 2, 110, 200, "A sharp chisel and a level stone."),
]


def test_hierarchy(spark):
    found = {r["block_id"]: r for r in hierarchy(spark, STEPS).where("is_content").collect()}
    assert found["p1"]["section_path"] == "Handbook > Step One: The Destination > Define Your Goals"
    assert found["p3"]["section_path"] == "Handbook > Step Two: The Audience > Tools & Resources"
    assert found["p2"]["section_id"] == "doc_sec_02" and found["p3"]["section_id"] == "doc_sec_02_sub_01"
    assert found["p3"]["parent_section_id"] == "doc_sec_02"


def test_subsections_before_any_section_hang_off_the_document(spark):
    rows = [("t1", 1, 20, 40, "Overview", 2), ("p1", 1, 60, 80, "First things first."), ("t2", 1, 90, 95, "Checklist", 2), ("p2", 1, 100, 110, "Second things then.")]
    found = {r["block_id"]: r["section_id"] for r in hierarchy(spark, rows).where("is_content").collect()}
    assert found == {"p1": "doc_root_sub_01", "p2": "doc_root_sub_02"}


def test_special_blocks_have_sections_of_their_own(spark):
    rows = [("toc", 1, 20, 40, "Table of Contents\nOne ..... 3\nTwo ..... 4"), ("s1", 1, 60, 80, "Chapter 1", 1), ("p1", 1, 90, 95, "Grind."), ("bio", 2, 20, 40, "About the author\nA miller.")]
    found = {r["block_id"]: r["section_type"] for r in hierarchy(spark, rows).where("is_content").collect()}
    assert found == {"toc": "toc", "p1": "section", "bio": "biography"}


def test_tips_of_a_subsection_stay_in_one_chunk(spark):
    rows = [("s1", 1, 20, 40, "Step One: Goals", 1), ("t1", 1, 50, 60, "Four Tips for Goal Setting", 2)]
    for k in range(4):
        rows += [(f"l{k}", 1, 70 + k, 71 + k, f"Tip {k + 1}: Aim well"), (f"e{k}", 1, 71 + k, 72 + k, f"Explanation {k} of how to aim with care and patience over many a season.")]
    rows = [r for r in rows]
    cleaned = structure.clean_furniture(blocks(spark, rows))
    assigned = structure.assign_sections(cleaned, spark.createDataFrame([("doc", "Book")], "document_id string, title string"))
    chunks = chunk.chunk_sections(assigned).collect()
    assert len(chunks) == 1 and chunks[0]["token_count"] <= 800
    assert all(f"Tip {k}" in chunks[0]["source_text"] for k in range(1, 5))
    assert chunks[0]["embedding_text"].startswith("Document: Book\nSection: Step One: Goals\nSubsection: Four Tips for Goal Setting\n\n")
    assert "complete_subsection" in chunks[0]["quality_flags"]


def test_long_units_split_by_sentence_with_one_of_overlap():
    text = " ".join(f"Sentence number {k} has exactly eight words here." for k in range(60))
    groups = list(chunk.sentence_groups(text, 100))
    assert all(chunk.n_tokens(g) <= 110 for g, _ in groups) and [m for _, m in groups] == [True] * (len(groups) - 1) + [False]
    for (a, _), (b, _) in zip(groups, groups[1:], strict=False):
        assert b.startswith(a.split(". ")[-1].rstrip("."))


def test_labels_fuse_with_the_next_block():
    assert list(chunk.units([("a", "Tip 1: Aim", 1), ("b", "Take your time with it.", 1), ("c", "Label at the end", 2)])) == [("Tip 1: Aim\nTake your time with it.", ["a", "b"], 1), ("Label at the end", ["c"], 2)]


GARBLED = [("0n the end`V^PSSILSLM[^P[O", "unmapped_glyph_sequence"), ("This is a perfectly clean sentence about bread.", None), ("abc\u0007def ghi", "contains_1_control_chars"), ("@@##$$%%&&**++==@@##", "high_symbol_ratio_1.00"), ("", None), (None, None)]


def test_garbled(spark):
    rows = spark.createDataFrame(GARBLED, "t string, want string").select(structure.garbled_reason(F.col("t")), "want").collect()
    assert all(got == want for got, want in rows), rows


def chunks(spark, rows):
    return spark.createDataFrame([("doc", f"c{k}", path, text, text, flags, ids) for k, (path, text, flags, ids) in enumerate(rows)], "document_id string, chunk_id string, section_path string, source_text string, embedding_text string, quality_flags array<string>, source_block_ids array<string>")


def test_chunk_issues_and_report(spark):
    parts = chunks(spark, [("A > B", "A clean chunk of text about stones.", ["clean"], ["b1"]), ("A > C", "`^^[]\\~~`` junk of glyphs", ["clean"], ["b2_body"]), ("A", "tiny", [], []), ("", "Step One and Step Two are both in here.", [], ["b3"]), ("A > TOC", "Step One ... Step Two ...", ["is_toc"], [])])
    issues = validate.chunk_issues(parts)
    found = {(r["chunk_id"], r["issue_type"]) for r in issues.collect()}
    assert found == {("c1", "garbled_text"), ("c2", "empty_body"), ("c3", "detached_heading"), ("c3", "cross_section_leakage")}
    source = spark.createDataFrame([("doc", f"b{k}") for k in range(1, 6)], "document_id string, block_id string")
    gone = spark.createDataFrame([("doc", "b4", "page_number")], "document_id string, block_id string, reason string")
    fates = validate.manifest(source, parts, gone)
    assert {r["block_id"]: r["fate"] for r in fates.collect()} == {"b1": "included", "b2": "included", "b3": "included", "b4": "excluded", "b5": "held"}
    report = validate.report(parts, issues, fates).first()
    assert (report["total_chunks"], report["flagged_chunks"], report["is_valid"], report["inclusion_rate"]) == (5, 3, False, 0.6)


def covered(spark, title, headings, texts):
    source = blocks(spark, [(f"b{k}", 1, 10 * k, 10 * k + 5, h, 1) for k, h in enumerate(headings)])
    titles = spark.createDataFrame([("doc", title)], "document_id string, title string")
    parts = chunks(spark, [("A", t, [], []) for t in texts])
    found = {(r["kind"], r["n"], r["status"]) for r in validate.coverage(source, titles, parts).collect()}
    return found, {(r["kind"], r["n"]) for r in validate.numbering_gaps(source, titles).collect()}


def test_coverage(spark):
    assert covered(spark, "Book", ["Chapter 1", "Chapter 2", "Chapter 3"], ["Chapter 1 x", "Chapter 3 y"])[0] == {("chapter", 1, "detected"), ("chapter", 2, "missing"), ("chapter", 3, "detected")}
    assert covered(spark, "Book", ["Introduction"], ["text"])[0] == set()
    assert {x for x in covered(spark, "Seven Step Plan", [], ["Step 1, step two, Step 3"])[0] if x[2] == "detected"} == {("step", k, "detected") for k in (1, 2, 3)}
    assert len(covered(spark, "Seven Step Plan", [], [""])[0]) == 7
    assert covered(spark, "Book", ["Part 1", "Part 3"], ["Part 1 Part 3"])[1] == {("part", 2)}
    assert covered(spark, "Book", ["Step Four"], ["see step 4"])[0] == {("step", 4, "detected")}


def test_naive_windows(spark):
    docs = spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, None), (4, " " * 50)], "doc_id long, text string")
    assert [r["doc_id"] for r in chunk.naive_chunks(docs).collect()] == [1, 1, 1]


def test_bm25_and_comparison(spark):
    parts = spark.createDataFrame([("a", "stone stone wheel"), ("b", "wheel water"), ("c", "bread")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "The stone wheel"), (2, "absent term")], "query_id int, query string")
    top = retrieval.top_chunks(retrieval.bm25(parts, asked)).collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in sorted(top, key=lambda r: r["rank"])] == [(1, "a", 1), (1, "b", 2)]
    results = spark.createDataFrame([("old", "q", 1, "Page 1 goals", "Page 1 goals", ""), ("new", "q", 1, "goals and plans", "Document: X\n\ngoals and plans", "X"), ("new", "q", 2, "Step 1 and Step 2", "Section: Y", "Y")], "system string, query string, rank int, source_text string, embedding_text string, section_path string")
    cases = spark.createDataFrame([("q", ["goals", "plans"])], "query string, expected array<string>")
    reports = {r["system"]: r for r in retrieval.evaluate(results, cases, ["Page 1"]).collect()}
    assert (reports["old"]["completeness"], reports["new"]["completeness"], reports["old"]["noise_freedom"], reports["new"]["section_purity"]) == (0.5, 1.0, 0.0, 0.5)
    change = {r["metric"]: r["change"] for r in retrieval.compare(retrieval.evaluate(results, cases, ["Page 1"]), "old", "new").collect()}
    assert change == {"completeness": "improved", "context_preservation": "improved", "noise_freedom": "improved", "section_purity": "regressed"}


@pytest.mark.parametrize("cells", [retrieval.MAX_CELLS, 0])
def test_best_chunks_of_distinct_queries(spark, monkeypatch, cells):
    """The same as of each query by itself, in a product or by joins, with ties and repeated words."""
    monkeypatch.setattr(retrieval, "MAX_CELLS", cells)
    words = "stone wheel water bread mill flour gate the".split()
    parts = spark.createDataFrame([(f"c{k:03d}", " ".join(words[(k * j + j) % 8] for j in range(1 + k % 7))) for k in range(300)] + [("empty", ""), ("none", None)], "chunk_id string, text string")
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["The stone", "the STONE", "wheel wheel water", "bread", "absent", "", "flour the gate absent", "the the the"])], "query_id int, query string")
    asks = retrieval.bags(asked)
    assert asks.select("bag").distinct().count() == 6 and asks.count() == 7
    best = retrieval.best_by_bag(parts.repartition(3), asks, Work(spark, "test")).join(asks, "bag")
    plain = retrieval.top_chunks(retrieval.bm25(parts, asked).withColumn("score", F.round("score", 6)))
    columns = ["query_id", "rank", "chunk_id", "score"]
    assert sorted(best.select(columns).collect()) == sorted(plain.select(columns).collect())


def test_cases_expect_what_tells_sections_apart(spark):
    filler = " common words shared everywhere" * 8
    rows = [("d", f"s{k}", f"T{k}", "section", {"top": k, "sub": -1}, f"{own}{filler}") for k, own in enumerate(["granite granite zebra alpha bravo carol", "delta delta", "", "Granite echos foxes golfs hotel india"])] + [("d", "short", "T", "section", {"top": 9, "sub": -1}, "granite"), ("e", "s0", "U", "section", {"top": 0, "sub": -1}, filler)]
    sections = spark.createDataFrame(rows, "document_id string, section_id string, section_title string, section_type string, section_order struct<top:int,sub:int>, text string")
    found = {(r["document_id"], r["target_section"]): r["expected"] for r in retrieval.cases_from_sections(sections).collect()}
    # of n = 4 sections; delta alone is one term; what all share counts where there is nothing else
    assert found == {("d", "T0"): ["granite", "alpha", "bravo", "carol"], ("d", "T2"): ["common", "everywhere", "shared", "words"], ("d", "T3"): ["echos", "foxes", "golfs", "hotel"], ("e", "U"): ["common", "everywhere", "shared", "words"]}


def test_heading_levels(spark):
    rows = spark.createDataFrame([("Step 3: Go", 12.0, False, 1), ("Key Takeaways", 12.0, False, 2), ("Tip 4", 12.0, False, 2), ("Large words", 15.0, False, 1), ("Bold words", 12.0, True, 2), ("Bold words.", 12.0, True, 0), ("a\nb\nc\nd\ne", 20.0, True, 0)], "t string, f double, b boolean, want int")
    assert all(got == want for got, want in rows.select(structure.classify_heading(F.col("t"), F.col("f"), F.lit(12.0), F.col("b")), "want").collect())


def test_garbled_lines(spark, tmp_path):
    """Every line has a row, with what a restatement in Python says."""
    import re
    import unicodedata

    from quernstone.plans.catalog import QUERIES

    lines = ["Die Mühle geht schön über dem Wasser.", "El molino de piedra más viejo del río.", "Ã©Ã¨Ã§Ã¢Ã®Ã´Ã»Ã«Ã¯Ã¼ vieux", "le blé\u200b est moulu", "plain line of ASCII words", "§§§§¤¤¤¤°°°°±±±± é", "a\x07b über alles", "日本語の文章はここにありますから記号が多い", "Ça [[^^ là"]

    def wanted(line):
        bare = line.strip()
        if len(bare) < 4:
            return None
        if re.search(structure.GLYPH_JUNK, bare):
            return "unmapped_glyph_sequence"
        controls = sum(unicodedata.category(c)[0] == "C" for c in bare)
        if controls:
            return f"contains_{controls}_control_chars"
        share = len(re.findall(structure.ODD_SYMBOL, bare, re.ASCII)) / len(bare)
        return "high_symbol_ratio" if len(bare) > 15 and share > 0.35 else None

    spark.createDataFrame([(k, t, "s") for k, t in enumerate(lines)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["garbled_lines"](spark, str(tmp_path)).where("slot = 1").collect()  # pages have heads and feet too
    assert len(rows) == len(lines)
    assert {str(r["document_id"]): r["reason"] for r in rows} == {str(k): wanted(t) for k, t in enumerate(lines)}
    assert sum(r["reason"] is not None for r in rows) >= 5


def test_removed_blocks_are_in_no_section(spark):
    rows = [(f"p{p}_{k}", p, y, text) for p in (1, 2) for k, (y, text) in enumerate([(20.0, "The Running Head"), (300.0, f"Body of page {p} with some words."), (770.0, f"Page {p}")])]
    made = spark.createDataFrame([("doc", i, p, (0.0, y, 600.0, y + 15), t, False, 0, 12.0, p * 10 + n) for n, (i, p, y, t) in enumerate(rows)], "document_id string, block_id string, page_num int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, is_heading boolean, heading_level int, font_size double, reading_order_idx int")
    cleaned = structure.clean_furniture(made)
    assert cleaned.where("removal_type is not null").count() == 4
    found = {r["text"] for r in structure.assign_sections(cleaned).collect()}
    assert found == {"Body of page 1 with some words.", "Body of page 2 with some words."}
