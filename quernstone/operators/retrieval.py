"""BM25 retrieval and the comparison of two ways of chunking."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import safe
from quernstone.operators.batches import slices
from quernstone.operators.store import Work

#: Up to so many pairs of a distinct query and a term, all queries are scored at once.
MAX_CELLS = 1 << 20
#: Scores that differ by less may be in either order before they are rounded.
MARGIN = 2e-6
K1, B, MEAN_LENGTH = 1.2, 0.75, 150.0
TERM = r"\b[a-zA-Z0-9_-]{2,}\b"
# Words that say little.
STOPWORDS = tuple(
    "the and for that with this from have are was were will your you not but can all any "
    "their they them then than there these those which what when where how why into out "
    "about over more most some such also just only very been being has had its our".split()
)


def terms(text: Column) -> Column:
    """Words of two characters or more, lower case, in order."""
    return F.transform(F.regexp_extract_all(safe(text), F.lit(TERM), F.lit(0)), F.lower)


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """id, term, tf, length: one row for each term of each chunk. Terms are counted in the
    map tasks first, so a common term costs one row for each chunk and no more."""
    rows = chunks.select(id_col, terms(F.col(text_col)).alias("terms"))
    exploded = rows.select(id_col, F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return exploded.groupBy(id_col, "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """term, df: in how many chunks each term occurs."""
    distinct = chunks.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    return distinct.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, id, score for each chunk that shares a term with a query. Terms that a
    query repeats count each time. Lengths are measured against a fixed mean."""
    return _joined(chunks, _asked(queries, query_id, query_text), id_col, text_col, query_id)


def _asked(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """query_id, term, qtf."""
    return queries.select(query_id, F.explode(terms(F.col(query_text))).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qtf"))


def _joined(chunks: DataFrame, asked: DataFrame, id_col: str, text_col: str, query_id: str) -> DataFrame:
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    wanted = asked.select("term").distinct()
    posted = postings(chunks, id_col, text_col).join(wanted, "term", "left_semi")
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * (F.col("length") / MEAN_LENGTH)))
    scored = posted.join(df.crossJoin(F.broadcast(n)), "term").withColumn("part", idf * weight).join(asked, "term")
    return scored.groupBy(query_id, id_col).agg(F.sum(F.col("part") * F.col("qtf")).alias("score"))


def top_chunks(scores: DataFrame, k: int = 5, query_id: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """The k best chunks of each query with rank, ties in the order of ids. Spark limits
    each group before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def bags(queries: DataFrame, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id and bag, the terms of a query with their counts; queries with the same bag
    have the same scores."""
    both = F.sort_array(F.collect_list(F.struct("term", "qtf")))
    return _asked(queries, query_id, query_text).groupBy(query_id).agg(F.array_join(F.transform(both, lambda x: F.concat(x["term"], F.lit(":"), x["qtf"].cast("string"))), " ").alias("bag"))


def best_by_bag(chunks: DataFrame, asked: DataFrame, work: Work, k: int = 5, digits: int = 6, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """bag, id, score, rank: the k best chunks of each distinct bag in asked, by BM25 rounded
    to so many digits, as bm25 and top_chunks give for each query.

    A common word pairs nearly all queries with nearly all chunks. So chunks keep only their
    asked terms, and each task multiplies those of its chunks with all bags, of which it
    hands on what can be among the k best. Of more bags than fit (MAX_CELLS), pairs are
    joined.
    """
    distinct = asked.select("bag").distinct()
    parts = distinct.select("bag", F.explode(F.split("bag", " ")).alias("p")).select("bag", F.substring_index("p", ":", 1).alias("term"), F.substring_index("p", ":", -1).cast("long").alias("qtf"))
    wanted, n_bags = [r["term"] for r in parts.select("term").distinct().limit(MAX_CELLS + 1).collect()], distinct.count()
    rounded = F.round("score", digits)
    if len(wanted) * n_bags > MAX_CELLS:
        return top_chunks(_joined(chunks, parts, id_col, text_col, "bag").withColumn("score", rounded), k, "bag", id_col)
    all_terms = chunks.select(F.col(id_col).cast("string").alias("id"), terms(F.col(text_col)).alias("terms"))
    held = work.table(all_terms.select("id", F.size("terms").alias("length"), F.filter("terms", lambda t: t.isin(*wanted)).alias("terms")), "asked_terms", tidy=True)
    n = held.count()
    dfs = {r["term"]: r["df"] for r in held.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    places, names = {t: i for i, t in enumerate(dfs)}, sorted(r["bag"] for r in distinct.collect())
    idf = [math.log((n - df + 0.5) / (df + 0.5) + 1.0) for df in dfs.values()]
    at = {bag: j for j, bag in enumerate(names)}
    cells = [(places[r["term"]], at[r["bag"]], r["qtf"]) for r in parts.collect() if r["term"] in places]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks = np.zeros((len(places), len(names)))
        for i, j, qtf in cells:
            asks[i, j] = qtf * idf[i]
        least = np.zeros(len(names))  # what a bag's chunk must reach
        best: list[list[tuple[float, str]]] = [[] for _ in names]
        for batch in batches:
            for rows in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                ids, lengths, found = (rows.column(c).to_pylist() for c in range(3))
                tf = np.zeros((len(ids), len(places)))
                for i, own in enumerate(found):
                    for term in own:
                        tf[i, places[term]] += 1
                weight = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * (np.array(lengths)[:, None] / MEAN_LENGTH)))
                scores = weight @ asks
                for j in np.flatnonzero(((scores > 0) & (scores >= least - MARGIN)).any(axis=0)):
                    column = scores[:, j]
                    rest = best[j] + [(float(column[i]), ids[i]) for i in np.flatnonzero((column > 0) & (column >= least[j] - MARGIN))]
                    if len(rest) > k:
                        least[j] = heapq.nlargest(k, (x for x, _ in rest))[-1]
                    # of equal scores the k least ids; of others, all that rounding might bring to the front
                    kept, seen = [], Counter()
                    for x, chunk in sorted(rest, key=lambda r: (-round(r[0], 9), r[1])):
                        seen[round(x, 9)] += 1
                        if x >= least[j] - MARGIN and seen[round(x, 9)] <= k:
                            kept.append((x, chunk))
                    best[j] = kept
        out = [(names[j], chunk, x) for j, rows in enumerate(best) for x, chunk in rows]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.float64()), strict=True)], names=["bag", "id", "score"])

    scored = held.where(F.size("terms") > 0).mapInArrow(score, "bag string, id string, score double")
    kind = chunks.schema[id_col].dataType
    return top_chunks(scored.select("bag", F.col("id").cast(kind).alias(id_col), rounded.alias("score")), k, "bag", id_col)


def search(chunks: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """query_id, id, score, rank: the k best chunks of each query that has a term. Chunks
    without a word in common score zero and come last, in the order of ids; as k others
    at most stand before them, the 2k least ids are all that can be needed."""
    best = top_chunks(bm25(chunks, queries, id_col, text_col, query_id, query_text), k, query_id, id_col).drop("rank")
    some = chunks.where(F.size(terms(F.col(text_col))) > 0).select(id_col).orderBy(id_col).limit(2 * k)
    asked = queries.where(F.size(terms(F.col(query_text))) > 0).select(query_id).distinct()
    rest = asked.crossJoin(F.broadcast(some.agg(F.collect_set(id_col).alias("_ids")))).select(query_id, F.explode("_ids").alias(id_col))
    zero = rest.join(best.select(query_id, id_col), [query_id, id_col], "left_anti").withColumn("score", F.lit(0.0))
    return top_chunks(best.unionByName(zero), k, query_id, id_col)


_WORD, _STOP = re.compile("[A-Za-z][A-Za-z-]{4,}"), frozenset(STOPWORDS)


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each section, the terms that can be among its four with the largest weights, with
    their counts; a document's sections come one after another. Terms that all sections
    share are given where a section has no others."""
    rows = (r for batch in batches for part in slices(batch, 0) for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
    names = ["document_id", "section_id", "target_section", "at", "term", "tf", "df", "n"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for document_id, sections in groupby(rows, key=lambda r: r[1]):
        found = [(r[2:], Counter(w for w in _WORD.findall(r[0]) if w not in _STOP)) for r in sections]
        n, df = len(found), Counter(w for _, tf in found for w in tf)
        out = []
        for (section_id, title, at), tf in found:
            own = [w for w in tf if df[w] != n] or list(tf)
            alike: dict[tuple[int, int], list[str]] = {}
            for w in own:
                alike.setdefault((tf[w], df[w]), []).append(w)
            # words with the same counts weigh the same: four of each will do
            heavy = sorted(((t * math.log((n + 1) / d), t, d, heapq.nsmallest(4, ws)) for (t, d), ws in alike.items()), reverse=True)
            more, least = 4, 0.0
            for weight, t, d, ws in heavy:
                if more <= 0 and weight < least * (1 - 1e-9):
                    break
                least = weight if more > 0 else least  # that of the fourth, at last
                out += [(document_id, section_id, title, at, w, t, d, n) for w in ws]
                more -= len(ws)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def cases_from_sections(sections: DataFrame, max_cases: int = 6) -> DataFrame:
    """Benchmark cases (query, expected, target_section) from a document's own sections.

    sections has document_id, section_id, section_title, section_type and text. Of those
    of 200 characters or more, the four terms with the largest tf * ln((n + 1) / df) are
    expected; terms that all sections share are left out where others exist; fewer than
    two give no case. Cases are then spread over the document.
    """
    usable = sections.where(F.col("section_type").isin("section", "subsection") & (F.length("text") >= 200))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("section_order"))
    counted = usable.select(F.lower("text").alias("text"), "document_id", "section_id", "section_title", place.alias("at")).mapInArrow(_telling, "document_id string, section_id string, target_section string, at int, term string, tf long, df long, n long")
    scored = counted.withColumn("weight", F.col("tf") * F.ln((F.col("n") + 1) / F.col("df"))).withColumn("shared", F.col("df") == F.col("n"))
    section = Window.partitionBy("document_id", "section_id")
    rank = F.row_number().over(section.orderBy("shared", F.desc("weight"), "term"))
    best = scored.withColumn("rank", rank).withColumn("distinctive", F.count_if(~F.col("shared")).over(section)).where((F.col("rank") <= 4) & (~F.col("shared") | (F.col("distinctive") == 0)))
    named = best.groupBy("document_id", "section_id", "target_section", "at").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("expected")).where(F.size("expected") >= 2)
    order = Window.partitionBy("document_id").orderBy("at")
    numbered = named.withColumn("i", F.row_number().over(order) - 1).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    stride = F.greatest(F.lit(1.0), F.col("all") / max_cases)
    chosen = F.transform(F.sequence(F.lit(0), F.lit(max_cases - 1)), lambda j: F.floor(j * stride).cast("int"))
    kept = numbered.where(F.array_contains(chosen, F.col("i")))
    return kept.select("document_id", F.concat(F.lit("What does the section '"), "target_section", F.lit("' cover?")).alias("query"), "expected", "target_section")


def evaluate(results: DataFrame, cases: DataFrame, furniture: list[str]) -> DataFrame:
    """Scores of each query from its top chunks.

    results: system, query, rank, source_text, embedding_text, section_path; cases: query,
    expected. Gives completeness (expected terms found in any), context_preservation (with
    headings), noise_freedom (without furniture), section_purity (one numbered unit at
    most) and top_1_hit.
    """
    return evaluate_rows(results.join(cases.select("query", "expected"), "query"), furniture)


def evaluate_rows(joined: DataFrame, furniture: list[str]) -> DataFrame:
    """evaluate, of results that have their query's expected terms."""
    low = F.lower(safe(F.col("source_text")))
    noisy = F.lit(False)
    for line in furniture:
        noisy = noisy | F.contains(low, F.lit(line.lower()))
    mentioned = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"\b(?:step|chapter|part|module)\s+[0-9a-z]+"), F.lit(0)), F.lower))
    context = F.contains("embedding_text", F.lit("Document:")) | F.contains("embedding_text", F.lit("Section:")) | (F.coalesce("section_path", F.lit("")) != "")
    rows = joined.select("system", "query", "rank", "expected", F.filter("expected", lambda e: F.contains(low, F.lower(e))).alias("found"), (~noisy).cast("int").alias("quiet"), (F.size(mentioned) <= 1).cast("int").alias("pure"), context.cast("int").alias("context"))
    found = F.size(F.array_distinct(F.flatten(F.collect_list("found"))))
    return rows.groupBy("system", "query").agg(
        (found / F.size(F.first("expected"))).alias("completeness"),
        F.avg("context").alias("context_preservation"),
        F.avg("quiet").alias("noise_freedom"),
        F.avg("pure").alias("section_purity"),
        F.max((F.col("rank") == 1) & (F.size("found") > 0)).alias("top_1_hit"),
    )


METRICS = ("completeness", "context_preservation", "noise_freedom", "section_purity")


def compare(reports: DataFrame, before: str, after: str) -> DataFrame:
    """metric, before, after and change (improved, regressed, unchanged): means over queries."""
    means = reports.groupBy("system").agg(*(F.avg(m).alias(m) for m in METRICS))
    long = means.unpivot("system", list(METRICS), "metric", "value")
    wide = long.groupBy("metric").pivot("system", [before, after]).agg(F.first("value"))
    b, a = F.col(f"`{before}`"), F.col(f"`{after}`")
    return wide.select("metric", b.alias("before"), a.alias("after"), F.when(a > b, "improved").when(a < b, "regressed").otherwise("unchanged").alias("change"))
