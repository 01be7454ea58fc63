"""Substring deduplication: repeated runs of sentences, and repeated windows of words.

From each sentence on, the shortest run of at least ``MIN_SENTENCES`` sentences and
``MIN_WORDS`` words is hashed, and so is the shortest such run up to each sentence; so
whatever two texts share, the same runs lie within it. A task keeps only the first of
equal runs that it meets, by (doc_id, position), and marks the others at once; hence a
run has no more rows in the global step than there are tasks, however common it is.
There, all but the first of a run's rows are marked. Sentences covered by any marked run
are removed.

Passages that sentences don't show, as one long sentence or parts of some, are found by
words. Every window of ``WINDOW`` words that occurs earlier goes, wherever it starts. Two
equal windows hold the same seed, the rightmost least hash of their spans of ``SEED``
words; so only windows around seeds that occur twice are hashed, and none is missed.

Runs and windows count as equal if 88 bits of two independent hashes are; among 10**12 of
them, one chance in some hundred is left that any two differ. A passage without full
stops and of fewer words than a window is in no run, and stays.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quernstone.llm.work import slices

#: What a run has at least.
MIN_SENTENCES, MIN_WORDS = 2, 20
#: Words of a window, of which all repeats go, and of a seed.
WINDOW, SEED = 51, 12
#: Runs that a task holds before it passes on what it has.
RUNS_HELD = 1 << 20

_END = re.compile(r"[.!?]+(?=\s)|\n")
_WORD = re.compile(r"\S+")
#: Bases of the two hashes, and their inverses.
_ODD, _OTHER = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = {x: pow(x, -1, 1 << 64) for x in (_ODD, _OTHER)}
#: Bits of the second hash; lengths from this one on take their place.
CHECK_BITS, LONG = 24, 127


def sentence_ends(text: str) -> list[int]:
    """Where each sentence ends: after full stops before white space, after line ends,
    and at the text's end. White space after a stop belongs to the next sentence."""
    ends = [m.end() for m in _END.finditer(text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)] if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _spans(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the spans [first, end) of a sequence, from those of its members: equal
    sequences have equal ones, wherever they stand."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        if base == _OTHER:  # other values for the members, too
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((hashes | np.uint64(1)) * _powers(base, n))))
        found = (sums[end] - sums[first]) * _powers(_INVERSE[base], n + 1)[first]
        return (found ^ (found >> np.uint64(32))) * np.uint64(base)


def _check(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - CHECK_BITS)).astype(np.int64)


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence of each run, and its hashes; each run once. Runs are equal if
    their words are, whatever their case and the white space between them."""
    ends = sentence_ends(text)
    n = len(ends)
    none = np.zeros(0, np.int64)
    if n < MIN_SENTENCES:
        return none, none, none.astype(np.uint64), none
    sizes, hashes, at = [], [], 0
    for end in ends:
        words = text[at:end].lower().split()
        sizes.append(len(words))
        hashes.append(xxh64_intdigest(" ".join(words)))
        at = end
    words = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.arange(n)
    last = np.maximum(np.searchsorted(words, words[:-1] + MIN_WORDS) - 1, starts + MIN_SENTENCES - 1)
    forward = np.stack((starts, last))[:, last < n]
    first = np.minimum(np.searchsorted(words, words[1:] - MIN_WORDS, side="right") - 1, starts - MIN_SENTENCES + 1)
    backward = np.stack((first, starts))[:, first >= 0]
    pairs = np.unique(np.concatenate((forward, backward), axis=1), axis=1)
    a, b = pairs
    members = np.array(hashes, np.uint64)
    with np.errstate(over="ignore"):
        found = _spans(members, a, b + 1, _ODD) + (words[b + 1] - words[a]).astype(np.uint64)
    return a, b, found, _check(_spans(members, a, b + 1, _OTHER))


def word_spans(text: str, size: int, base: int = _ODD) -> np.ndarray:
    """Hashes of all spans of so many words, by their first word."""
    words = text.lower().split()
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    starts = np.arange(n - size + 1)
    return _spans(hashes, starts, starts + size, base)


def seeds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each seed, its hash and no second one: of the spans in each window of words
    the least, of equal ones the last."""
    found, width = word_spans(text, SEED), WINDOW - SEED + 1
    if len(found) < width:
        none = np.zeros(0, np.int64)
        return none, none, found[:0], none
    back = np.lib.stride_tricks.sliding_window_view(found[::-1], width)
    places = np.unique(len(found) - 1 - (np.arange(len(back)) + back.argmin(axis=1)))
    return places, places + SEED - 1, found[places], np.zeros(len(places), np.int64)


def windows(text: str, around: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each window that holds one of the seeds, and its hashes."""
    words = text.lower().split()
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    starts = np.arange(max(0, len(words) - WINDOW + 1))
    found = _spans(hashes, starts, starts + WINDOW, _ODD)
    near = np.zeros(len(found) + WINDOW, np.int64)
    at = np.array(around, np.int64)
    at = at[at < len(near) - 1]
    np.add.at(near, np.maximum(at - (WINDOW - SEED), 0), 1)
    np.add.at(near, at + 1, -1)
    places = np.flatnonzero(np.cumsum(near)[: len(found)] > 0)
    return places, places + WINDOW - 1, found[places], _check(_spans(hashes, places, places + WINDOW, _OTHER))


# A row's place is first << 32 and, if it is a known repeat, (last - first) << 1 | 1; else
# check << 8 | (last - first) << 1, or for long ones (last - first) << 8 | LONG << 1.


def _place(first: np.ndarray, last: np.ndarray, known: np.ndarray, check: np.ndarray) -> np.ndarray:
    size = last - first
    short = np.where(size < LONG, check << 8 | size << 1, np.minimum(size, (1 << CHECK_BITS) - 1) << 8 | LONG << 1)
    return first << 32 | np.where(known > 0, size << 1 | 1, short)


def span_of(place: int) -> tuple[int, int]:
    """First and last of a place."""
    first, rest = place >> 32, place & 0xFFFFFFFF
    if rest & 1:
        return first, first + (rest >> 1)
    size = rest >> 1 & 127
    return first, first + (size if size < LONG else rest >> 8)


def _first_of_task(held: tuple[list, list, list, list, list], apart: int) -> pa.RecordBatch:
    """Rows of runs. Of equal runs only the first, and what lies less than apart from it,
    keep their hash; others are known repeats, and overlapping ones become one row. Seeds
    (apart 0) stay as they are, and a first that has others is known too.

    Rows are in order of documents and places, which lets them compress to half.
    """
    doc, first, last, run, check = (np.concatenate(x) for x in held)
    order = np.lexsort((first, doc, check, run))
    doc, first, last, run, check = doc[order], first[order], last[order], run[order], check[order]
    new_run = np.append(True, (run[1:] != run[:-1]) | (check[1:] != check[:-1]))
    leader = np.maximum.accumulate(np.where(new_run, np.arange(len(run)), 0))
    known = (doc != doc[leader]) | (first - first[leader] >= max(apart, 1))
    open_rows = np.flatnonzero(~known)
    away = np.flatnonzero(known)
    away = away[np.lexsort((first[away], doc[away]))]
    flags = np.zeros(len(run), np.int64)
    flags[away] = 1
    if apart:
        ends = last[away]
        if len(away):
            # ends of all rows before, by document
            new_doc = np.append(True, doc[away][1:] != doc[away][:-1])
            lift = np.cumsum(new_doc) * (1 << 32)
            reach = np.maximum.accumulate(ends + lift)
            begins = new_doc | np.append(True, first[away][1:] + lift[1:] > reach[:-1] + 1)
            at = np.flatnonzero(begins)
            last[away[at]] = (reach - lift)[np.append(at[1:], len(away)) - 1]
            away = away[at]
    else:
        flags[leader[away]] = 1
    # known rows only pass through, so any hash does that spreads them
    with np.errstate(over="ignore"):
        run[away] = (doc[away].astype(np.uint64) * np.uint64(_ODD)) ^ ((first[away].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    kept = np.concatenate((open_rows, away))
    kept = kept[np.lexsort((first[kept], doc[kept]))]
    place = _place(first[kept], last[kept], flags[kept], check[kept])
    return pa.RecordBatch.from_arrays([pa.array(run[kept].view(np.int64)), pa.array(doc[kept]), pa.array(place)], names=["run", "doc_id", "place"])


def _task_runs(find, apart: int):
    """What each task passes on of the runs that find gives of a row's columns but the id;
    rows without a text have none."""

    def run(batches):
        held: tuple[list, list, list, list, list] = ([], [], [], [], [])
        size = 0
        for batch in batches:
            for rows in slices(batch, 1):
                for doc_id, text, *others in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if text is None:
                        continue
                    found = find(text, *others)
                    for own, new in zip(held, (np.full(len(found[0]), doc_id, np.int64), *found), strict=True):
                        own.append(new)
                    size += len(found[0])
                    if size >= RUNS_HELD:
                        yield _first_of_task(held, apart)
                        held, size = ([], [], [], [], []), 0
        if size:
            yield _first_of_task(held, apart)

    return run


_RUN = "run long, doc_id long, place long"
_KNOWN, _FIRST = "place & 1 = 1", "shiftright(place, 32)"
#: What rows of one run share besides the hash: the low part of an open row's place.
_SAME = "if(place & 1 = 1, 0, place & 4294967295)"


def _by_run(found: DataFrame, same: str = _SAME, **columns) -> DataFrame:
    found = found.repartition("run")  # else what the window needs travels, too
    own = Window.partitionBy("run", F.expr(same))
    return found.withColumns({name: of(F.struct("doc_id", F.expr(_FIRST).alias("first"))).over(own) for name, of in columns.items()})


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and place (of sentences from 0) of each run that occurs earlier, by (doc_id,
    position). Null ids and null texts have none."""
    rows = _rows(docs, id_col, text_col).where("doc_id is not null and text is not null")
    found = _by_run(rows.mapInArrow(_task_runs(runs, 1), _RUN), earliest=F.min)
    return found.where(f"{_KNOWN} or doc_id != earliest.doc_id or {_FIRST} != earliest.first").select("doc_id", "place")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and place (of words from 0) of each window of words that occurs earlier, by
    (doc_id, position), without overlapping that first one."""
    rows = _rows(docs, id_col, text_col)
    known = rows.where("doc_id is not null and text is not null")
    twice = _by_run(known.mapInArrow(_task_runs(seeds, 0), _RUN), "0", earliest=F.min, latest=F.max).where(f"{_KNOWN} or earliest != latest")
    twice = twice.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.expr(f"cast({_FIRST} as int)")).alias("seeds"))
    # a left join without a filter, so that the final one can use the same exchange of texts
    near = rows.join(twice, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.when(F.col("seeds").isNotNull(), F.col("text")).alias("text"), "seeds")
    found = _by_run(near.mapInArrow(_task_runs(windows, WINDOW), _RUN), earliest=F.min)
    return found.where(f"{_KNOWN} or doc_id != earliest.doc_id or {_FIRST} - earliest.first >= {WINDOW}").select("doc_id", "place")


def _covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n things the spans (first, last) cover."""
    gone = np.zeros(n + 1, np.int64)
    for a, b in spans:
        gone[min(a, n)] += 1
        gone[min(b + 1, n)] -= 1
    return np.cumsum(gone)[:-1] > 0


def without_spans(text: str, spans: list[tuple[int, int]], word_spans: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without sentences in spans (first, last) and words in word_spans, its
    sentences before, how many of them went whole, and how many words went."""
    ends = sentence_ends(text)
    covered = _covered(len(ends), spans)
    if not covered.any() and not word_spans:
        return text, len(ends), 0, 0
    bounds = np.array([0, *ends])
    places = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    own = np.minimum(np.searchsorted(bounds, places[:, 0], side="right") - 1, len(ends) - 1)
    words = _covered(len(places), word_spans) | covered[own]
    left = np.bincount(own[~words], minlength=len(ends))
    covered |= (left == 0) & (np.bincount(own, minlength=len(ends)) > 0)
    # sentences that go whole take their white space along, other words that after them
    kept, at = [], 0
    away = [(int(bounds[k]), int(bounds[k + 1])) for k in np.flatnonzero(covered)]
    nexts = np.append(places[1:, 0], len(text))
    away += [(int(places[k, 0]), int(nexts[k])) for k in np.flatnonzero(words & ~covered[own])]
    for a, b in sorted(away):
        kept.append(text[at:a])
        at = max(at, b)
    kept.append(text[at:])
    return "".join(kept).strip(), len(ends), int(covered.sum()), int(words.sum())


def _cut(batches):
    for batch in batches:
        for rows in slices(batch, 1):
            out = []
            for text, spans in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                # places of words are held as their complement, below 0
                sentences = [span_of(x) for x in spans or [] if x >= 0]
                words = [span_of(~x) for x in spans or [] if x < 0]
                out.append(without_spans(text or "", sentences, words))
            columns = [rows.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int64()), (0, pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_sentences", "n_removed", "n_words_removed", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_sentences, n_removed (sentences gone whole),
    n_words_removed, and text without the sentences that a repeated run covers and the
    words that a repeated window covers.

    The first run or window by (doc_id, position) stays, also of those within one
    document. A text of which all goes becomes empty; one that loses nothing stays as it
    is. Null texts come out empty, rows with a null id unchanged. Rows that repeat an id
    are one document to the search: none counts as a repeat of the other. Other columns
    take no part; an empty table gives an empty result.
    """
    found = repeated_spans(docs, id_col, text_col).unionByName(repeated_windows(docs, id_col, text_col).withColumn("place", F.bitwise_not("place")))
    spans = found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("place").alias("spans"))
    joined = _rows(docs, id_col, text_col).join(spans, F.col("doc_id") == F.col("_id"), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, n_words_removed long, text string")
