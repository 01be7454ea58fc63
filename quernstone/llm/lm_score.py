"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, of target documents and of the whole corpus, share one
vocabulary (every word, and the end of a text), their smoothing, and are matched in size:
the corpus's counts are scaled to the target's number of words. Words and pairs of words
are counted exactly, by 64-bit hashes, over all documents, so what is gathered grows with
the corpus. The start of a text is a context of its own, and a document is scored by the
counts of all others: its own are taken off, else what is long or rare would look cheap
to the model that holds it.

Documents are dealt by hash into blocks of about BLOCK_BYTES. Each block counts its words
and pairs and sends the sorted keys on in parts of the key space, packed into as many
bytes as the gaps between them need. A part is summed over all blocks, and each block
gets the sums back, in the order of its own keys, so keys needn't travel again. With
them, a block scores its documents. A document's score is the mean over its words of the
loss under the target model less that under the corpus model; low scores are like the
target.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.words import word_hashes
from quernstone.llm.work import Work, slices

#: Bytes of text in a block of documents, on average; what a task holds follows from them.
BLOCK_BYTES = 4 << 20
#: Bytes of text for each part of the key space.
PART_BYTES = 16 << 20
#: Words whose losses are in memory at once (a document's at least).
WORDS_AT_ONCE = 1 << 18
#: Share of the pair model, and pseudo-counts of each word.
PAIR_SHARE, SMOOTHING = 0.6, 0.5
#: Labels are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000

#: What is counted: words, pairs, and starts of texts, which have the one key 0.
WORD, PAIR, START = range(3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def keys(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its 64-bit hash, and that of the word before (at first, of the start)
    and it as a pair."""
    own = word_hashes(text)
    before = np.concatenate((np.zeros(1, np.uint64), own))[: len(own)]
    pair = (own * _MIX) ^ ((before + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    pair ^= pair >> np.uint64(32)
    return own, pair * _MIX


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, in as few bytes each as the largest needs, by planes of bytes."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


class Block:
    """The words and pairs of a block of documents.

    found and at: by kind, distinct keys, sorted, and the place of each occurrence's key in
    them; sizes: words of each document.
    """

    def __init__(self, table: pa.Table):
        words, pairs, sizes = [], [], []
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for rows in slices(batch, 0):
                for text in rows.column(0).to_pylist():
                    own, pair = keys(text)
                    words.append(own)
                    pairs.append(pair)
                    sizes.append(len(own))
        self.sizes = np.array(sizes, np.int64)
        self.target = table.column("is_target").to_numpy().astype(np.int64)
        self.found, self.at = [], []
        for values in (words, pairs):
            found, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *values]), return_inverse=True)
            values.clear()
            self.found.append(found)
            self.at.append(at)
        self.found.append(np.zeros(int(bool(sizes) and max(sizes) > 0), np.uint64))

    def counts(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs: in all, and in target documents."""
        if kind == START:
            some = self.sizes > 0
            return tuple(np.array([x], np.int64)[: len(self.found[START])] for x in (some.sum(), self.target[some].sum()))
        of_target, n = np.repeat(self.target, self.sizes) > 0, len(self.found[kind])
        return np.bincount(self.at[kind], minlength=n), np.bincount(self.at[kind][of_target], minlength=n)


def _parts(keys: np.ndarray, n_parts: int):
    """Stretches of sorted keys by equal parts of the key space: part, first, last."""
    width = (1 << 64) // n_parts + 1
    bounds = np.searchsorted(keys, np.array([k * width for k in range(1, n_parts)], np.uint64))
    edges = [0, *bounds.tolist(), len(keys)]
    return ((k, a, b, k * width) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a)


_COUNTED = "part int, kind int, block int, keys binary, corpus binary, target binary"
_SUMMED = "part int, kind int, block int, corpus binary, target binary, n_keys long, n_corpus long, n_target long"


def _count(n_parts: int):
    def count(table: pa.Table) -> pa.Table:
        block, rows = Block(table), []
        number = table.column("block")[0].as_py()
        for kind in (WORD, PAIR, START):
            corpus, target = block.counts(kind)
            for part, a, b, low in _parts(block.found[kind], n_parts):
                own = block.found[kind][a:b]
                gaps = np.diff(own, prepend=np.uint64(low))
                rows.append((part, kind, number, packed(gaps), packed(corpus[a:b]), packed(target[a:b])))
        names = [x.split()[0] for x in _COUNTED.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 3
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return count


def _sum(table: pa.Table) -> pa.Table:
    """The sums of one part and kind, for each block in the order of its keys, and in block
    -1 how many keys there are and their sums."""
    part, kind = table.column("part")[0].as_py(), table.column("kind")[0].as_py()
    blocks = table.column("block").to_pylist()
    columns = [[unpacked(x.as_py()) for x in table.column(name)] for name in ("keys", "corpus", "target")]
    sizes = np.cumsum([len(x) for x in columns[0]])[:-1]
    # gaps add up to keys less the low end of the part, which is the same in all blocks
    values, at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in columns[0]]), return_inverse=True)
    sums = []
    for column in columns[1:]:
        total = np.zeros(len(values), np.int64)
        np.add.at(total, at, np.concatenate(column).astype(np.int64))
        sums.append(total)
    rows = [(part, kind, block, packed(sums[0][own]), packed(sums[1][own]), None, None, None) for block, own in zip(blocks, np.split(at, sizes), strict=True)]
    rows.append((part, kind, -1, None, None, len(values), int(sums[0].sum()), int(sums[1].sum())))
    names = [x.split()[0] for x in _SUMMED.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 3
    return pa.table([pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds)], names=names)


@dataclass
class Totals:
    """Of words and of texts that have any, corpus and target; distinct words."""

    words: tuple[float, float]
    texts: tuple[float, float]
    n_words: int


def losses(word, before, pair, words, texts, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each word under the target and the corpus model, in nats.

    word, before and pair hold the counts, (corpus, target), of each word, of its context,
    and of both in a row; words and texts are the sizes of the two corpora. A context's
    count is that of all that follows it, the end of the text included, so with the end
    as one more word of the vocabulary probabilities sum to one.
    """
    scale = np.maximum(words[1], 1) / np.maximum(words[0], 1)
    out = []
    for k, factor in ((1, 1.0), (0, scale)):
        alone = (word[k] * factor + SMOOTHING) / ((words[k] + texts[k]) * factor + SMOOTHING * (totals.n_words + 1))
        after = np.where(before[k] > 0, pair[k] / np.maximum(before[k], 1), alone)
        out.append(-np.log(PAIR_SHARE * after + (1 - PAIR_SHARE) * alone))
    return out[0], out[1]


def _own(owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each occurrence, how often its document has its key."""
    _, back, counts = np.unique(owner * n + at, return_inverse=True, return_counts=True)
    return counts[back]


def _score(totals: Totals):
    def run(docs: pa.Table, summed: pa.Table) -> pa.Table:
        block = Block(docs)
        place = np.lexsort((summed.column("part").to_numpy(), summed.column("kind").to_numpy()))
        kinds = summed.column("kind").to_numpy()[place]
        sums = []
        for kind in (WORD, PAIR, START):
            own = [summed.column(name).take(pa.array(place[kinds == kind])) for name in ("corpus", "target")]
            sums.append([np.concatenate([np.zeros(0, np.int64), *(unpacked(x.as_py()).astype(np.int64) for x in column)]) for column in own])
            if len(sums[kind][0]) != len(block.found[kind]):
                raise RuntimeError("the documents changed while they were read")
        n, sizes = len(docs), block.sizes
        ends = np.cumsum(sizes)
        means = np.zeros((2, n))
        first = 0
        while first < n:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, side="right")))
            a, b = before, int(ends[last - 1])
            if b > a:
                own_sizes = sizes[first:last]
                owner = np.repeat(np.arange(last - first), own_sizes)
                of_target = np.repeat(block.target[first:last], own_sizes)
                starts = (np.cumsum(own_sizes) - own_sizes)[own_sizes > 0]
                word_at, pair_at = block.at[WORD][a:b], block.at[PAIR][a:b]
                own = _own(owner, word_at, len(block.found[WORD])), _own(owner, pair_at, len(block.found[PAIR]))
                others = (np.ones(b - a, np.int64), of_target)  # what a document has of its own
                word = [sums[WORD][k][word_at] - own[0] * others[k] for k in (0, 1)]
                pair = [sums[PAIR][k][pair_at] - own[1] * others[k] for k in (0, 1)]
                context = []
                for k in (0, 1):
                    x = np.concatenate((np.zeros(1, np.int64), word[k][:-1]))
                    x[starts] = sums[START][k][0] - others[k][starts]
                    context.append(x)
                words = [totals.words[k] - np.repeat(own_sizes, own_sizes) * others[k] for k in (0, 1)]
                texts = [totals.texts[k] - others[k] for k in (0, 1)]
                for k, x in enumerate(losses(word, context, pair, words, texts, totals)):
                    means[k, first:last] = np.bincount(owner, weights=x, minlength=last - first) / np.maximum(own_sizes, 1)
            first = last
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": sizes, "loss_target": means[0], "loss_corpus": means[1], "score": means[0] - means[1]})

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, loss_target, loss_corpus (means) and score, their difference, of
    each row of docs (doc_id, text, is_target), by models of all others. A text with no
    words, or null, has losses and score 0."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_parts = int(size // BLOCK_BYTES) + 1, int(size // PART_BYTES) + 1
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    counts = blocks.groupBy("block").applyInArrow(_count(n_parts), _COUNTED)
    summed = Work(docs.sparkSession, "models").table(counts.groupBy("part", "kind").applyInArrow(_sum, _SUMMED), "sums")
    found = {r["kind"]: r for r in summed.where("block = -1").groupBy("kind").agg(*(F.sum(x).alias(x) for x in ("n_keys", "n_corpus", "n_target"))).collect()}
    pair = lambda kind: (float(found[kind]["n_corpus"]), float(found[kind]["n_target"])) if kind in found else (0.0, 0.0)
    totals = Totals(pair(WORD), pair(START), found[WORD]["n_keys"] if WORD in found else 0)
    schema = "doc_id long, n_words long, loss_target double, loss_corpus double, score double"
    back = summed.where("block >= 0").select("part", "kind", "block", "corpus", "target")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_score(totals), schema)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all of docs with the target that labels name: rows of quality 1 that aren't
    toxic.

    Null texts count for nothing and score 0, null ids are never of the target, and a
    document labelled twice is of the target if one label says so. Repeated rows count
    and come out each; other columns, whatever their names, take no part. Without any
    target, both models are as smooth as can be and scores depend on the corpus alone;
    an empty table gives an empty result.
    """
    target = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_target")).distinct()
    if target.count() <= BROADCAST_ROWS:
        target = F.broadcast(target)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.join(target, F.col("doc_id") == F.col("_target"), "left").withColumn("is_target", F.col("_target").isNotNull())
    return score(marked.select("doc_id", "text", "is_target"))
