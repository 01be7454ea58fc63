"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language and bucket in Spark, pre-aggregated in each task,
over all labelled rows. The log-probability matrix has one row for each bucket and one
column for each language. Columns are broadcast at most LANGUAGES_AT_ONCE at a time, so
what is broadcast is bounded by the parameters. Scoring looks up the rows of a batch's
n-grams, all at once, and sums them for each document; with more languages, documents
pass by each block of columns in turn, and carry the best so far along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.work import Work, slices, unused

#: Buckets of n-grams as a power of two, longest n-gram, additive smoothing.
BITS, ORDER, SMOOTHING = 16, 3, 0.5
#: Languages in one broadcast matrix; others go into further ones.
LANGUAGES_AT_ONCE = 128
#: Characters that are scored at once.
SLICE = 1 << 19
UNKNOWN = "und"


def _fold_table() -> np.ndarray:
    """For each code point of the first plane: that of its lower-case letter, or 32."""
    out = np.full(1 << 16, 32, np.uint32)
    for code in range(1 << 16):
        low = chr(code).lower()
        if chr(code).isalpha():
            out[code] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else code
    return out


FOLD = _fold_table()


def folded(text: str) -> np.ndarray:
    """Code points of a text, letters in lower case, any run of others as one blank, with
    a blank at either end; empty if there is no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    plain = FOLD[np.minimum(codes, (1 << 16) - 1)]
    if len(codes) and int(codes.max()) >= 1 << 16:
        far = np.flatnonzero(codes >= 1 << 16)
        plain[far] = [ord(c.lower()[0]) if (c := chr(x)).isalpha() else 32 for x in codes[far].tolist()]
    letters = plain != 32
    if not letters.any():
        return plain[:0]
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    plain = plain[keep]
    blank = np.full(1, 32, np.uint32)
    return np.concatenate((blank, plain, blank[: int(plain[-1] != 32)]))


def buckets(codes: np.ndarray, order: int = ORDER, bits: int = BITS) -> list[np.ndarray]:
    """For n of 1 to order, the bucket of the n-gram that starts at each place."""
    out, mixed = [], np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        if len(codes) < n:
            break
        mixed = (mixed[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return out


def _slices(codes: np.ndarray, order: int):
    """Stretches of a long text that overlap so that each n-gram is in exactly one: the
    stretch and how many of its places count for n-grams of length n."""
    for at in range(0, len(codes), SLICE):
        yield codes[at : at + SLICE + order - 1], min(SLICE, len(codes) - at)


def _count(order: int, bits: int):
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for rows in slices(batch, 0):
                found: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    own = found.setdefault(lang, [])
                    docs[lang] = docs.get(lang, 0) + 1
                    for part, n in _slices(folded(text), order):
                        own += [x[:n] for x in buckets(part, order, bits)]
                for lang, parts in found.items():
                    own = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                    if parts:
                        own += np.bincount(np.concatenate(parts), minlength=1 << bits)
            if len(sums) > LANGUAGES_AT_ONCE:
                yield from _counted(sums, docs)
                sums, docs = {}, {}
        yield from _counted(sums, docs)

    return count


def _counted(sums: dict[str, np.ndarray], docs: dict[str, int]):
    """The counts of each language, and in bucket -1 its documents."""
    for lang, own in sums.items():
        used = np.flatnonzero(own)
        at, n = np.append(used, -1), np.append(own[used], docs[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])


@dataclass
class Model:
    """languages; log-probabilities by bucket and language; log-priors by language."""

    languages: list[str]
    matrix: np.ndarray
    priors: np.ndarray
    order: int = ORDER
    bits: int = BITS

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text with each language, and which texts have a letter."""
        codes = [folded(x or "") for x in texts]
        sums = np.zeros((len(texts), len(self.languages)))
        batch, size = [], 0
        for k in range(len(codes)):
            for part, n in _slices(codes[k], self.order):
                batch.append((k, part, n))
                size += n
                if size >= SLICE:
                    self._add(sums, batch)
                    batch, size = [], 0
        self._add(sums, batch)
        return sums + self.priors, np.array([len(x) > 0 for x in codes], bool)

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Most likely of these languages and its posterior probability for each text."""
        return Best.none(len(texts)).after(self, texts).decided()

    def _add(self, sums: np.ndarray, batch: list[tuple[int, np.ndarray, int]]) -> None:
        """Adds the log-probabilities of the stretches in batch to their rows of sums."""
        if not batch or not self.languages:
            return
        found = [buckets(part, self.order, self.bits) for _, part, _ in batch]
        flat = [x[:n] for (_, _, n), xs in zip(batch, found, strict=True) for x in xs]
        starts = np.cumsum([0, *map(len, flat)])
        rows = np.concatenate([[k] * len(xs) for (k, _, _), xs in zip(batch, found, strict=True)]).astype(int)
        where = np.concatenate(flat)
        full = np.flatnonzero(np.diff(starts) > 0)
        for column in range(len(self.languages)):
            parts = np.add.reduceat(self.matrix[:, column][where], starts[:-1][full], dtype=np.float64)
            np.add.at(sums[:, column], rows[full], parts)


@dataclass
class Best:
    """The best language of each text so far: its name (None: no letter, or no language),
    its log-probability, and that of all languages so far together."""

    names: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def none(cls, n: int) -> Best:
        return cls(np.full(n, None, object), np.full(n, -np.inf), np.full(n, -np.inf))

    def after(self, model: Model, texts: list[str | None]) -> Best:
        """The best, the languages of model included. Of equals the one before stays."""
        sums, known = model.sums(texts)
        if not model.languages:
            return self
        best = sums.argmax(axis=1)
        high = sums[np.arange(len(sums)), best]
        with np.errstate(under="ignore"):
            total = np.logaddexp(self.total, high + np.log(np.exp(sums - high[:, None]).sum(axis=1)))
        better = known & (high > self.high)
        names = np.where(better, np.array(model.languages, object)[best], self.names)
        return Best(names, np.where(known, np.maximum(high, self.high), -np.inf), np.where(known, total, -np.inf))

    def decided(self) -> tuple[list[str], list[float]]:
        """Language and posterior probability."""
        known = np.array([x is not None for x in self.names], bool)
        with np.errstate(invalid="ignore"):
            chance = np.where(known, np.exp(np.minimum(0.0, self.high - self.total)), 0.0)
        return [x if ok else UNKNOWN for x, ok in zip(self.names, known, strict=True)], chance.tolist()


@dataclass
class Counts:
    """Counts by language and bucket, as a table; the languages, in order."""

    table: DataFrame
    languages: list[str]
    n_docs: int
    order: int
    bits: int

    def models(self):
        """Models of so many languages at a time; one of none if there is none."""
        for at in range(0, max(1, len(self.languages)), LANGUAGES_AT_ONCE):
            names = self.languages[at : at + LANGUAGES_AT_ONCE]
            place = {x: k for k, x in enumerate(names)}
            found = self.table.where(F.col("lang").between(names[0], names[-1])).toArrow() if names else None
            table, docs = np.full((1 << self.bits, len(names)), SMOOTHING), np.ones(len(names))
            if found is not None:
                lang = np.array([place[x] for x in found.column("lang").to_pylist()], int)
                bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
                seen = bucket >= 0
                table[bucket[seen], lang[seen]] += n[seen]
                docs[lang[~seen]] += n[~seen]
            matrix = np.log(table) - np.log(table.sum(axis=0))
            yield Model(names, np.asfortranarray(matrix, dtype=np.float32), np.log(docs / (self.n_docs + len(self.languages))), self.order, self.bits)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, bits: int = BITS) -> Counts:
    """Counts of all rows of docs whose text and language are not null."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count(order, bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = Work(docs.sparkSession, "languages").table(counts, "counts")
    # by bytes of UTF-8, as Spark compares strings
    docs_of = {r["lang"]: r["n"] for r in counts.where("bucket = -1").collect()}
    return Counts(counts, sorted(docs_of, key=lambda x: x.encode()), sum(docs_of.values()), order, bits)


def scored(docs: DataFrame, counts: Counts, text_col: str, names: tuple[str, str]) -> DataFrame:
    """docs with two more columns, the most likely language and its posterior probability."""
    spark, at, n = docs.sparkSession, docs.columns.index(text_col), len(docs.columns)
    state = tuple(unused(docs, x) for x in ("_lang", "_high", "_total"))
    work, rows, ends = Work(spark, "scored"), docs, len(counts.languages)
    kept = ", ".join(f"{x} {kind}" for x, kind in zip(state, ("string", "double", "double"), strict=True))
    base = docs.schema
    for model in counts.models():
        first, last = rows is docs, not model.languages or model.languages[-1] == counts.languages[ends - 1]
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared, first=first, last=last):
            for batch in batches:
                for part in slices(batch, at):
                    best = Best.none(part.num_rows) if first else Best(*(part.column(n + k).to_numpy(zero_copy_only=False) for k in range(3)))
                    best = best.after(shared.value, part.column(at).to_pylist())
                    if last:
                        lang, chance = best.decided()
                        more, named = [pa.array(lang, pa.string()), pa.array(chance, pa.float64())], names
                    else:
                        more, named = [pa.array(best.names, pa.string()), pa.array(best.high), pa.array(best.total)], state
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], *more], names=[*base.names, *named])

        shape = docs.limit(0).selectExpr("*", *([f"'' as `{names[0]}`", f"0d as `{names[1]}`"] if last else [f"cast(null as {x.split()[-1]}) as `{x.split()[0]}`" for x in kept.split(", ")])).schema
        rows = rows.mapInArrow(run, shape)
        if not last:  # the next matrix comes to the workers when this one has gone
            rows = work.table(rows, "state")
            shared.destroy()
    return rows


def predict(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row.

    score is the posterior probability of lang_pred. A text that is null or has no
    letter, or any text under a model of no languages, is ``und`` with score 0. Equal
    probabilities go to the language first in the alphabet. Repeated rows give repeated
    rows; null ids stay null; other columns take no part; whole texts count, however
    long.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scored(rows, counts, "text", ("lang_pred", "score")).drop("text")


def is_held_out(doc_id: str) -> Column:
    """One row in five, by a checksum of its id: never used to learn."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: a model of the rows that aren't held out, and
    its prediction for all rows. Rows with a null id are not held out."""
    counts = train(docs.where(~is_held_out(id_col)), text_col, lang_col)
    found = predict(docs, counts, id_col, text_col)
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose language is recognised: not ``und``, and at
    least as likely as min_score.

    Null texts and texts without a letter go; rows that repeat, share an id or have none
    are judged by their texts; an empty table, or one without a labelled row, gives an
    empty one.
    """
    counts = train(docs.where(~is_held_out(id_col)), text_col, lang_col)
    lang, score = unused(docs, "_found"), unused(docs, "_score")
    found = scored(docs, counts, text_col, (lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
