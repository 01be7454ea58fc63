"""Mixing sources to target weights with soft membership.

A multinomial naive Bayes over hashed words, fitted on a bounded sample of the labelled
table, gives each document a posterior over domains. Rates r >= 0, the expected copies
of each document, are then fitted by projected gradient descent on the least squares
|A r - T|, where A r are the expected words of each domain and T the targets. A step is
measured by the inverse of the domains' Gram matrix over the documents whose rate isn't
zero, which makes few steps do, and halved where it leads no nearer. It needs one pass of
sums over the documents in Spark; a document's rate follows from its posterior and the
steps so far, so nothing but those few numbers travels.

Every domain is fitted. A step is damped for domains with less than about RIDGE of the
words, and the fit ends when a step moves no total any more; what then misses its target
is named in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.words import word_hashes
from quernstone.llm.work import Work, slices, unused

#: Labelled documents that the classifier is fitted on at most: those with the smallest
#: hashes of their ids.
MAX_LABELLED = 20_000
WORD_BITS, SMOOTHING = 18, 0.5
#: Evidence of longer documents is scaled down to that of so many words, so that
#: posteriors stay soft.
EVIDENCE = 200
#: What damps steps, the change of the domains' totals that ends them, and the miss of a
#: target that is reported; all in parts of all words.
RIDGE, TOLERANCE, MISS = 1e-6, 1e-6, 1e-3
#: The shortest part of a step that is tried.
SMALLEST = 2.0**-12

DOMAINS = ("good", "plain", "toxic")
#: Shares of words that the mix should have.
TARGETS = {"good": 0.80, "plain": 0.18, "toxic": 0.02}


def domain(quality: Column, toxic: Column) -> Column:
    """Number of a label's domain in DOMAINS; null if neither column says anything."""
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality.isNotNull() | toxic.isNotNull(), 1)


def _slots(text: str | None) -> np.ndarray:
    return (word_hashes(text) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _count(batches):
    sums = np.zeros((len(DOMAINS), 1 << WORD_BITS), np.int64)
    docs = np.zeros(len(DOMAINS), np.int64)
    for batch in batches:
        for rows in slices(batch, 0):
            for text, of in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                np.add.at(sums[of], _slots(text), 1)
                docs[of] += 1
    for of in range(len(DOMAINS)):
        used = np.flatnonzero(sums[of])
        slot, n = np.append(used, -1), np.append(sums[of][used], docs[of])
        yield pa.RecordBatch.from_arrays([pa.array([of] * len(slot), pa.int32()), pa.array(slot.astype(np.int32)), pa.array(n)], names=["domain", "slot", "n"])


@dataclass
class Classifier:
    logs: np.ndarray  # domain x bucket
    priors: np.ndarray

    def posterior(self, text: str | None) -> tuple[int, np.ndarray]:
        """Words of a text, and the probability of each domain."""
        own = _slots(text)
        sums = self.logs[:, own].sum(axis=1, dtype=np.float64) * min(1, EVIDENCE / max(1, len(own))) + self.priors
        chances = np.exp(sums - sums.max())
        return len(own), chances / chances.sum()


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """A classifier from the texts of at most max_labelled labelled documents; without
    any, every domain is as likely."""
    known = labels.select(F.col("doc_id").cast("long").alias("_labelled"), domain(F.col("quality"), F.col("toxic")).alias("domain")).where("_labelled is not null and domain is not null")
    sample = known.orderBy(F.xxhash64("_labelled"), "_labelled", "domain").limit(max_labelled)
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled")).where("text is not null").select("text", "domain")
    counts = rows.mapInArrow(_count, "domain int, slot int, n long").groupBy("domain", "slot").agg(F.sum("n").alias("n"))
    found = Work(docs.sparkSession, "domains").table(counts, "counts").toArrow()
    of, slot, n = (found.column(k).to_numpy() for k in ("domain", "slot", "n"))
    table, docs_of = np.full((len(DOMAINS), 1 << WORD_BITS), SMOOTHING), np.ones(len(DOMAINS))
    table[of[slot >= 0], slot[slot >= 0]] += n[slot >= 0]
    docs_of[of[slot < 0]] += n[slot < 0]
    return Classifier((np.log(table) - np.log(table.sum(axis=1, keepdims=True))).astype(np.float32), np.log(docs_of / docs_of.sum()))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens (words) and p, the posterior over DOMAINS, of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for rows in slices(batch, 1):
                found = [shared.value.posterior(text) for text in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([p.tolist() for _, p in found], pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def rates(p: np.ndarray, words: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates of documents, from their posteriors, after all steps; one without words is
    no part of any total and stays at 1."""
    out = np.ones(len(p))
    for step in steps:
        out = np.maximum(0.0, out - p @ step)
    return np.where(words > 0, out, 1.0)


def _sums(members: DataFrame, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """At the rates after all steps: expected words of each domain, and the Gram matrix of
    the domains over the documents whose rate isn't zero."""
    width = len(DOMAINS)
    names = [f"s{k}" for k in range(width * (width + 1))]

    def run(batches):
        totals, gram = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            words = batch.column(0).to_numpy()
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            own = rates(p, words, steps)
            totals += (words * own) @ p
            gram += (p * (words * (own > 0))[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in (*totals, *gram.reshape(-1))], names=names)

    parts = members.select("n_tokens", "p").mapInArrow(run, ", ".join(f"{x} double" for x in names))
    found = np.array([x or 0.0 for x in parts.agg(*(F.sum(x) for x in names)).first()])
    return found[:width], found[width:].reshape(width, width)


@dataclass
class Fit:
    """Steps of the projected gradient, the totals that they give and those wanted, and the
    words of the table."""

    steps: list[np.ndarray]
    totals: np.ndarray
    goal: np.ndarray
    words: float

    def unmet(self) -> list[str]:
        """Domains whose totals miss their targets."""
        return [x for x, a, b in zip(DOMAINS, self.totals, self.goal, strict=True) if abs(a - b) > MISS * self.words]


def fit_rates(members: DataFrame, targets: np.ndarray, budget: float | None = None) -> Fit:
    """The projected gradient to its end. targets are shares of the words of the mix, budget
    those words, by default as many as there are. Where posteriors can't meet the targets,
    rates come as near as least squares allow.

    A step is the gradient in the metric of the documents that still have a rate. Where it
    doesn't bring the totals nearer, as when rates would fall below zero, it is halved; so
    the distance falls with each step taken, until steps move the totals no more.
    """
    now, gram = _sums(members, [])
    words = float(now.sum())
    goal = targets / targets.sum() * (budget or words)
    if not words:
        return Fit([], now, now, words)
    ridge = np.eye(len(DOMAINS)) * words * RIDGE
    steps: list[np.ndarray] = []
    size = 1.0
    while size >= SMALLEST:
        step = np.linalg.solve(gram + ridge, now - goal) * size
        found, active = _sums(members, [*steps, step])
        if np.linalg.norm(found - goal) >= np.linalg.norm(now - goal):
            size /= 2
            continue
        moved = np.abs(found - now).max()
        steps, now, gram, size = [*steps, step], found, active, min(1.0, 2 * size)
        if moved <= TOLERANCE * words:
            break
    return Fit(steps, now, goal, words)


def clean_budget(members: DataFrame, targets: np.ndarray, clean=(0, 1), headroom: float = 1.05) -> float:
    """Words of a mix that thins none of the clean domains: they are repeated instead."""
    sums = [x or 0.0 for x in members.agg(*(F.sum(F.col("n_tokens") * F.col("p")[k]) for k in range(len(DOMAINS)))).first()]
    return headroom * max(sums[k] / targets[k] * targets.sum() for k in clean)


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], keep_clean: bool, id_col: str, text_col: str) -> tuple[Classifier, DataFrame, Fit]:
    """The classifier, the documents' memberships as a table, and the fit."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(rows, labels)
    members = Work(docs.sparkSession, "mix").table(memberships(rows, model), "members")
    goal = np.array([targets[x] for x in DOMAINS], float)
    return model, members, fit_rates(members, goal, clean_budget(members, goal) if keep_clean else None)


def _chance(doc_id: Column) -> Column:
    """From 0 to 1, by a hash of the id: rates round up by it or down."""
    return F.pmod(F.xxhash64(F.lit("copies"), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, *, keep_clean: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, p_<domain>, rate, copies, the whole number
    that the rate rounds to, up or down by a hash of the id, and unmet, the domains whose
    totals miss their targets, comma-joined: the same in all rows.

    A null text has no words, the prior's posterior and rate 1; null ids never count as
    labelled and hash as null does; repeated rows each get the rate of their text; a
    document labelled more than once counts with each of its labels. Other columns take
    no part. An empty table gives an empty result.
    """
    _, members, fit = _fitted(docs, labels, targets, keep_clean, id_col, text_col)

    def run(batches):
        for batch in batches:
            words = batch.column(1).to_numpy()
            p = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS))
            own = rates(p, words, fit.steps)
            copies = np.floor(own + batch.column(3).to_numpy()).astype(np.int64)
            columns = [batch.column(0), batch.column(1), *(pa.array(p[:, k]) for k in range(len(DOMAINS))), pa.array(own), pa.array(copies)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *(f"p_{x}" for x in DOMAINS), "rate", "copies"])

    schema = f"doc_id long, n_tokens long, {', '.join(f'p_{x} double' for x in DOMAINS)}, rate double, copies long"
    return members.withColumn("chance", _chance(F.col("doc_id"))).mapInArrow(run, schema).withColumn("unmet", F.lit(",".join(fit.unmet())))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs (with doc_id and text), each as often as its copies say, in a mix
    that repeats rather than thins the clean domains.

    A row's rate follows from its own text and the fitted steps, so rows are repeated where
    they are, in one pass; nothing is joined. Null texts and texts without words have rate
    1; rows that share an id have rates of their own but round alike; an empty table stays
    empty.
    """
    model, _, fit = _fitted(docs, labels, targets, True, "doc_id", "text")
    shared, at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            for rows in slices(batch, at):
                found = [shared.value.posterior(text) for text in rows.column(at).to_pylist()]
                own = rates(np.array([p for _, p in found]), np.array([n for n, _ in found]), fit.steps)
                copies = np.floor(own + rows.column(len(names)).to_numpy()).astype(np.int64)
                for k in range(int(copies.max(initial=0))):
                    yield rows.select(list(range(len(names)))).filter(pa.array(copies > k))

    return docs.withColumn(unused(docs, "_chance"), _chance(F.col("doc_id"))).mapInArrow(run, docs.schema)
