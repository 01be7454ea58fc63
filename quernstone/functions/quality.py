"""Quality scores of text by rules, as column functions. Scores run from 0 to 100."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import contains_any, hits, let, occurrences, safe, sentences, strip, words

# Word lists, weights and thresholds of the scores.
TRANSITIONS = ("however", "therefore", "furthermore", "moreover", "additionally", "consequently", "meanwhile", "subsequently", "nevertheless", "thus")
PRONOUNS = ("it", "this", "that", "these", "those", "they", "them")
CONNECTORS = ("because", "since", "therefore", "thus", "so")
FACTUAL = ("is", "are", "was", "were", "has", "have", "will", "can", "cannot")
UNCERTAIN = ("maybe", "perhaps", "possibly", "might", "could", "seems")
CONCLUSIONS = ("in conclusion", "finally", "to summarize", "overall", "therefore")
TRUNCATIONS = ("...", "[truncated]", "continued", "more")
METRICS = ("coherence", "factuality", "compliance", "completeness", "fluency", "relevance")
WEIGHTS = {"coherence": 0.15, "factuality": 0.40, "compliance": 0.20, "completeness": 0.10, "fluency": 0.10, "relevance": 0.05}
MINIMUMS = {"coherence": 75.0, "factuality": 95.0, "compliance": 90.0, "completeness": 80.0, "fluency": 75.0, "relevance": 70.0}
PREMIUM, STANDARD, BASIC = 95.0, 85.0, 70.0


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def feature_sentences(text: Column) -> Column:
    """Sentences of over five characters."""
    return sentences(text, 6)


def _word_sets(text: Column) -> Column:
    return F.transform(feature_sentences(text), lambda s: F.array_distinct(words(F.lower(s))))


def _adjacent(items: Column, pair) -> Column:
    """pair(current, next) for each item but the last."""
    n = F.size(items)
    return F.when(n > 1, F.zip_with(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), F.slice(items, 2, F.greatest(n - 1, F.lit(1))), pair)).otherwise(F.array())


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


#: Sentences, and cells of their table by words, up to which all pairs are one matrix product.
DENSE_ROWS, DENSE_CELLS = 2048, 1 << 23


def topic_consistency(text: Column) -> Column:
    """Mean Jaccard overlap of all pairs of sentences; one half for fewer than two.

    Only sentences that share a word overlap, so pairs are counted through lists of the
    sentences of each word, in Arrow batches.
    """
    return _mean_overlap(_word_sets(text))


@F.arrow_udf(T.DoubleType())
def _mean_overlap(sets: pa.Array) -> pa.Array:
    sentences_of, words_of = sets.flatten(), sets.flatten().flatten()
    codes = words_of.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    n_words = pc.list_value_length(sentences_of).to_numpy(zero_copy_only=False)
    n_sentences = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False)
    ends, out = np.concatenate(([0], np.cumsum(n_words))), []
    at = 0
    for n in n_sentences.tolist():
        out.append(mean_overlap(codes[ends[at] : ends[at + n]], n_words[at : at + n]))
        at += n
    return pa.array(out, pa.float64())


def mean_overlap(words_of: np.ndarray, sizes: np.ndarray) -> float:
    """The mean over all pairs of sentences of their words in both over those in either (over
    one at least). words_of has a number for each sentence's distinct words, one sentence
    after the other; sizes says how many each has."""
    n, sizes = len(sizes), sizes.astype(np.int64)
    if n < 2:
        return 0.5
    numbers, words_of = np.unique(words_of, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    if n <= DENSE_ROWS and n * len(numbers) <= DENSE_CELLS:
        table = np.zeros((n, max(1, len(numbers))), np.float32)
        table[owner, words_of] = 1
        both = np.triu((table @ table.T).astype(float), 1)
        return float((both / np.maximum(1, sizes[:, None] + sizes[None, :] - both)).sum()) / (n * (n - 1) / 2)
    order = np.argsort(words_of, kind="stable")
    ends = np.cumsum(np.bincount(words_of))
    sentences_of = owner[order]  # of each word, ascending
    starts = np.concatenate(([0], ends[:-1]))
    at, total = np.concatenate(([0], np.cumsum(sizes))), 0.0
    for k in range(n - 1):
        lists = [sentences_of[starts[w] : ends[w]] for w in words_of[at[k] : at[k + 1]].tolist()]
        lists = [x[np.searchsorted(x, k, side="right") :] for x in lists]
        if lists:
            shared = np.bincount(np.concatenate(lists) - k - 1, minlength=1)
            near = np.flatnonzero(shared)
            shared = shared[near]
            total += float((shared / (sizes[k] + sizes[near + k + 1] - shared)).sum())
    return total / (n * (n - 1) / 2)


def _parts(text: Column, overlap: bool = False) -> Column:
    """What the scores share, computed once: the text, in lower case too, its words, its
    sentences, and the sentences in lower case and as words."""
    found = feature_sentences(text)
    first = [safe(text).alias("text"), F.lower(safe(text)).alias("low"), found.alias("sentences"), F.transform(found, F.lower).alias("lowered")]
    first += [topic_consistency(text).alias("overlap")] * overlap

    def rest(b):
        kept = [b[x].alias(x) for x in ("text", "low", "sentences", "lowered", *(["overlap"] * overlap))]
        return F.struct(*kept, words(b["low"]).alias("words"), F.transform(b["lowered"], words).alias("word_lists"))

    return let(F.struct(*first), rest)


def logical_flow(text: Column) -> Column:
    """Connectors early in the next sentence (1) and shared words (half) over transitions."""
    return let(_parts(text), _logical_flow)


def _logical_flow(b: Column) -> Column:
    leads = _total(_adjacent(b["lowered"], lambda _, after: F.when(contains_any(F.substring(after, 1, 50), CONNECTORS), 1.0).otherwise(0.0)))
    n = F.size(b["lowered"]) - 1
    return F.when(n <= 0, 0.5).otherwise(F.least(F.lit(1.0), (leads + _shared(b) * 0.5) / n))


def _shared(b: Column) -> Column:
    """How many sentences share a word with the next one."""
    return F.size(F.filter(_adjacent(b["word_lists"], F.arrays_overlap), lambda x: x))


def coherence(text: Column) -> Column:
    return let(_parts(text, overlap=True), _coherence)


def _coherence(b: Column) -> Column:
    pronouns = F.size(F.filter(b["words"], lambda w: w.isin(*PRONOUNS)))
    bonus = F.least(F.lit(20.0), hits(b["low"], TRANSITIONS) * 2.0) + F.least(F.lit(10.0), pronouns * 1.0)
    found = 70 + bonus + b["overlap"] * 15 + _logical_flow(b) * 10 - _length_penalty(b)
    return F.when(F.size(b["sentences"]) < 2, 50.0).otherwise(clamp(found))


def _length_penalty(b: Column) -> Column:
    """Ten times the variance of sentence lengths over their mean, 15 at most."""

    def penalty(sizes):
        spread = lambda mean: _total(F.transform(sizes, lambda x: (x - mean) * (x - mean))) / (F.size(sizes) - 1) / mean
        return let(F.try_divide(_total(sizes), F.size(sizes)), lambda mean: F.when(mean > 0, F.least(F.lit(15.0), spread(mean) * 10)).otherwise(0.0))

    return let(F.transform(b["word_lists"], lambda s: F.size(s).cast("double")), penalty)


def word_recall(text: Column, original: Column) -> Column:
    """Share of the original's distinct words that the text has; null if it has none."""
    known, own = (F.array_distinct(words(F.lower(safe(x)))) for x in (original, text))
    return F.when(F.size(known) > 0, F.size(F.array_intersect(own, known)) / F.size(known))


def factuality(text: Column, original: Column | None = None) -> Column:
    low = F.lower(safe(text))
    basic = clamp(80 + F.least(F.lit(15.0), hits(low, FACTUAL) * 2.0) - F.least(F.lit(20.0), hits(low, UNCERTAIN) * 3.0), 50.0)
    if original is None:
        return basic
    long = F.length(safe(text)) / F.length(original) > 1.5
    compared = F.least(F.lit(100.0), word_recall(text, original) * 100 * F.when(long, 0.9).otherwise(1.0))
    return F.when(safe(original) == "", basic).otherwise(F.coalesce(compared, F.lit(50.0)))


def compliance(text: Column, target: str) -> Column:
    """How well a text keeps to qwen, alpaca, chatml, sharegpt or llama2; 0 for others."""
    text = safe(text)
    lacks = lambda mark, points: F.when(F.contains(text, F.lit(mark)), 0.0).otherwise(points)
    count = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    if target == "qwen":
        turn = F.rlike(text, F.lit(r"(?s)<\|user\|>\s*(.+?)\s*<\|assistant\|>\s*(.+?)(?=<\|user\|>|$)"))
        lost = lacks("<|user|>", 50.0) + lacks("<|assistant|>", 50.0) + F.when(turn, 0.0).otherwise(30.0)
    elif target == "alpaca":
        lost = F.when(F.startswith(text, F.lit("### Instruction:")), 0.0).otherwise(40.0) + lacks("### Response:", 40.0) + F.when(count("### Response:") > 1, 20.0).otherwise(0.0)
    elif target == "chatml":
        lost = lacks("<|im_start|>", 50.0) + lacks("<|im_end|>", 50.0) + F.when(count("<|im_start|>") != count("<|im_end|>"), 30.0).otherwise(0.0)
    elif target == "sharegpt":
        parsed = F.try_parse_json(text)
        items = F.from_json(text, "array<map<string,string>>")
        good = F.forall(items, lambda m: F.map_contains_key(m, "from") & F.map_contains_key(m, "value"))
        is_list = F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY"))
        lost = F.when(parsed.isNull(), 100.0).when(~is_list, 50.0).when(F.coalesce(good, F.lit(False)), 0.0).otherwise(20.0)
    elif target == "llama2":
        lost = lacks("[INST]", 50.0) + lacks("[/INST]", 50.0)
    else:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), 100.0 - lost)


def completeness(text: Column, compat: bool = False) -> Column:
    """A quarter each for a conclusion, no sign of truncation, a last sentence that ends,
    and fifty characters. With compat, sentences count as complete only if there are
    none, since cutting at their ends leaves no mark at any of them."""
    low = F.lower(safe(text))
    ends = F.size(feature_sentences(text)) == 0 if compat else F.rlike(strip(text), F.lit(r"[.!?][\"')\]]*$"))
    cut = contains_any(low, TRUNCATIONS if compat else TRUNCATIONS[:-1]) | (F.lit(False) if compat else F.rlike(low, F.lit(r"\bmore\s*$")))
    met = contains_any(low, CONCLUSIONS).cast("int") + (~cut).cast("int") + ends.cast("int") + (F.length(strip(text)) >= 50).cast("int")
    return met / F.lit(4) * 100


def grammar(text: Column) -> Column:
    return let(_parts(text), _grammar)


def _grammar(b: Column) -> Column:
    n, capital = F.size(b["sentences"]), F.size(F.filter(b["sentences"], lambda s: F.rlike(s, F.lit(r"^\p{Lu}"))))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(100.0), 80 + capital / n * 20))


def readability(text: Column) -> Column:
    return let(_parts(text), _readability)


def _readability(b: Column) -> Column:
    n, n_words = F.size(b["sentences"]), F.size(b["words"])
    mean = n_words / n
    return F.when((n == 0) | (n_words == 0), 0.0).when(mean.between(10, 25), 90.0).when(mean.between(5, 35), 75.0).otherwise(60.0)


def natural_flow(text: Column) -> Column:
    return let(_parts(text), _natural_flow)


def _natural_flow(b: Column) -> Column:
    return F.when(F.size(b["lowered"]) < 2, 70.0).otherwise(F.least(F.lit(100.0), 70.0 + 5.0 * _shared(b)))


def diversity(text: Column) -> Column:
    return let(words(F.lower(safe(text))), _diversity)


def _diversity(all_words: Column) -> Column:
    n = F.size(all_words)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(100.0), F.size(F.array_distinct(all_words)) / n * 120))


def fluency(text: Column) -> Column:
    return let(_parts(text), _fluency)


def _fluency(b: Column) -> Column:
    return _grammar(b) * 0.3 + _readability(b) * 0.3 + _natural_flow(b) * 0.2 + _diversity(b["words"]) * 0.2


def fluency_parts(text: Column) -> Column:
    """Struct of readability, diversity, natural_flow and grammar."""
    return let(_parts(text), lambda b: F.struct(_readability(b).alias("readability"), _diversity(b["words"]).alias("diversity"), _natural_flow(b).alias("natural_flow"), _grammar(b).alias("grammar")))


def relevance(text: Column, context: Column | None = None) -> Column:
    if context is None:
        return F.lit(75.0)
    return F.coalesce(F.least(F.lit(100.0), word_recall(text, context) * 100), F.lit(75.0))


def metric_scores(text: Column, target: str, original: Column | None = None, context: Column | None = None, compat: bool = False) -> Column:
    """Struct of the six metrics."""

    def scores(b):
        return F.struct(
            _coherence(b).alias("coherence"),
            factuality(b["text"], original).alias("factuality"),
            compliance(b["text"], target).alias("compliance"),
            completeness(b["text"], compat).alias("completeness"),
            _fluency(b).alias("fluency"),
            relevance(b["text"], context).alias("relevance"),
        )

    return let(_parts(text, overlap=True), scores)


def scored(text: Column, target: str, original: Column | None = None, context: Column | None = None, compat: bool = False) -> Column:
    """Struct of the six metrics, overall, tier, shortfalls and route; metrics once."""

    def rest(m):
        total = overall(m)
        return F.struct(*(m[k].alias(k) for k in METRICS), total.alias("overall"), tier(total).alias("tier"), shortfalls(m).alias("shortfalls"), route(total).alias("route"))

    return let(metric_scores(text, target, original, context, compat), rest)


def overall(scores: Column) -> Column:
    return sum(scores[m] * w for m, w in WEIGHTS.items())


def tier(score: Column) -> Column:
    return F.when(score >= PREMIUM, "premium").when(score >= STANDARD, "standard").when(score >= BASIC, "basic").otherwise("remediation")


def shortfalls(scores: Column) -> Column:
    """The metrics below their minimum."""
    return F.array_compact(F.array(*(F.when(scores[m] < least, F.lit(m)) for m, least in MINIMUMS.items())))


def needs_remediation(scores: Column) -> Column:
    return (overall(scores) < BASIC) | (F.size(shortfalls(scores)) > 0)


def route(score: Column) -> Column:
    return F.when(score < BASIC, "remediate").otherwise("accept")


RULE_METRICS = ("accuracy", "fluency", "personality_depth", "coherence", "training_readiness")


def rule_scores(text: Column) -> Column:
    """Struct of five scores by word and sentence counts, and overall, their mean."""
    n_words = F.size(words(text))
    n_sentences = F.size(F.filter(F.split(safe(text), r"\."), lambda s: strip(s) != ""))
    accuracy, fluent = clamp(70 + (n_words - 50) * 0.1), clamp(60.0 + n_sentences * 2)
    coherent, ready = clamp(65.0 + (n_sentences - 3) * 3), F.when(n_words.between(20, 200), 70.0).otherwise(40.0)
    return F.struct(accuracy.alias("accuracy"), fluent.alias("fluency"), F.lit(50.0).alias("personality_depth"), coherent.alias("coherence"), ready.alias("training_readiness"), ((accuracy + fluent + 50 + coherent + ready) / 5).alias("overall"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def recommendations(averages: dict[str, Column]) -> Column:
    """Codes of what to improve, from the averages of rule_scores; then the verdict."""
    limits = {"accuracy": 70, "fluency": 70, "personality_depth": 60, "coherence": 70, "training_readiness": 70}
    low = [F.when(averages[m] < least, F.lit("improve_" + m)) for m, least in limits.items()]
    verdict = F.when(averages["overall"] > 85, "excellent").when(averages["overall"] > 70, "good").otherwise("insufficient")
    return F.array_compact(F.array(*low, verdict))


def parsed_model_scores(reply: Column) -> Column:
    """Struct of scores from a model's reply: its outermost JSON object, else numbers after
    the metrics' names, else defaults (50, and 0.5 for confidence)."""
    reply = safe(reply)
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.when(body != "", F.try_parse_json(body))

    def value(name: str, pattern: str, most: float) -> Column:
        named = F.regexp_extract(reply, rf"(?i){pattern}[:\s]+([0-9.]+)", 1).try_cast("double")
        return F.when(parsed.isNotNull(), F.try_variant_get(parsed, f"$.{name}", "double")).otherwise(F.when(named.isNotNull(), F.least(F.lit(most), named)))

    found = {m: value(m, m.replace("_", r"[_\s]*"), 100.0) for m in RULE_METRICS}
    filled = {m: F.coalesce(c, F.lit(50.0)) for m, c in found.items()}
    mean = sum(filled.values()) / len(filled)
    total = F.coalesce(value("overall", "overall", 100.0), F.when(parsed.isNull(), mean), F.lit(50.0))
    return F.struct(*(c.alias(m) for m, c in filled.items()), total.alias("overall"), F.coalesce(value("confidence", "confidence", 1.0), F.lit(0.5)).alias("confidence"))


def accuracy_metrics(text: Column, original: Column, target: str) -> Column:
    """Struct of compliance, preservation (word recall of the original) and consistency
    (10 less where contractions mix with full forms)."""
    mixed = F.rlike(safe(text), F.lit(r"(?i)\b\w+n't\b")) & F.rlike(safe(text), F.lit(r"(?i)\b(?:do|does|did|is|are|was|were|can|will|would|should|could) ?not\b"))
    return F.struct(compliance(text, target).alias("compliance"), F.coalesce(word_recall(text, original) * 100, F.lit(100.0)).alias("preservation"), F.when(mixed, 90.0).otherwise(100.0).alias("consistency"))


def text_quality(text: Column) -> Column:
    """Struct grammar, clarity, completeness, structure (0 to 1) and overall, weighted."""
    text = safe(text)
    found, all_words = sentences(text), words(text)
    n = F.greatest(F.size(found), F.lit(1))
    mean = F.size(all_words) / n
    grammatical = F.greatest(F.lit(0.0), 1.0 - 0.1 * (F.regexp_count(text, F.lit(r"\s{2,}")) + F.regexp_count(text, F.lit(r"\s[,.!?]")) + F.regexp_count(text, F.lit(r"\bi\b"))))
    clear = F.when(mean.between(10, 20), 1.0).when(mean.between(5, 30), 0.8).otherwise(0.5)
    whole = F.when(F.size(all_words) == 0, 0.0).otherwise((F.rlike(strip(text), F.lit(r"[.!?]$")).cast("double") + F.least(F.lit(1.0), F.size(all_words) / 20)) / 2)
    structured = F.when(F.size(found) >= 3, 1.0).when(F.size(found) == 2, 0.8).when(F.size(found) == 1, 0.6).otherwise(0.0)
    total = grammatical * 0.3 + clear * 0.3 + whole * 0.2 + structured * 0.2
    return F.struct(grammatical.alias("grammar"), clear.alias("clarity"), whole.alias("completeness"), structured.alias("structure"), total.alias("overall"))


def enhancement(scores: Column) -> Column:
    """The first of grammar, clarity, structure, completeness below 0.7; null if none."""
    out = F.lit(None).cast("string")
    for name in ("completeness", "structure", "clarity", "grammar"):
        out = F.when(scores[name] < 0.7, name).otherwise(out)
    return out


def exclamations(text: Column) -> Column:
    return occurrences(text, "!")
