"""Predicates and scores of the quality and policy filters, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import contained, hits, let, safe, sentences, strip, words

# Patterns, keywords and thresholds of the filters.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "ip_address": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}
SENSITIVE = ("password", "secret", "confidential", "classified", "personal information", "private", "restricted")
LICENSING = ("copyright", "all rights reserved", "proprietary", "confidential and proprietary", "trade secret")
UNSAFE = ("hate", "violence", "explicit", "harmful")
DOMAIN_KEYWORDS = (
    "machine learning", "artificial intelligence", "neural network", "deep learning", "algorithm",
    "software", "programming", "computer", "system", "application",
    "learn", "teach", "explain", "understand", "knowledge",
    "question", "answer", "help", "information", "explain",
)
SPAM = ("click here", "buy now", "limited time", "act fast")
INCOMPLETE = ("...", "todo", "fixme", "coming soon")
PLAIN_CHARS = r"[a-zA-Z\s.,!?;:'\"-]"
MIN_LANGUAGE, MIN_DOMAIN, MIN_COHERENCE, MIN_SAFETY = 0.7, 0.3, 0.5, 0.8
MIN_CHARS, MAX_CHARS = 10, 8192
MIN_BYTES, MAX_BYTES, EXTENSIONS = 100, 10_000_000, ("json", "jsonl", "txt")


def language_score(text: Column, compat: bool = False) -> Column:
    """Share of characters that are plain English text. With compat, runs of them over
    characters instead, which only stays far below one."""
    text = safe(text)
    found = F.regexp_count(text, F.lit(PLAIN_CHARS + "+")) if compat else F.length(text) - F.length(F.regexp_replace(text, PLAIN_CHARS + "+", ""))
    return F.when(F.length(text) > 0, F.least(F.lit(1.0), found / F.length(text))).otherwise(0.0)


def domain_relevance(text: Column) -> Column:
    """Share of the domain keywords (one of them counts twice) that the text contains."""
    return hits(F.lower(safe(text)), DOMAIN_KEYWORDS) / F.lit(len(DOMAIN_KEYWORDS))


def has_gibberish(text: Column) -> Column:
    """Is any character but a line end repeated five times in a row?"""
    return F.rlike(safe(text), F.lit(r"(.)\1{4,}"))


def quality_issues(text: Column) -> Column:
    """Codes of spam phrases, gibberish and incompleteness, in that order."""
    low = F.lower(safe(text))
    spam = F.transform(contained(low, SPAM), lambda p: F.concat(F.lit("spam:"), p))
    gibberish = F.when(has_gibberish(text), F.array(F.lit("gibberish"))).otherwise(F.array().cast("array<string>"))
    return F.concat(spam, gibberish, F.transform(contained(low, INCOMPLETE), lambda p: F.concat(F.lit("incomplete:"), p)))


def coherence(text: Column) -> Column:
    """One less the mean deviation of sentence lengths in words over their mean, 0 to 1;
    one half for fewer than two sentences."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def score(sizes):
        n = F.size(sizes)
        found = let(total(sizes) / n, lambda mean: 1 - total(F.transform(sizes, lambda x: F.abs(x - mean))) / n / mean)
        return F.when(n < 2, 0.5).otherwise(F.greatest(F.lit(0.0), found))

    return let(F.transform(sentences(text), lambda s: F.size(words(s)).cast("double")), score)


def semantic_result(text: Column, compat: bool = False) -> Column:
    """Struct passed, errors, warnings of the semantic sanity filter."""
    bare = F.length(strip(text))
    errors = F.array_compact(
        F.array(
            F.when(language_score(text, compat) < MIN_LANGUAGE, "low_language_score"),
            F.when(F.size(quality_issues(text)) > 0, "quality_issue"),
            F.when(bare < MIN_CHARS, "too_short"),
            F.when(F.length(safe(text)) > MAX_CHARS, "too_long"),
        )
    )
    warnings = F.array_compact(F.array(F.when(domain_relevance(text) < MIN_DOMAIN, "low_domain_relevance"), F.when(coherence(text) < MIN_COHERENCE, "low_coherence")))
    return F.struct((F.size(errors) == 0).alias("passed"), errors.alias("errors"), warnings.alias("warnings"))


def pii_types(text: Column) -> Column:
    """The kinds of personal data that the text has."""
    return F.array_compact(F.array(*(F.when(F.rlike(safe(text), F.lit(p)), F.lit(k)) for k, p in PII_PATTERNS.items())))


def sensitive_topics(text: Column) -> Column:
    return contained(F.lower(safe(text)), SENSITIVE)


def licence_violations(text: Column) -> Column:
    return contained(F.lower(safe(text)), LICENSING)


def content_safety(text: Column) -> Column:
    """One less a fifth for each unsafe word that the text contains."""
    return (5 - hits(F.lower(safe(text)), UNSAFE)) / F.lit(5)


def policy_result(text: Column) -> Column:
    """Struct passed, errors, warnings of the policy filter: personal data and licences
    are errors, sensitive topics and unsafe words warnings."""
    prefixed = lambda kind, found: F.transform(found, lambda x: F.concat(F.lit(kind + ":"), x))
    errors = F.concat(prefixed("pii", pii_types(text)), prefixed("licence", licence_violations(text)))
    warnings = F.concat(prefixed("sensitive", sensitive_topics(text)), F.when(content_safety(text) < MIN_SAFETY, F.array(F.lit("unsafe"))).otherwise(F.array().cast("array<string>")))
    return F.struct((F.size(errors) == 0).alias("passed"), errors.alias("errors"), warnings.alias("warnings"))


def gate_result(path: Column, size: Column) -> Column:
    """Struct passed, errors of the gate before ingestion: size and extension of a file."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    errors = F.array_compact(
        F.array(
            F.when(path.isNull() | size.isNull(), "missing"),
            F.when(size < MIN_BYTES, "too_small"),
            F.when(size > MAX_BYTES, "too_large"),
            F.when(~extension.isin(*EXTENSIONS), "bad_extension"),
        )
    )
    return F.struct((F.size(errors) == 0).alias("passed"), errors.alias("errors"))
