"""Column functions on text: words, sentences, token estimates and features.

All take a string column and read null as the empty text. White space is ASCII unless a
function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once. Inside a lambda an expression is computed
    for each element, and nothing is shared; what is bound here is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(safe(text), F.lit(" \t\n\x0b\f\r"))


def squeeze(text: Column) -> Column:
    """Any white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(safe(text), r"\s+", " "))


def words(text: Column) -> Column:
    """Words between white space, in order."""
    return F.array_remove(F.split(safe(text), r"\s+"), "")


def sentences(text: Column, min_chars: int = 1) -> Column:
    """What stands between runs of . ! and ?, stripped, of at least min_chars characters."""
    return F.filter(F.transform(F.split(safe(text), r"[.!?]+"), strip), lambda x: F.length(x) >= min_chars)


def capital_sentences(text: Column) -> Column:
    """Sentences cut at white space between . ! or ? and a capital A-Z."""
    return F.filter(F.transform(F.split(safe(text), r"(?<=[.!?])\s+(?=[A-Z])"), strip), lambda x: x != "")


def prose_sentences(text: Column) -> Column:
    """Sentences cut at white space after . ? or !, but not after abbreviations such as
    "e.g." or "Mr."."""
    return F.filter(F.transform(F.split(strip(text), r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s+"), strip), lambda x: x != "")


def segments(text: Column, min_chars: int = 10) -> Column:
    """Paragraphs, cut again after a question mark before a capital; short ones dropped."""
    paragraphs = F.transform(F.split(safe(text), "\n\n"), lambda p: F.split(strip(p), r"(?<=\?)\s+(?=[A-Z])"))
    return F.filter(F.transform(F.flatten(paragraphs), strip), lambda x: F.length(x) >= min_chars)


def tokens_by_ratio(text: Column) -> Column:
    """Tokens as words * 1.33, one at least; none for an empty text."""
    n = F.size(words(text))
    return F.when(n == 0, F.when(safe(text) == "", 0).otherwise(1)).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1.33)))).cast("long")


def tokens_by_words(text: Column) -> Column:
    """Tokens as three quarters of the words."""
    return F.floor(F.size(words(text)) * F.lit(0.75)).cast("long")


def tokens_by_chars(text: Column) -> Column:
    """Tokens as a quarter of the characters."""
    return F.floor(F.length(safe(text)) / 4).cast("long")


def contains_any(text: Column, phrases) -> Column:
    """Does the text contain any of the phrases?"""
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(text, F.lit(phrase))
    return out


def contained(text: Column, phrases) -> Column:
    """The phrases that the text contains, in their order."""
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases)))


def hits(text: Column, phrases) -> Column:
    """How many of the phrases the text contains."""
    out = F.lit(0)
    for phrase in phrases:
        out = out + F.contains(text, F.lit(phrase)).cast("int")
    return out


def occurrences(text: Column, char: str) -> Column:
    """How often a single character occurs."""
    return F.length(safe(text)) - F.length(F.replace(safe(text), F.lit(char), F.lit("")))


# Word lists of the question and answer scores.
QUESTION_WORDS = ("what", "how", "why", "when", "where", "who", "which")
MODAL_VERBS = ("can", "could", "would", "should", "might", "may")
IMPERATIVES = ("please", "tell", "explain", "describe", "show")
ANSWER_STARTS = ("the", "this", "that", "it", "you", "your", "according to", "based on")
ANSWER_PHRASES = ("because", "therefore", "as a result", "in order to", "due to")
QUESTION_PATTERNS = (
    r"\?$",
    r"^(what|how|why|when|where|who|which|can|could|would|should|do|does|did|is|are|was|were)\b",
    r"^(tell me|explain|describe|help me understand|show me|guide me)",
    r"^(please|could you|would you|can you)",
    r"(how to|what is|what are|how do|how does)",
)
ANSWER_PATTERNS = (
    r"^(the|this|that|it|you|your|according to|based on)",
    r"^(research shows|studies indicate|experts say|scientists believe)",
    r"^(in order to|to achieve|the key is|the solution)",
    r"^(first|second|third|next|then|finally)",
    r"\.$",
    r"^[a-z][^.!?]*[.!]$",
)


def features(text: Column) -> Column:
    """Struct of twelve features of a segment: sizes, marks, how it starts and ends, and
    which groups of words it contains (as substrings, in lower case)."""
    text, low = safe(text), F.lower(strip(text))
    first = F.substring(text, 1, 1)
    return F.struct(
        F.length(text).cast("long").alias("length"),
        F.size(words(text)).cast("long").alias("word_count"),
        occurrences(text, "?").cast("long").alias("question_mark_count"),
        occurrences(text, "!").cast("long").alias("exclamation_count"),
        occurrences(text, ".").cast("long").alias("period_count"),
        ((first != "") & (F.upper(first) == first) & (F.lower(first) != first)).alias("starts_with_capital"),
        F.endswith(text, F.lit("?")).alias("ends_with_question"),
        F.endswith(text, F.lit(".")).alias("ends_with_period"),
        F.endswith(text, F.lit("!")).alias("ends_with_exclamation"),
        contains_any(low, QUESTION_WORDS).alias("has_question_words"),
        contains_any(low, MODAL_VERBS).alias("has_modal_verbs"),
        contains_any(low, IMPERATIVES).alias("has_imperative_words"),
    )


def _points(*scored: tuple[Column, float]) -> Column:
    """Sum of the points whose condition holds, 1 at most; in tenths, so that it is exact."""
    total = F.lit(0)
    for condition, points in scored:
        total = total + F.when(condition, round(points * 10)).otherwise(0)
    return F.least(total, F.lit(10)) / F.lit(10)


def question_score(text: Column) -> Column:
    """How much a segment looks like a question, 0 to 1."""
    f = features(text)
    return _points((f["ends_with_question"], 0.8), (f["has_question_words"], 0.3), (f["has_modal_verbs"], 0.2), (f["has_imperative_words"], 0.2), (f["word_count"] < 20, 0.1))


def answer_score(text: Column) -> Column:
    """How much a segment looks like an answer, 0 to 1."""
    f, low = features(text), F.lower(strip(text))
    starts = F.lit(False)
    for start in ANSWER_STARTS:
        starts = starts | F.startswith(low, F.lit(start))
    return _points((f["ends_with_period"], 0.4), (starts, 0.4), (contains_any(low, ANSWER_PHRASES), 0.2), (f["word_count"] > 15, 0.2), (f["period_count"] > 1, 0.1))


def pattern_score(text: Column, patterns) -> Column:
    """A fifth for each pattern that the stripped lower-case text has, 1 at most."""
    low = F.lower(strip(text))
    total = F.lit(0)
    for pattern in patterns:
        total = total + F.rlike(low, F.lit(pattern)).cast("int")
    return F.least(total * 2, F.lit(10)) / F.lit(10)


def input_problem(text: Column, min_chars: int = 10) -> Column:
    """Why a text can't be formatted; empty if it can."""
    bare = strip(text)
    return F.when(bare == "", "Input text is empty").when(F.length(bare) < min_chars, f"Input text is too short (minimum {min_chars} characters)").when(~F.rlike(bare, F.lit("[a-zA-Z]")), "Input text contains no alphabetic characters").otherwise("")
