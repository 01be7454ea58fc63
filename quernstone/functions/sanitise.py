"""Sanitising of adversarial text, as column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.normalise import normal_form
from quernstone.functions.text import let, safe, words

# Characters and patterns that the sanitiser knows.
INVISIBLE = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u00ad", "\u034f", "\u061c", "\u180e")
DIRECTION = ("\u202a", "\u202b", "\u202c", "\u202d", "\u202e", "\u2066", "\u2067", "\u2068", "\u2069")
HOMOGLYPHS = {"\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0445": "x", "\u0443": "y", "\u03bf": "o", "\u03b1": "a"}
SUSPICIOUS_RANGES = r"[\x{1D400}-\x{1D7FF}\x{1F600}-\x{1F64F}\x{2700}-\x{27BF}\x{1F300}-\x{1F5FF}]"
MOJIBAKE = ("Ã¢â‚¬â„¢", "Ã¢â‚¬Â", "Ã©", "Ã¡", "â€™", "â€œ", "â€\x9d", "\ufffd")
LOW_ENTROPY, HIGH_ENTROPY = 2.0, 7.0
DANGEROUS = ("direction_override", "encoding_corruption")
SUSPICIOUS = ("invisible_chars", "homoglyphs", "token_pollution", "repeated_tokens")


def found_characters(text: Column, characters) -> Column:
    """Which of the characters occur, as U+XXXX, in their order."""
    return F.array_compact(F.array(*(F.when(F.contains(safe(text), F.lit(c)), F.lit(f"U+{ord(c):04X}")) for c in characters)))


def without_invisible(text: Column) -> Column:
    return F.translate(safe(text), "".join(INVISIBLE), "")


def latin_homoglyphs(text: Column) -> Column:
    """Cyrillic and Greek look-alikes as Latin letters."""
    return F.translate(safe(text), "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def histogram(text: Column) -> Column:
    """Counts of the distinct characters of a text, by code point. Spark could only search
    a text anew for each of them; here one pass does."""
    return _histogram(safe(text))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _histogram(text: pa.Array) -> pa.Array:
    return pa.array([np.unique(code_points(x.as_py()), return_counts=True)[1].astype(np.int32) for x in text], pa.list_(pa.int32()))


def code_points(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    # most texts fit in 16 bits, which sort faster
    return codes.astype(np.uint16) if len(codes) and int(codes.max()) < 1 << 16 else codes


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""

    return F.when(safe(text) != "", let(histogram(text), _bits)).otherwise(0.0)


def _bits(counts: Column) -> Column:
    return let(F.aggregate(counts, F.lit(0), lambda a, c: a + c), lambda n: F.aggregate(counts, F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n)))


def non_ascii_ratio(text: Column) -> Column:
    text = safe(text)
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"[^\x00-\x7F]")) / F.length(text)).otherwise(0.0)


def top_char_share(text: Column) -> Column:
    """Share of the most frequent character."""
    n = F.length(safe(text))
    return F.when(n > 0, F.array_max(histogram(text)) / n).otherwise(0.0)


def pollution(text: Column, top_share: Column | None = None) -> Column:
    """Which kinds of token pollution a text has: high_non_ascii_ratio,
    excessive_repetition, suspicious_unicode."""
    top_share = top_char_share(text) if top_share is None else top_share
    return F.array_compact(
        F.array(
            F.when(non_ascii_ratio(text) > 0.5, "high_non_ascii_ratio"),
            F.when(top_share > 0.3, "excessive_repetition"),
            F.when(F.rlike(safe(text), F.lit(SUSPICIOUS_RANGES)), "suspicious_unicode"),
        )
    )


def repeated_tokens(text: Column) -> Column:
    """Structs (token, count) of words, in lower case, that are over a fifth of a text of
    three words or more and occur over three times; by word. At most four words can."""

    def found(all_words):
        n = F.size(all_words)
        # in sorted order, a word with a share over a fifth stands at one of these places
        places = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.least(n - 1, F.floor(n * k / 5).cast("int")))
        candidates = F.when(n >= 3, F.array_distinct(F.transform(places, lambda p: F.get(all_words, p)))).otherwise(F.array().cast("array<string>"))
        counted = F.transform(candidates, lambda w: F.struct(w.alias("token"), F.size(F.filter(all_words, lambda x: x == w)).alias("count")))
        return F.sort_array(F.filter(counted, lambda s: (s["count"] > n * 0.2) & (s["count"] > 3)))

    return let(F.sort_array(words(F.lower(safe(text)))), found)


def encoding_issues(text: Column) -> Column:
    """Signs of wrongly decoded text that occur, in their order."""
    return F.array_compact(F.array(*(F.when(F.contains(safe(text), F.lit(p)), F.lit(p)) for p in MOJIBAKE)))


def threats(raw: Column, clean: Column) -> Column:
    """Names of the threats in a text, from the text before and after cleaning. Both texts
    and the counts of characters are computed once."""
    return let(_counted(raw, clean), lambda b: _threats(b["raw"], b["clean"], b["counts"]))


def _counted(raw: Column, clean: Column) -> Column:
    return F.struct(raw.alias("raw"), clean.alias("clean"), histogram(clean).alias("counts"))


def _threats(raw: Column, clean: Column, counts: Column) -> Column:
    bits = F.when(clean != "", _bits(counts)).otherwise(0.0)
    top_share = F.when(clean != "", F.array_max(counts) / F.length(clean)).otherwise(0.0)
    disorder = let(bits, lambda b: F.when(b < LOW_ENTROPY, "low_entropy").when(b > HIGH_ENTROPY, "high_entropy"))
    return F.array_compact(
        F.array(
            F.when(F.size(found_characters(raw, INVISIBLE)) > 0, "invisible_chars"),
            F.when(F.size(found_characters(raw, DIRECTION)) > 0, "direction_override"),
            F.when(F.size(found_characters(raw, HOMOGLYPHS)) > 0, "homoglyphs"),
            disorder,
            F.when(F.size(pollution(clean, top_share)) > 0, "token_pollution"),
            F.when(F.size(repeated_tokens(clean)) > 0, "repeated_tokens"),
            F.when(F.size(encoding_issues(clean)) > 0, "encoding_corruption"),
        )
    )


def threat_level(found: Column, aggressive: bool = False) -> Column:
    """clean, suspicious or dangerous. Aggressively, what is suspicious is dangerous, but
    for findings of entropy alone."""
    dangerous = F.arrays_overlap(found, F.array(*map(F.lit, DANGEROUS + SUSPICIOUS * aggressive)))
    return F.when(F.size(found) == 0, "clean").when(dangerous, "dangerous").otherwise("suspicious")


def action(level: Column, aggressive: bool = False) -> Column:
    """accept, accept_with_warning (quarantine if aggressive) or reject."""
    return F.when(level == "clean", "accept").when(level == "suspicious", "quarantine" if aggressive else "accept_with_warning").otherwise("reject")


def sanitise(text: Column, aggressive: bool = False, form: str | None = "NFKC") -> Column:
    """Struct of sanitised text (null if it is rejected or quarantined), threats, level and
    action."""
    raw = normal_form(safe(text), F.lit(form)) if form else safe(text)
    clean = latin_homoglyphs(without_invisible(raw))

    def decide(b):
        level = threat_level(b["threats"], aggressive)
        done = action(level, aggressive)
        return F.struct(F.when(done.isin("accept", "accept_with_warning"), b["clean"]).alias("sanitised_text"), b["threats"].alias("threats"), level.alias("threat_level"), done.alias("action"))

    found = lambda b: F.struct(b["clean"].alias("clean"), _threats(b["raw"], b["clean"], b["counts"]).alias("threats"))
    return let(let(_counted(raw, clean), found), decide)
