"""Detectors of adversarial text beyond the sanitiser's, and the threat score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.normalise import normal_form
from quernstone.functions.sanitise import code_points, histogram
from quernstone.functions.text import let, safe

# Look-alikes of Latin letters, and patterns of odd text.
LOOK_ALIKES = {
    "a": "аαɑａ",
    "e": "еεｅ",
    "o": "оοｏ",
    "p": "рρｐ",
    "c": "сϲｃ",
    "x": "хχｘ",
    "y": "уγｙ",
    "i": "іιｉ",
    "n": "пηｎ",
    "m": "мμｍ",
    "h": "һηｈ",
    "k": "кκｋ",
    "b": "вβｂ",
    "t": "тτｔ",
    "r": "гρｒ",
    "s": "ѕσｓ",
}
SUSPICIOUS = {
    "char_run": r"(.)\1{10,}",
    "word_run": r"\b(\w+)\s+\1\s+\1\b",
    "non_ascii_run": r"[^\x00-\x7F]{20,}",
    "punctuation_run": r"[\x{2000}-\x{206F}]{3,}",
    "dingbat_run": r"[\x{2700}-\x{27BF}]{5,}",
    "emoji_run": r"[\x{1F600}-\x{1F64F}]{10,}",
    "capital_run": r"[A-Z]{50,}",
    "digit_run": r"\d{100,}",
    "symbol_run": r"[!@#$%^&*()]{20,}",
    "pattern_run": r"(.{1,3})\1{20,}",
}
ADVERSARIAL = {
    "leetspeak": r"\b[a-z]*[0-9]+[a-z]*[0-9]+[a-z]*\b",
    "zalgo_text": r"[\x{0300}-\x{036F}]{3,}",
    "fullwidth": r"[\x{FF00}-\x{FFEF}]{5,}",
    "enclosed": r"[\x{2460}-\x{24FF}]{3,}",
    "mathematical": r"[\x{1D400}-\x{1D7FF}]{5,}",
    "variation_selectors": r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]",
}
MIXED = {
    "mixed_scripts": r"[\x{0400}-\x{04FF}].*[a-zA-Z]|[a-zA-Z].*[\x{0400}-\x{04FF}]",
    "arabic_latin": r"[\x{0600}-\x{06FF}].*[a-zA-Z]|[a-zA-Z].*[\x{0600}-\x{06FF}]",
    "chinese_latin": r"[\x{4E00}-\x{9FFF}].*[a-zA-Z]|[a-zA-Z].*[\x{4E00}-\x{9FFF}]",
    "excessive_diacritics": r"[\x{E0}-\x{F6}\x{F8}-\x{FD}\x{FE}\x{FF}]{10,}",
}
ZERO_WIDTH = ("\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")
WINDOW = 50


def _named(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.rlike(safe(text), F.lit(p)), F.lit(n)) for n, p in patterns.items())))


def look_alikes(text: Column) -> Column:
    """Struct count, ratio and severity of look-alikes; a letter that resembles two Latin
    ones counts twice."""
    n = sum(F.regexp_count(safe(text), F.lit(f"[{chars}]")) for chars in LOOK_ALIKES.values())
    size = F.length(safe(text))
    return F.struct(n.alias("count"), F.when(size > 0, n / size).otherwise(0.0).alias("ratio"), F.when(n > size * 0.1, "high").when(n > 0, "medium").alias("severity"))


def script_mixing(text: Column) -> Column:
    """Names of suspicious mixtures; none for a text of one script."""
    text = safe(text)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    share = lambda script: F.regexp_count(text, F.lit(rf"[\p{{L}}&&\p{{Is{script}}}]")) / letters
    scripts = sum(F.rlike(text, F.lit(rf"[\p{{L}}&&\p{{Is{s}}}]")).cast("int") for s in ("Latin", "Cyrillic", "Greek", "Arabic", "Han", "Hebrew", "Hiragana", "Katakana", "Hangul", "Thai", "Devanagari"))
    both = F.when((letters > 0) & (share("Latin") > 0.1) & (share("Cyrillic") > 0.1), F.array(F.lit("latin_cyrillic"))).otherwise(F.array().cast("array<string>"))
    return F.when(scripts > 1, F.concat(both, _named(text, MIXED))).otherwise(F.array().cast("array<string>"))


def character_stats(text: Column) -> Column:
    """Struct of the distinct characters' frequencies: mean, median, sample deviation,
    outliers (over a fifth of the text) and whether they are suspiciously even."""
    return let(F.sort_array(histogram(text)), lambda counts: let(F.aggregate(counts, F.lit(0), lambda a, c: a + c), lambda size: _character_stats(counts, size)))


def _character_stats(counts: Column, size: Column) -> Column:
    n = F.size(counts)
    mean = F.try_divide(size, n)
    middle = (F.get(counts, F.floor((n - 1) / 2).cast("int")) + F.get(counts, F.floor(n / 2).cast("int"))) / 2
    spread = F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
    variance = F.try_divide(F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c / size - 1 / n) * (c / size - 1 / n)), n)
    return F.struct(
        mean.alias("mean_frequency"),
        middle.alias("median_frequency"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).otherwise(0.0).alias("std_frequency"),
        F.size(F.filter(counts, lambda c: c / size > 0.2)).alias("outliers"),
        ((variance < 0.001) & (n > 10)).alias("uniform"),
    )


def adversarial_patterns(text: Column) -> Column:
    """Names of adversarial and suspicious patterns that a text has."""
    return F.concat(_named(text, ADVERSARIAL), _named(text, SUSPICIOUS))


def window_entropies(text: Column, width: int = WINDOW) -> Column:
    """Entropy of each window of width characters, half a window apart; none for a text
    that is shorter than one."""
    return _window_entropies(safe(text), F.lit(width))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _window_entropies(text: pa.Array, width: pa.Array) -> pa.Array:
    return pa.array([_entropies(code_points(x.as_py()), w.as_py()) for x, w in zip(text, width, strict=True)], pa.list_(pa.float64()))


def _entropies(codes: np.ndarray, width: int) -> np.ndarray:
    """By runs of equal characters in each sorted window; some windows at a time."""
    if len(codes) < width:
        return np.zeros(0)
    windows = np.lib.stride_tricks.sliding_window_view(codes, width)[:: width // 2]
    out = np.zeros(len(windows))
    for at in range(0, len(windows), 4096):
        some = np.sort(windows[at : at + 4096], axis=1)
        new = np.ones(some.shape, bool)
        new[:, 1:] = some[:, 1:] != some[:, :-1]
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, some.size))
        out[at : at + 4096] = np.bincount(starts // width, weights=-(counts / width) * np.log2(counts / width), minlength=len(some))
    return out


def entropy_windows(text: Column, width: int = WINDOW) -> Column:
    """Struct mean, min, max and variance of window_entropies, and three flags."""
    mean_of = lambda found: F.try_divide(F.aggregate(found, F.lit(0.0), lambda a, x: a + x), F.size(found))
    return let(window_entropies(text, width), lambda found: let(mean_of(found), lambda mean: _entropy_windows(found, mean)))


def _entropy_windows(found: Column, mean: Column) -> Column:
    n = F.size(found)
    variance = F.when(n > 1, F.aggregate(found, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)).otherwise(0.0)
    return F.struct(
        mean.alias("mean_entropy"),
        F.array_min(found).alias("min_entropy"),
        F.array_max(found).alias("max_entropy"),
        variance.alias("entropy_variance"),
        F.coalesce((n > 0) & (variance > 2), F.lit(False)).alias("high_variance"),
        F.coalesce(F.array_min(found) < 1, F.lit(False)).alias("very_low"),
        F.coalesce(F.array_max(found) > 6, F.lit(False)).alias("very_high"),
    )


def hidden_writing(text: Column, forms: bool = True) -> Column:
    """Signs of hidden messages: runs of blanks, zero-width characters, and, with forms,
    a composed form of another length than the decomposed one."""
    text = safe(text)
    found = [F.when(F.rlike(text, F.lit(r"[ \t]{2,}")), "unusual_whitespace"), F.when(F.rlike(text, F.lit(f"[{''.join(ZERO_WIDTH)}]")), "zero_width_chars")]
    if forms:
        found.append(F.when(F.length(normal_form(text, F.lit("NFC"))) != F.length(normal_form(text, F.lit("NFD"))), "normalization_differences"))
    return F.array_compact(F.array(*found))


def threat_score(text: Column, forms: bool = True) -> Column:
    """Points for all findings, 100 at most."""
    alike, windows = look_alikes(text), entropy_windows(text)
    points = (
        F.least(alike["ratio"] * 50, F.lit(20.0))
        + F.size(script_mixing(text)) * 10
        + F.coalesce(character_stats(text)["outliers"], F.lit(0)) * 5
        + F.size(adversarial_patterns(text)) * 15
        + windows["high_variance"].cast("int") * 10
        + windows["very_low"].cast("int") * 15
        + windows["very_high"].cast("int") * 10
        + F.size(hidden_writing(text, forms)) * 8
    )
    return F.least(points, F.lit(100.0))


def threat_rank(score: Column) -> Column:
    return F.when(score < 10, "low").when(score < 30, "medium").when(score < 60, "high").otherwise("critical")


def final_action(base: Column, score: Column, markup_issues: Column, aggressive: bool = False) -> Column:
    """reject over 80 or critical, quarantine over 50 or high; else risky markup warns (or
    quarantines, aggressively); else the sanitiser's action. score is null if the text
    was clean and no further analysis was made."""
    rank = threat_rank(score)
    return F.when((rank == "critical") | (score > 80), "reject").when((rank == "high") | (score > 50), "quarantine").when(markup_issues, "quarantine" if aggressive else "accept_with_warning").otherwise(base)
