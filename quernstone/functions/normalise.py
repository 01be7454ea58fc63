"""Column functions that rewrite text: white space, artefacts, Unicode, sizes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions.text import let, safe, squeeze, strip


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, into in steps:
        text = F.regexp_replace(text, pattern, into)
    return text


def preprocess(text: Column) -> Column:
    """Blanks collapsed, soft line breaks undone but paragraphs kept, a blank after marks
    before a lower-case letter, "aB" parted as "a. B", and a leading number, bullet or
    quote mark of the text removed."""
    return _chain(
        strip(text),
        (r"[ \t\f\x0B\r]+", " "),
        (r" ?\n ?", "\n"),
        (r"\n{2,}", "\n\n"),
        (r"(?<!\n)\n(?!\n)", " "),
        (r"([.!?])\s*([a-z])", "$1 $2"),
        (r"([a-z])([A-Z])", "$1. $2"),
        (r"^\d+\.\s*", ""),
        (r"^[-*•]\s*", ""),
        (r"^>\s*", ""),
    )


def clean_extracted(text: Column) -> Column:
    """Extracted text on one line: no control characters, plain quotes, no links or e-mail
    addresses."""
    bare = _chain(squeeze(text), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    bare = F.translate(bare, "\u201c\u201d\u2018\u2019", "\"\"''")
    return squeeze(_chain(bare, (r"https?://\S+", ""), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "")))


def repair_broken_words(text: Column) -> Column:
    """Joins letters that stand alone to the word after them ("h elp"), then to the word
    before. It is meant for text that was found to be garbled: real one-letter words go too."""
    return _chain(safe(text), (r"(?<!\w)([a-zA-Z])\s+([a-zA-Z]{2,})(?!\w)", "$1$2"), (r"(?<!\w)([a-zA-Z]{2,})\s+([a-zA-Z])(?!\w)", "$1$2"))


def tidy_content(text: Column) -> Column:
    """LF line ends, no blanks at line ends, blanks inside lines collapsed, two line ends
    at most in a row, no invisible characters, plain quotes and dashes."""
    unified = F.translate(_chain(safe(text), (r"\r\n?", "\n"), (r"[\u200b\u200c\u200d\ufeff\u00ad]", "")), "\u201c\u201d\u2018\u2019\u2013\u2014", "\"\"''--")
    return strip(_chain(unified, (r"[ \t]+(?=\n|$)", ""), (r"(?<=\S)[ \t]{2,}", " "), (r"\n{3,}", "\n\n")))


# Characters that fine-tuning text should not hold, and blanks to unify.
FINE_TUNE_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"
FINE_TUNE_BIDI = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
FINE_TUNE_SPACES = "\t\u000b\u000c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def fine_tune_clean(text: Column, max_line_ends: int = 2, form: str | None = "NFKC") -> Column:
    """Struct: text cleaned for fine-tuning, and how many control, invisible and other
    meaningless characters were removed.

    LF line ends; the given normal form; any blank character as a space; no invisible or
    direction characters; none without a meaning (private use of the first plane,
    non-characters, U+FFFD); no controls or unassigned characters but LF; blanks
    collapsed, lines stripped at their ends, runs of line ends limited.
    """
    unified = F.when(F.contains(safe(text), F.lit("\r")), _chain(safe(text), (r"\r\n?", "\n"))).otherwise(safe(text))
    if form:
        unified = normal_form(unified, F.lit(form))
    spaced = F.translate(unified, FINE_TUNE_SPACES, " " * len(FINE_TUNE_SPACES))
    planes = "".join(rf"\x{{{p:X}FFFE}}\x{{{p:X}FFFF}}" for p in range(1, 17))
    # none of these is printable ASCII, which is sorted out first as a class asks its parts one by one
    invisible, unmeant = f"[{FINE_TUNE_INVISIBLE}{FINE_TUNE_BIDI}]", rf"[\x{{FFFD}}\x{{FDD0}}-\x{{FDEF}}\x{{E000}}-\x{{F8FF}}\x{{FFFE}}\x{{FFFF}}{planes}]"
    control = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}]"
    odd = lambda *chars: (rf"[[^\x20-\x7E\n]&&[{''.join(chars)}]]", "")
    seen = _chain(spaced, odd(invisible))
    known = _chain(seen, odd(unmeant))
    plain = _chain(known, odd(control))
    # the text takes one pass where the counts take three
    whole = _chain(spaced, odd(invisible, unmeant, control))
    most = max(1, max_line_ends)
    collapsed = _chain(whole, (r"[^\S\n]{2,}|[^\S\n ]", " "))
    # line separators also end the last line
    trailing = lambda x: F.contains(x, F.lit(" \n")) | F.endswith(x, F.lit(" ")) | F.rlike(F.right(x, F.lit(3)), F.lit(r" [\u0085\u2028\u2029]$"))
    ended = let(collapsed, lambda x: F.when(trailing(x), _chain(x, (r" +(?=\n|$)", ""))).otherwise(x))
    out = strip(let(ended, lambda x: F.when(F.contains(x, F.lit("\n" * (most + 1))), _chain(x, (rf"\n{{{most + 1},}}", "\n" * most))).otherwise(x)))
    gone = lambda a, b: (F.length(a) - F.length(b)).cast("long")
    return F.struct(out.alias("text"), gone(known, plain).alias("removed_control_chars"), gone(spaced, seen).alias("removed_invisible_chars"), gone(seen, known).alias("removed_noncharacters"))


@F.pandas_udf(T.StringType())
def normal_form(text: pd.Series, form: pd.Series) -> pd.Series:
    """Unicode normal form NFC, NFD, NFKC or NFKD; Spark has no function for it."""
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form, strict=True)], dtype=object)


def fit_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters of at most limit bytes of UTF-8.

    The prefix in bytes, less a character that it cuts: the last lead byte is found from
    the bytes that follow it, in hexadecimal."""
    cut = F.hex(F.substring(F.encode(safe(text), "UTF-8"), 1, limit))
    whole = F.regexp_replace(cut, r"(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "")
    aligned = F.when(F.length(cut) % 2 == 0, F.when(_ends_inside(cut), whole).otherwise(cut))
    return F.when(F.octet_length(safe(text)) <= limit, safe(text)).otherwise(F.decode(F.unhex(aligned), "UTF-8"))


def _ends_inside(cut: Column) -> Column:
    """Does hexadecimal UTF-8 end in a lead byte with too few bytes after it?"""
    pairs = r"^(?:[0-9A-F]{2})*"
    return F.rlike(cut, F.lit(pairs + r"(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$"))


def clip_summary(text: Column, limit: int, marker: str = "\n\n[...]\n\n") -> Column:
    """A text over limit bytes as its head and tail: 55 and 35 per cent of half as many
    characters (200 at least), with a marker between, cut to the limit."""
    room = max(200, limit // 2)
    head, tail = int(room * 0.55), int(room * 0.35)
    short = F.concat(strip(F.substring(safe(text), 1, head)), F.lit(marker), strip(F.right(safe(text), F.lit(tail))))
    return F.when(F.octet_length(safe(text)) <= limit, safe(text)).otherwise(fit_bytes(short, limit))


def split_to_bytes(text: Column, limit: int) -> Column:
    """Parts of at most limit bytes, packed greedily by sentence, then by word; a word
    that is itself too long is cut."""
    return _split_to_bytes(safe(text), F.lit(limit))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_to_bytes(text: pd.Series, limit: pd.Series) -> pd.Series:
    import re

    def fit(piece: str, most: int) -> list[str]:
        out = []
        while piece:
            head = piece.encode()[:most].decode(errors="ignore") or piece[0]
            out.append(head)
            piece = piece[len(head) :]
        return out

    def pack(pieces: list[str], most: int, finer) -> list[str]:
        out, now = [], ""
        for piece in pieces:
            if len(piece.encode()) > most:
                out += ([now] if now else []) + finer(piece)
                now = ""
            elif not now or len(now.encode()) + 1 + len(piece.encode()) <= most:
                now = f"{now} {piece}" if now else piece
            else:
                out, now = [*out, now], piece
        return out + ([now] if now else [])

    def parts(value: str, most: int) -> list[str]:
        if len(value.encode()) <= most:
            return [value] if value else []
        return pack(re.split(r"(?<=[.!?])\s+", value.strip()), most, lambda s: pack(s.split(), most, lambda w: fit(w, most)))

    return pd.Series([parts(t, int(n)) for t, n in zip(text, limit, strict=True)])


def cap(text: Column, limit: int, strategy: str) -> Column:
    """An array of parts within limit bytes: split, truncate, summarize, or reject (none
    if the text is too long)."""
    text = safe(text)
    if strategy == "split":
        return split_to_bytes(text, limit)
    if strategy == "truncate":
        return F.array(fit_bytes(text, limit))
    if strategy == "summarize":
        return F.array(clip_summary(text, limit))
    if strategy == "reject":
        return F.when(F.octet_length(text) <= limit, F.array(text)).otherwise(F.array().cast("array<string>"))
    raise ValueError(f"unknown strategy {strategy!r}")


def size_in_bytes(amount: float | str, unit: str = "mb") -> int:
    """A size limit from a setting; 0 if it isn't a positive number; units not known are mb."""
    scale = {"bytes": 1, "kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30}.get(str(unit).lower(), 1 << 20)
    try:
        number = float(amount)
    except (TypeError, ValueError):
        return 0
    return int(number * scale) if number > 0 else 0
