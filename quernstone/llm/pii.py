"""Personal data by weak supervision.

Base spans are exact: four patterns with their own checks. Around them, wider candidate
patterns look for e-mail addresses, network addresses, card and phone numbers in other
writing. Six labelers (regular expressions, gazetteers, context) each vote yes, no or
nothing on every span, base ones included. Votes are counted in Spark by kind and
pattern, of which there are at most 5 * 3**6 for each bucket of features; expectation
maximisation on these counts estimates how reliable each labeler is for each kind, and
its posteriors train a logistic classifier of spans, which besides sees what labelers
don't: how a span is written, and the word before it. Candidates that it accepts are added
to the base spans; base spans always stay.

Keys and passwords, as in ``token = "..."``, are a fifth kind, found the same way; they
are no base spans, and are given in a column of their own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from quernstone.llm.work import Work, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
N_KINDS = 5
LABELERS = ("strict", "checksum", "gazetteer", "context", "boundary", "grouping")
#: A candidate joins the base spans from this probability on.
ACCEPT = 0.8
#: Characters around a span in which context labelers look.
NEAR = 40
YES, NO, NONE = 1, 0, 2
#: Buckets of a span's size, of the way that it is written, and of the word before it.
SIZES, SHAPES, WORDS = 5, 8, 16

# Words that speak for or against a kind, and well-known prefixes and endings.
FOR = {
    EMAIL: "email e-mail mail contact write reach correo courriel kontakt",
    IP: "ip address host server client gateway proxy addr login",
    CARD: "card visa mastercard amex credit debit payment tarjeta carte karte",
    PHONE: "phone tel telephone call mobile cell fax contact telefon telefono teléfono téléphone",
    SECRET: "export config env curl bearer authorization credential credentials login aws github",
}
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "api-key", "apikey", "access_key", "secret_key", "private_key", "auth_token", "access_token", "client_secret")
AGAINST = "order invoice version isbn issn serial ref reference sku part build revision token hash checksum id"
TLDS = frozenset("com org net edu gov int io co info biz de fr es uk us eu ch at nl be it pt pl ru cn jp in br ca au mx ar example test".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "23", "24", "25", "26", "27", "35")

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WIDE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:[(\[{] ?(?:at|AT) ?[)\]}]| (?:at|AT) ) ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{] ?(?:dot|DOT) ?[)\]}]| (?:dot|DOT) |\.) ?[A-Za-z0-9-]{1,63}){1,5}")
_WIDE_IP = re.compile(r"(?<![0-9.\[])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9])")
_WIDE_CARD = re.compile(r"(?<![0-9])[0-9]{3,4}(?:[.\x20_/-]{1,2}[0-9]{3,6}){2,4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])")
_WIDE_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_WORD = re.compile(r"[^\W\d_][\w-]*")
_SECRET = re.compile(r"(?i)(?<![A-Za-z0-9])(" + "|".join(sorted(SECRET_NAMES, key=len, reverse=True)) + r")[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}[\"']?([A-Za-z0-9+/_.=-]{12,512})")
_WIDE_AT = re.compile(r"[(\[{] ?(?:at|AT) ?[)\]}]| (?:at|AT) ")  # in every match of the wide e-mail pattern


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _octets(parts: list[str]) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts)


def base_emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern. Each @ can be in one match at most, which takes in
    all characters of the local part back to the match before; so a text's length, not
    its square, sets the time."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor:
            low = max(floor, start - 64)
            kept = len(text[low:start].rstrip(_LOCAL))
            start = low + kept
            if kept:
                break
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            out.append((start, found.end()))
            floor = found.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = [(a, EMAIL, b) for a, b in base_emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0]) if m.end() - m.start() <= 64 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
        if "+" in text:
            out += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, none of which overlaps a base span or another candidate."""
    found = []
    if _WIDE_AT.search(text):
        found += [(m.start(), EMAIL, m.end()) for m in _WIDE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in ((IP, _WIDE_IP), (CARD, _WIDE_CARD), (PHONE, _WIDE_PHONE)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if kind != CARD or 13 <= len(_digits(m[0])) <= 19]
    if "=" in text or ":" in text:
        found += [(m.start(2), SECRET, m.end(2)) for m in _SECRET.finditer(text)]
    taken, out = sorted((a, b) for a, _, b in base), []
    for start, kind, end in sorted(found):
        low = _first_ending_after(taken, start)
        if low >= len(taken) or taken[low][0] >= end:
            if not out or out[-1][2] <= start:
                out.append((start, kind, end))
    return out


def _first_ending_after(spans: list[tuple[int, int]], start: int) -> int:
    low, high = 0, len(spans)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if spans[middle][1] <= start else (low, middle)
    return low


def votes(text: str, start: int, kind: int, end: int, base: bool) -> list[int]:
    """One vote of each labeler on a span."""
    span, digits = text[start:end], _digits(text[start:end])
    if kind == EMAIL:
        domain = re.split(r"@|[(\[{] ?at ?[)\]}]| at ", span, maxsplit=1, flags=re.I)[-1]
        labels = [x for x in re.split(r"[^A-Za-z0-9-]+|\bdot\b", domain, flags=re.I) if x]
        checksum = YES if labels and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24 else NO
        gazetteer = YES if labels and labels[-1].lower() in TLDS else NO
        grouping = YES if re.search(r"[@(\[{]", span) else NO
    elif kind == IP:
        parts = re.findall(r"[0-9]+", span)
        checksum = YES if len(parts) == 4 and _octets(parts) else NO
        gazetteer = NO if parts[0] in ("0", "255") else NONE
        grouping = YES if all(x == "0" or x[0] != "0" for x in parts) else NO
    elif kind == CARD:
        checksum = YES if luhn(digits) else NO
        gazetteer = YES if digits.startswith(CARD_PREFIXES) else NO
        sizes = [len(x) for x in re.findall(r"[0-9]+", span)]
        grouping = NONE if len(sizes) == 1 else YES if sizes in ([4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3], [4, 6, 4]) else NO
    elif kind == SECRET:
        mixed = len(digits) >= 3 and any(c.isalpha() for c in span)
        checksum = YES if mixed and _entropy(span) >= 3.0 else NO
        gazetteer = YES if span.startswith(("AKIA", "ghp_", "sk-", "xox", "eyJ", "AIza")) else NONE
        grouping = YES if re.fullmatch(r"(?=.*[0-9])(?:[0-9a-f]{16,}|[0-9A-F]{16,}|(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{16,}={0,2})", span) else NO
    else:
        own = digits[2:] if digits.startswith("00") else digits
        checksum = YES if len(own) >= 10 and own[-10] not in "01" and own[-7] not in "01" else NO
        gazetteer = (YES if own.startswith(CALLING_CODES) else NO) if len(own) > 10 else NONE
        sizes = [len(x) for x in re.findall(r"[0-9]+", span)]
        grouping = NONE if len(sizes) == 1 else YES if sizes[-2:] == [3, 4] else NO
    words = {x.lower() for x in _WORD.findall(text[max(0, start - NEAR) : start]) + _WORD.findall(text[end : end + NEAR // 2])}
    context = YES if words & _FOR[kind] else NO if words & _AGAINST and kind != SECRET else NONE
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    boundary = NO if any(c.isalnum() for c in around) else YES
    if kind == SECRET:  # its pattern wants a name before it
        return [NONE, checksum, gazetteer, context, boundary, grouping]
    return [YES if base else NO, checksum, gazetteer, context, boundary, grouping]


_FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
_AGAINST = frozenset(AGAINST.split())


def _entropy(text: str) -> float:
    """Bits for each character."""
    n = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)[1] / max(1, len(text))
    return float(-(n * np.log2(n)).sum())


def size_bucket(kind: int, text: str) -> int:
    """A coarse size: digits of numbers, characters of addresses and keys; 0 to 4."""
    size = len(text) // 8 if kind in (EMAIL, SECRET) else max(0, len(_digits(text)) - 9) // 3
    return min(SIZES - 1, size)


def shape_bucket(text: str) -> int:
    """How a span is written: a run of letters, of digits or of both as one sign, others as
    they are."""
    sign = lambda m: "a" if m[0].isalpha() else "9" if m[0].isdigit() else "x"
    return xxh32_intdigest(re.sub(r"[A-Za-z0-9]+", sign, text)[:64].encode("utf-8", "replace")) % SHAPES


def word_bucket(text: str, start: int) -> int:
    """The word before a span; 0 if there is none near."""
    found = _WORD.findall(text[max(0, start - NEAR) : start])
    return 1 + xxh32_intdigest(found[-1].lower().encode("utf-8", "replace")) % (WORDS - 1) if found else 0


# Learning, on counts of (kind, votes, size, shape, word) that Spark has gathered


def expectation_maximisation(votes_of: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Probability that spans with each row of votes are true, and how often each labeler is
    right when it votes, for one kind.

    A labeler is as often right about true spans as about others, and no worse than chance;
    with reliabilities of their own for either, two ways of writing could pass for true and
    false. Pseudo-counts say that labelers are right four times in five to begin with.
    """
    yes, no = (votes_of == YES).astype(float), (votes_of == NO).astype(float)
    right, share = np.full(votes_of.shape[1], 0.8), 0.5
    for _ in range(rounds):
        odds = np.log(share / (1 - share)) + (yes - no) @ np.log(right / (1 - right))
        truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        agreed = (counts * truth) @ yes + (counts * (1 - truth)) @ no
        right = np.clip((agreed + 4) / (counts @ (yes + no) + 5), 0.5, 0.999)
        share = (counts @ truth + 1) / (counts.sum() + 2)
    return truth, right


def span_features(kind: np.ndarray, votes_of: np.ndarray, size: np.ndarray, shape: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One-hot votes, sizes, shapes and words before, for each kind."""
    n, n_votes = len(kind), 3 * len(LABELERS)
    width = n_votes + SIZES + SHAPES + WORDS
    own = np.zeros((n, width))
    for k in range(len(LABELERS)):
        own[np.arange(n), 3 * k + votes_of[:, k]] = 1
    for at, column in ((n_votes, size), (n_votes + SIZES, shape), (n_votes + SIZES + SHAPES, word)):
        own[np.arange(n), at + column] = 1
    out = np.zeros((n, N_KINDS * width))
    for k in range(N_KINDS):
        out[np.flatnonzero(kind == k), k * width : (k + 1) * width] = own[kind == k]
    return out


@dataclass
class SpanModel:
    weights: np.ndarray

    def chances(self, kind, votes_of, size, shape, word) -> np.ndarray:
        columns = (np.array(kind, int), np.array(votes_of, int).reshape(-1, len(LABELERS)), *(np.array(x, int) for x in (size, shape, word)))
        return 1 / (1 + np.exp(-np.clip(span_features(*columns) @ self.weights, -30, 30)))


def fit(kind: np.ndarray, votes_of: np.ndarray, size: np.ndarray, shape: np.ndarray, word: np.ndarray, counts: np.ndarray, rounds: int = 30) -> SpanModel:
    """EM for each kind, then a ridge-penalised logistic regression on its posteriors by
    Newton's method. Spans on which all labelers abstain teach the classifier nothing."""
    width = N_KINDS * (3 * len(LABELERS) + SIZES + SHAPES + WORDS)
    weights = np.zeros(width)
    if not len(kind):
        return SpanModel(weights - 1.0)
    truth = np.zeros(len(kind))
    for k in range(N_KINDS):
        own = kind == k
        if own.any():
            truth[own] = expectation_maximisation(votes_of[own], counts[own])[0]
    told = (votes_of != NONE).any(axis=1)
    features = span_features(kind, votes_of, size, shape, word)[told]
    truth, n = truth[told], (counts / counts.sum() * min(counts.sum(), 1e6))[told]
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        slope = features.T @ (n * (guess - truth)) + weights
        curve = (features * (n * guess * (1 - guess))[:, None]).T @ features + np.eye(width)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    return SpanModel(weights)


# Spark

SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,size:int,shape:int,word:int>"
SEEN = ("kind", "votes", "size", "shape", "word")


def joined(spans) -> str:
    """kind:start:end of (start, kind, end), sorted, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _find(batches):
    whole = [(x, pa.int32()) for x in ("kind", "start", "end")]
    kind = pa.struct([*whole, ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("size", pa.int32()), ("shape", pa.int32()), ("word", pa.int32())])
    for batch in batches:
        for part in slices(batch, 1):
            rows = []
            for text in part.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                own = [(*x, True) for x in base] + [(*x, False) for x in wide_spans(text, base)]
                rows.append([{"kind": k, "start": a, "end": b, "base": is_base, "votes": votes(text, a, k, b, is_base), "size": size_bucket(k, text[a:b]), "shape": shape_bucket(text[a:b]), "word": word_bucket(text, a)} for a, k, b, is_base in own])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])


def _decide(model: SpanModel, accept: float):
    names = (*KINDS, "secret")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))

    def decide(batches):
        for batch in batches:
            counts, digests, lists, secrets, added = [[] for _ in KINDS], [], [], [], []
            for spans in batch.column(1).to_pylist():
                base = [(s["start"], s["kind"], s["end"]) for s in spans if s["base"]]
                wide = [s for s in spans if not s["base"]]
                chances = model.chances(*([s[x] for s in wide] for x in SEEN)) if wide else []
                taken = [{"kind": names[s["kind"]], "start": s["start"], "end": s["end"], "chance": float(c)} for s, c in zip(wide, chances, strict=True) if c >= accept]
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lists.append(joined(base + [(x["start"], KINDS.index(x["kind"]), x["end"]) for x in taken if x["kind"] in KINDS]))
                secrets.append(",".join(f"secret:{x['start']}:{x['end']}" for x in taken if x["kind"] == "secret"))
                added.append(taken)
            found = [sum(x[k] for x in counts) + len(added[k]) for k in range(len(added))]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(secrets, pa.string()), pa.array(found, pa.int64()), pa.array(added, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "secrets", "n_found", "added"])

    return decide


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of
    the base spans; spans, base and added ones, as kind:start:end in code points, by
    start, then kind, comma-joined; secrets, keys and passwords likewise; n_found, how many
    there are of all; added, an array of structs (kind, start, end, chance).

    A null text is empty and has no span. Spans of one kind don't overlap; added ones
    overlap no other. Repeated rows give repeated rows; null ids stay null; other columns
    take no part; an empty table gives an empty result.
    """
    work = Work(docs.sparkSession, "pii")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = work.table(source.mapInArrow(_find, f"doc_id long, spans array<{SPAN}>"), "found")
    counted = found.select(F.explode("spans").alias("s")).groupBy(*(f"s.{x}" for x in SEEN)).count()
    # in one order, so that sums come out alike in each run
    seen = sorted(counted.toArrow().to_pylist(), key=lambda x: [x[k] for k in SEEN])
    columns = [np.array([x[k] for x in seen], int) for k in SEEN]
    columns[1] = columns[1].reshape(-1, len(LABELERS))
    model = fit(*columns, np.array([x["count"] for x in seen], float))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, secrets string, n_found long, added array<struct<kind:string,start:int,end:int,chance:double>>"
    return found.mapInArrow(_decide(model, accept), schema)
