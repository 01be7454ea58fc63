"""Byte-level BPE encoding and decoding as a reduction over a monoid.

An element is a text with its tokens; joining two elements gives the tokens of the two
texts put together. A text is halved down to leaves, leaves are encoded on their own,
and neighbours are joined up the tree. A join encodes anew only a window around the
boundary, which grows until the tokens outside provably stay:

* Between a character that is no white space and a single space before one that is none
  either, the splitting pattern always ends a match, whatever stands on either side. So
  a window that ends at such places (or at the text's ends) changes nothing beyond them.
* Inside one very long match, the byte pairs' own merges are joined likewise: a sequence
  of tokens is the encoding if each adjacent pair is the encoding of its own bytes, so
  a window is wide enough once the pairs at its two edges are.

Decoding concatenates the tokens' bytes up the same kind of tree.

One match is encoded by the library's ``_encode_single_piece``, which is no part of its
public interface; it is there in tiktoken 0.4 to 0.12.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.work import slices

#: Characters of a leaf; longest match that is encoded in one go; first window in characters.
LEAF, PIECE, WINDOW = 2048, 4096, 32

_SAFE = re.compile(r"(?<=\S)(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """The operations of the monoid for one vocabulary of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece: int = PIECE):
        self.ranks, self.leaf, self.piece = ranks, leaf, piece
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the library's white space is the Unicode property, which regex's own \\s is not quite
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of = {v: k for k, v in ranks.items()}

    # one match of the pattern

    def piece_ids(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern, however long."""
        if len(data) <= self.piece:
            return [self.ranks[data]] if data in self.ranks else self.core._encode_single_piece(data)
        half = len(data) // 2
        return self.join_pieces(self.piece_ids(data[:half]), self.piece_ids(data[half:]))

    def _pair_stays(self, a: int, b: int) -> bool:
        return self.core._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of two parts of one match put together."""
        i, j = min(8, len(left)), min(8, len(right))
        while True:
            window = b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j]))
            new = self.core._encode_single_piece(window)
            left_stays = i == len(left) or self._pair_stays(left[-i - 1], new[0])
            right_stays = j == len(right) or self._pair_stays(new[-1], right[j])
            if left_stays and right_stays:
                return left[: len(left) - i] + new + right[j:]
            i, j = (i if left_stays else min(2 * i, len(left))), (j if right_stays else min(2 * j, len(right)))

    # texts

    def leaf_ids(self, text: str) -> list[int]:
        """Ids of a text that is encoded match by match."""
        if len(text) <= self.piece:
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for match in self.split.finditer(text):
            out += self.piece_ids(match.group().encode())
        return out

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text."""
        spans = [(at, min(at + self.leaf, len(text))) for at in range(0, len(text), self.leaf)]
        parts = [(a, b, self.leaf_ids(text[a:b])) for a, b in spans]
        while len(parts) > 1:
            joined = [self.join(text, parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = joined + parts[2 * len(joined) :]
        return parts[0][2] if parts else []

    def join(self, text: str, left: tuple[int, int, list[int]], right: tuple[int, int, list[int]]) -> tuple[int, int, list[int]]:
        """Two neighbouring stretches of one text, each (start, end, ids), as one."""
        (start, middle, a), (_, end, b) = left, right
        low, high = self.stable_before(text, start, middle), self.stable_after(text, middle, end)
        kept_left = self._drop(a, len(text[low:middle].encode()), last=True)
        kept_right = self._drop(b, len(text[middle:high].encode()), last=False)
        return start, end, kept_left + self.leaf_ids(text[low:high]) + kept_right

    @staticmethod
    def stable_before(text: str, start: int, middle: int) -> int:
        """The last place in [start, middle) where any encoding of the text has a boundary."""
        width = WINDOW
        while middle - width > start:
            places = [m.start() for m in _SAFE.finditer(text, middle - width, middle)]
            if places and places[-1] < middle - 1:
                return places[-1]
            width *= 2
        places = [m.start() for m in _SAFE.finditer(text, start, middle)]
        return places[-1] if places and places[-1] < middle - 1 else start

    @staticmethod
    def stable_after(text: str, middle: int, end: int) -> int:
        """The first such place in (middle, end]."""
        found = _SAFE.search(text, middle, end)
        while found and found.start() <= middle:
            found = _SAFE.search(text, found.start() + 1, end)
        return found.start() if found else end

    def _drop(self, ids: list[int], size: int, last: bool) -> list[int]:
        """ids without the last or first ones, which hold size bytes."""
        n = 0
        for token in reversed(ids) if last else ids:
            if not size:
                break
            size -= len(self.bytes_of[token])
            n += 1
        if size:
            raise AssertionError("a boundary that is stable lies inside a token")
        return ids[: len(ids) - n] if last else ids[n:]

    def decoded(self, ids: list[int]) -> bytes:
        """The bytes of ids, joined up a tree."""
        parts = [self.core.decode_bytes(ids[at : at + self.leaf]) for at in range(0, len(ids), self.leaf)]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0] if parts else b""


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(read_ranks(path), pattern)


def encode_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids, of each row.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes
    that they decode to. Null texts are empty and have no ids; both digests are then of
    nothing. Repeated rows give repeated rows; null ids of documents stay null; other
    columns take no part. No text is too long: memory is a few times that of the text.
    """

    def encode(batches):
        own = encoder(path, pattern)
        for batch in batches:
            for rows in slices(batch, 1):
                ids, plain = [], []
                for text in rows.column(1).to_pylist():
                    ids.append(own.ids(text or ""))
                    plain.append(hashlib.sha256(own.decoded(ids[-1])).hexdigest())
                digests = [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids]
                columns = [rows.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(plain, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, schema)


def decode_table(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and data, the bytes that a row's ids decode to; null ids give no bytes."""

    def decode(batches):
        own = encoder(path, pattern)
        for batch in batches:
            data = [own.decoded(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decode, "doc_id long, data binary")
