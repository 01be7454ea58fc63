"""Hashes of a text's words."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII blanks, in lower case; none for null."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
