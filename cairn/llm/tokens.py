"""Byte-level word splitting shared by the text operators (small helpers, used inside tasks)."""

from __future__ import annotations

import numpy as np


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at exactly these six bytes."""
    return text.encode().split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same after lower-casing A-Z only (what bytes.lower() does)."""
    return text.encode().lower().split() if text else []


def word_ids(words: list[bytes]) -> np.ndarray:
    """Number words by first appearance: equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def window_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Number windows of ``width`` words so that equal windows have equal numbers, exactly.

    Windows are named by doubling: a name of 2k words is the pair of two names of k words.
    ``width`` may be any number; the last step joins two overlapping names.
    """
    size, names = 1, ids
    while size < width:
        step = min(size, width - size)
        if len(names) <= step:
            return names[:0]
        pair = names[:-step] * (int(names.max()) + 1) + names[step:]
        names, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size + step
    return names


def joined(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Words joined by one space, and where each starts; one more entry ends the last."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)), out=starts[1:])
    return b" ".join(words), starts
