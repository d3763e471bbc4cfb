"""Kinds of characters: what a model falls back on for a character that it never saw."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Kinds, with the start of a text as kind 0.
ALPHABET = 56
#: Code points there are.
POINTS = 0x110000


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane: letters a-z, one for their capitals, one for digits, marks by kind, others by remainder."""
    out = np.full(1 << 16, 35, dtype=np.int32)
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        out[c] = 1 + i
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b"'\"`"]
    for i, codes in enumerate(groups):
        out[list(codes)] = 27 + i
    for i, code in enumerate(b"-:;%$&*#|"):
        out[code] = 36 + i % 3 if code in b"-:;" else 39 + (i - 3) % 6
    out[128:] = 45 + np.arange(128, 1 << 16) % (ALPHABET - 45)
    return out


@lru_cache(maxsize=1)
def members() -> np.ndarray:
    """Number of code points of each kind."""
    beyond = 45 + np.arange(1 << 16, POINTS) % (ALPHABET - 45)
    return np.bincount(symbol_table(), minlength=ALPHABET) + np.bincount(beyond, minlength=ALPHABET)
