"""Byte-level BPE pre-tokens, found with array operations instead of a regular-expression engine.

The pattern is the public one of the 50k byte-level vocabularies (public_tokenizers.PATTERN):
contractions, then letters, numbers or other symbols with at most one blank before them, then
white space that leaves its last character to what follows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, SPACE, BLANK, EDGE = range(6)
#: The characters of Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    for name, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = name
    out[WHITE_SPACE] = SPACE
    out[0x20] = BLANK
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where pre-tokens start, and for each document the number of its first one (len + 1 entries).

    data: the UTF-8 bytes of all documents; offsets: where each begins and ends.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    cls = classes()[cp]
    n = len(cp)
    begins = np.searchsorted(lead, offsets[:-1][offsets[1:] > offsets[:-1]])
    first = np.zeros(n + 3, bool)
    first[begins] = True
    first[n:] = True
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    before[begins] = EDGE
    after[np.r_[begins[1:], n] - 1] = EDGE
    white = cls >= SPACE
    start = (cls != before) & ~(white & ((before == SPACE) | (before == BLANK)))
    start &= white | (before != BLANK)
    start |= white & (after < SPACE)
    at = np.flatnonzero((cp == 0x27) & start & (after == LETTER))
    if len(at):
        one, two = cp[at + 1], np.where(first[at + 2], 0, cp[np.minimum(at + 2, n - 1)])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        end = (at + size)[~first[at + size]]
        start[end[cls[end] == LETTER]] = True
    places = lead[np.flatnonzero(start)]
    return places, np.searchsorted(places, offsets)


def as_array(data: np.ndarray, places: np.ndarray) -> pa.Array:
    """The pre-tokens as an Arrow binary column over the same bytes."""
    off = np.append(places, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
