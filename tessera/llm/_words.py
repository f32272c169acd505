"""Words of many texts at once, as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import numpy as np

# Bytes that part words, besides white space.
MARKS = b".,;:!?\"'()"
#: Odd multipliers of the hash.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PARTS = np.zeros(256, bool)
_PARTS[np.frombuffer(b" \t\n\r\v\f" + MARKS, np.uint8)] = True
#: What keeps the first so many of eight bytes.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def joined(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The lower-case texts as UTF-8, each followed by a space, and where each ends."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    return b" ".join([*parts, b""]), np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)


def split(raw: bytes, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Of all words in order: hash, number of the text it stands in, then hashes of its first so many bytes, eight at most (0 where it is no longer).

    Words are runs of other bytes than white space and MARKS. They are hashed eight bytes at a time; only longer words go round again.
    """
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_PARTS[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, sizes = edge[::2], edge[1::2] - edge[::2]
    owner = np.searchsorted(ends, first, side="right")
    eights = np.ndarray((len(raw),), "<u8", raw + b"\0" * 8, strides=(1,))
    head = eights[first] & _FIRST[np.minimum(sizes, 8)]
    whole = _mixed((head + sizes.astype(np.uint64)) * _M1)
    on, at = np.flatnonzero(sizes > 8), 8
    while len(on):
        part = eights[first[on] + at] & _FIRST[np.minimum(sizes[on] - at, 8)]
        whole[on] = _mixed((whole[on] ^ part) * _M1 + _M2)
        at += 8
        on = on[sizes[on] > at]
    return (whole, owner, *(np.where(sizes > n, _mixed(((head & _FIRST[n]) + np.uint64(n)) * _M2), np.uint64(0)) for n in prefixes))


def hashed(texts: list[str | None], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """``split`` of the lower-case texts."""
    return split(*joined(texts), prefixes)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread what the low bits do not show."""
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def slices(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``limit`` code points together."""
    out, at, held = [], 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= limit:
            out.append((at, i + 1))
            at, held = i + 1, 0
    return out + ([(at, len(sizes))] if at < len(sizes) else [])
