"""64-bit hashes of words and shingles for many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * STEP
        x = (x ^ (x >> np.uint64(29))) * MULT
        return x ^ (x >> np.uint64(32))


#: One random number for each byte value; A-Z share those of a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MULT)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes whose running sums are taken at a time; a longer buffer goes chunk by chunk, so memory doesn't grow with a text.
CHUNK = 1 << 18
_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """STEP**k and its inverse for k up to CHUNK."""
    if not _POWERS:
        for base in (int(STEP), _inverse(int(STEP))):
            table = np.full(CHUNK + 1, np.uint64(base))
            table[0] = 1
            with np.errstate(over="ignore"):
                np.cumprod(table, out=table)
            _POWERS.append(table)
    return _POWERS[0], _POWERS[1]


def slices(texts: list, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` bytes; a longer text gets a range of its own."""
    a = total = 0
    for b, t in enumerate(texts):
        n = len(t or b"")
        if b > a and total + n > size:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(texts):
        yield a, len(texts)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a blank after each, and where each starts (with the end as last entry)."""
    starts = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])]).astype(np.int64)
    return np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]), np.uint8), starts


def _sums(buffer: np.ndarray, table: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of table[byte] * STEP**(place in the word) over each of the words [first, end), which don't overlap."""
    out = np.zeros(len(first), np.uint64)
    up, down = powers()
    for a in range(0, len(buffer), CHUNK):
        b = min(a + CHUNK, len(buffer))
        lo, hi = np.searchsorted(end, a, side="right"), np.searchsorted(first, b)
        if lo == hi:
            continue
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[buffer[a:b]] * up[: b - a], dtype=np.uint64)])
            start = np.maximum(first[lo:hi], a) - a
            part = (total[np.minimum(end[lo:hi], b) - a] - total[start]) * down[start]
            if first[lo] < a:  # begun in a chunk before
                part[0] *= np.uint64(pow(int(STEP), int(a - first[lo]), 1 << 64))
            out[lo:hi] += part
    return out


def word_hashes(buffer: np.ndarray, starts: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (a maximal run without ASCII white space) and the text that it is in."""
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        hashes = mix(_sums(buffer, _FOLDED if fold else _BYTE, first, end) + (end - first).astype(np.uint64) * MULT)
    return hashes, np.searchsorted(starts, first, side="right") - 1


def shingles(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words; a text with fewer words has its whole sequence as one."""
    count = np.bincount(doc, minlength=n_docs)
    with np.errstate(over="ignore"):
        value, end = hashes.copy(), len(hashes)
        for k in range(1, width):
            rest = max(0, end - k)
            same, nxt = np.zeros(end, bool), np.zeros(end, np.uint64)
            same[:rest] = doc[end - rest :] == doc[:rest]
            nxt[:rest] = hashes[end - rest :]
            value = np.where(same, mix(value * MULT ^ nxt), value)
    position = np.arange(end) - np.concatenate([[0], np.cumsum(count)[:-1]])[doc]
    keep = position < np.maximum(1, count - width + 1)[doc]
    return value[keep], doc[keep]
