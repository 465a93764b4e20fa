"""Words and their hashes, found for a whole batch of texts at once on the bytes of an Arrow array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Space and the controls from tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of no word of letters and digits; those of multi-byte characters count as letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and UNBASE to the powers 0..n-1, modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((BASE, UNBASE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the n + 1 offsets of its rows; null is empty."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes, a row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word: a run of bytes that aren't in gap, A-Z lower-cased, within a row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    inside = ~gap[data]
    edge = off[1:-1]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge[edge < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(off, start, side="right") - 1, start, end


def shingles(hashes: np.ndarray, row: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of k words; a row of fewer words has its whole sequence as one."""
    count = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])

    def joined(at: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(at), size, np.uint64)
        for i in range(size):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + i])
        return out

    ok = np.arange(len(hashes)) + k <= first[row + 1] if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(ok)
    parts, rows = [joined(at, k)], [row[at]]
    for size in range(1, k):
        short = np.flatnonzero(count == size)
        parts.append(joined(first[short], size))
        rows.append(short)
    hashes, row = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return hashes[order], row[order]
