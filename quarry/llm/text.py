"""Vectorised words and hashes over Arrow string columns.

A batch's texts lie in one UTF-8 buffer, so words of all rows are found and hashed
by a few numpy passes. Word classes here separate on ASCII bytes only, hence a
byte-level scan equals a code-point scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SEGMENT = 1 << 19
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_MUL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]

_ascii = np.arange(256)
#: ``[^\x20\x09-\x0D]+``
SPACED = ~((_ascii == 0x20) | ((_ascii >= 0x09) & (_ascii <= 0x0D)))
#: ASCII letters and digits and everything beyond ASCII
ALNUM = ((_ascii >= 48) & (_ascii <= 57)) | ((_ascii >= 65) & (_ascii <= 90)) | ((_ascii >= 97) & (_ascii <= 122)) | (_ascii >= 128)
#: runs of ASCII punctuation
PUNCT = ~ALNUM & (_ascii > 32) & (_ascii < 127)

_powers: list[np.ndarray] = []


def _pow() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for base in (_P, _PINV):
            out = np.full(_SEGMENT, base, dtype=np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers.append(np.cumprod(out))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty texts; offsets start at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    _, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each maximal run of bytes in ``table`` that stays inside a row."""
    inside = table[data]
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    cuts = offsets[1:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = cuts[cuts < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = cuts[cuts > 0] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def _long_hash(data: np.ndarray, values: np.ndarray) -> int:
    pw, _ = _pow()
    total, factor, step = 0, 1, pow(_P, _SEGMENT, 1 << 64)
    for i in range(0, len(data), _SEGMENT):
        part = values[data[i : i + _SEGMENT]]
        total += int((part * pw[: len(part)]).sum(dtype=np.uint64)) * factor
        factor = factor * step % (1 << 64)
    return total % (1 << 64)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each span's bytes (``fold``: A-Z count as a-z)."""
    values = _FOLDED if fold else _BYTE
    pw, inv = _pow()
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            base = int(start[i])
            j = int(np.searchsorted(end, base + _SEGMENT, "right"))
            if j <= i:
                out[i] = _long_hash(data[base : int(end[i])], values)
                i += 1
                continue
            size = int(end[j - 1]) - base
            sums = np.empty(size + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[data[base : base + size]] * pw[:size], out=sums[1:])
            s, e = start[i:j] - base, end[i:j] - base
            out[i:j] = (sums[e] - sums[s]) * inv[s]
            i = j
        return mix(out ^ ((end - start).astype(np.uint64) * _U(0xA24BAED4963EE407)))


def words(texts: pa.Array, table: np.ndarray = SPACED, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of every text, in order."""
    data, offsets = buffers(texts)
    row, start, end = spans(data, offsets, table)
    return row, hashes(data, start, end, fold)


def shingles(row: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's index, hash) of each run of k consecutive words of one row."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, _U(k) * _MUL[63])
        for j in range(k):
            h += word[j : n + j] * _MUL[j % 63] * _U(2 * (j // 63) + 1)
        h = mix(h)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, h[at]


def row_shingles(texts: pa.Array, k: int, table: np.ndarray = SPACED, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct k-word shingles, sorted by row then hash.

    A row with 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    row, word = words(texts, table, fold)
    at, h = shingles(row, word, k)
    rows = row[at]
    count = np.bincount(row, minlength=len(texts))
    for m in range(1, k):
        if (few := np.flatnonzero(count == m)).size:
            keep = np.isin(row, few)
            at, hm = shingles(row[keep], word[keep], m)
            rows, h = np.concatenate([rows, row[keep][at]]), np.concatenate([h, hm])
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[new], h[new]
