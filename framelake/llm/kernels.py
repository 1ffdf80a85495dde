"""Numpy kernels over the UTF-8 bytes of many texts at once.

Texts lie one after another in one byte array; ``offsets`` has the n + 1 borders. Words are runs of
bytes outside space and 0x09-0x0D, which in UTF-8 is the same as runs of such code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed odd multipliers of the hashes (64-bit mixing constants).
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes whose words are hashed at once, so that what comes in between stays in the cache; powers kept for later calls.
BLOCK, KEPT = 256 << 10, 512 << 10
_POWERS: dict[int, np.ndarray] = {}


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a string or binary array; null counts as empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, borders, data = array.buffers()
    offsets = np.frombuffer(borders, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def mix_own(x: np.ndarray) -> None:
    """As ``mix``, in place."""
    for shift, factor in ((30, M2), (27, M3), (31, None)):
        x ^= x >> np.uint64(shift)
        if factor is not None:
            x *= factor


def powers(n: int, base: np.uint64) -> np.ndarray:
    kept = _POWERS.get(int(base))
    if n <= KEPT and kept is not None:
        return kept[:n]
    out = np.full(max(n, KEPT), base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if kept is None:
        _POWERS[int(base)] = out[:KEPT].copy()
        _POWERS[int(base)].flags.writeable = False
    return out[:n]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def prefix_hash(data: np.ndarray, base: np.uint64 = BASE, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the inverse powers that shift a span to its start."""
    code = (BYTE_CODE if not salt else mix(BYTE_CODE + np.uint64(salt))).take(data)
    code *= powers(len(data), base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code, out=sums[1:])
    return sums, powers(len(data) + 1, np.uint64(pow(int(base), -1, 2**64)))


def span_hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end), the same wherever they stand."""
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * M1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the borders of each text in the list of words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    starts_here = inside[1:-1] & ~inside[:-2]
    ends_here = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts_here[cut] |= inside[1:-1][cut]
    ends_here[cut - 1] |= inside[1:-1][cut - 1]
    start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z lowered, and the borders of each text."""
    hashes, border = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in blocks(offsets):
        low = LOWER.take(data[offsets[a] : offsets[b]])
        start, end, own = words(low, offsets[a : b + 1] - offsets[a])
        hashes.append(span_hash(*prefix_hash(low), start, end))
        border.append(own[1:] + border[-1][-1])
    return np.concatenate(hashes), np.concatenate(border)


def shingles(hashes: np.ndarray, border: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words, or of the whole text where it has fewer words.

    Returns hashes and the index of their text; a text without words has none.
    """
    count = np.diff(border)
    n = len(hashes)
    long_start = np.maximum(n - size + 1, 0)
    run = np.zeros(long_start, np.uint64)
    for k in range(size):
        run = mix(run * BASE + hashes[k : k + long_start])
    doc_of_word = np.repeat(np.arange(len(count)), count)
    end_of_doc = border[1:][doc_of_word[:long_start]]
    valid = np.arange(long_start) + size <= end_of_doc
    out, doc = run[valid], doc_of_word[:long_start][valid]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.full(len(short), M1, np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            at = np.minimum(border[short] + k, n - 1)
            extra = np.where(has, mix(extra * BASE + hashes[at] + np.uint64(k + 1)), extra)
        out, doc = np.concatenate([out, extra]), np.concatenate([doc, short])
    return out, doc


def distinct_sets(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and borders."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    if len(v):
        keep = np.ones(len(v), bool)
        keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(n_docs + 1))
