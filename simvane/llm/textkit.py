"""Vectorised word, n-gram and window hashing over UTF-8 bytes.

A word is a maximal run of bytes outside ``0x20`` and ``0x09``-``0x0D``; those
bytes are ASCII, so splitting on bytes and splitting on code points agree. All
hashes are 64-bit, depend on the words alone (not on where they stand) and are
the same on every machine, so rows hashed by different tasks compare equal.
Where equality has to be certain to many more bits than 64, hash twice with two
seeds.

Work arrays are bounded: bytes are hashed in slices of ``SLICE`` cut between
words, so a very long text costs a few machine words for each of its *words*,
not for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 17
CHUNK = 1 << 18

_U = np.uint64
BREAK = np.zeros(256, bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0xD1342543DE82EF95 % 2**64))


@lru_cache(maxsize=8)
def _byte_tables(seed: int) -> tuple[np.ndarray, int, int]:
    table = stream(seed, 256)
    base = int(stream(seed + 1000, 1)[0]) | 5
    return table, base, pow(base, -1, 2**64)


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 2**64))
        done += step
    return out


def _power_table(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(12, (n - 1).bit_length()))[:n]


class Words(NamedTuple):
    """Words of several texts laid end to end; text d owns words first[d] to first[d + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def doc_end(self) -> np.ndarray:
        """For each word, the index after the last word of its text."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def starts_of(self, k: int) -> np.ndarray:
        """Whether k words of one text begin at each word."""
        return np.arange(len(self.hashes)) + k <= self.doc_end()


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of whole texts, about ``size`` bytes at a time; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    pos, n = 0, len(data)
    while pos < n:
        cut = min(n, pos + SLICE)
        while cut < n:
            edge = int(offsets[np.searchsorted(offsets, cut, "right") - 1])
            gaps = np.flatnonzero(BREAK[data[pos:cut]])
            best = max(edge, pos + int(gaps[-1]) + 1 if len(gaps) else 0)
            if best > pos:
                cut = best
                break
            cut = min(n, cut + SLICE)
        yield pos, cut
        pos = cut


def words_of(data: np.ndarray, offsets: np.ndarray, *, lower: bool = False, seed: int = 1, hashed: bool = True) -> Words:
    """Words of the texts data[offsets[d]:offsets[d + 1]] with their hashes."""
    table, base, inverse = _byte_tables(seed)
    if lower:
        table = table[LOWER]
    all_starts, all_ends, all_hashes = [], [], []
    inner = offsets[1:-1]
    for lo, hi in _slices(data, offsets):
        part = data[lo:hi]
        word = ~BREAK[part]
        edges = inner[np.searchsorted(inner, lo, "right") : np.searchsorted(inner, hi, "left")] - lo
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        before[edges] = False
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        after[edges - 1] = False
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        if hashed and len(starts):
            sums = np.empty(len(part) + 1, _U)
            sums[0] = 0
            np.cumsum(table[part] * _power_table(base, len(part)), out=sums[1:])
            h = (sums[ends] - sums[starts]) * _power_table(inverse, len(part))[starts]
            all_hashes.append(mix(h + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15)))
        all_starts.append(starts + lo)
        all_ends.append(ends + lo)
    starts = np.concatenate(all_starts) if all_starts else np.zeros(0, np.int64)
    ends = np.concatenate(all_ends) if all_ends else np.zeros(0, np.int64)
    hashes = np.concatenate(all_hashes) if all_hashes else np.zeros(0, _U)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets).astype(np.int64))


def runs_of(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of the k hashes that begin at each place, in about log2(k) passes; the last k - 1 places hold no run and get 0."""
    n = len(hashes)
    out = np.zeros(n, _U)
    if n < k:
        return out
    base = int(stream(seed + 2000, 1)[0]) | 5
    have, span = hashes, 1
    total, length = None, 0
    rest = k
    while rest:
        if rest & 1:
            if total is None:
                total, length = have, span
            else:  # run of `length` first, then `span` more
                m = n - length - span + 1
                total = total[:m] * _U(pow(base, span, 2**64)) + have[length : length + m]
                length += span
        rest >>= 1
        if rest:
            m = n - 2 * span + 1
            have = have[:m] * _U(pow(base, span, 2**64)) + have[span : span + m] if m > 0 else have[:0]
            span *= 2
    out[: n - k + 1] = mix(total[: n - k + 1] + _U(k))
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) < 2:
        return out
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
        at = np.searchsorted(twice, keys)
        at[at == len(twice)] = 0
        out = twice[at] == keys
    return out


def covered(flags_at: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n places lie in a window of k that begins at one of flags_at."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, flags_at, 1) if len(flags_at) < 32 else np.add(edge, np.bincount(flags_at, minlength=n + 1), out=edge, casting="unsafe")
    stop = np.bincount(np.minimum(flags_at + k, n), minlength=n + 1) if len(flags_at) else 0
    return np.cumsum(edge - stop)[:n] > 0


def long_array(x: np.ndarray) -> pa.Array:
    """64-bit values as an Arrow column of signed longs."""
    return pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64, copy=False))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of the bytes of each segment [start, end), any bytes included; starts and ends ascend."""
    table, base, inverse = _byte_tables(seed)
    n, total = len(data), 0
    at = [np.zeros(len(starts), _U), np.zeros(len(ends), _U)]
    for lo in range(0, max(n, 1), SLICE):
        part = data[lo : lo + SLICE]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(table[part] * _power_table(base, max(1, len(part)))[: len(part)], out=sums[1:])
        sums = sums * _U(pow(base, lo, 2**64)) + _U(total)
        hi = lo + len(part)
        for values, edges in zip(at, (starts, ends), strict=True):
            a, b = np.searchsorted(edges, lo, "left"), np.searchsorted(edges, hi, "right")
            values[a:b] = sums[edges[a:b] - lo]
        total = int(sums[-1])
    back = np.ones(len(starts), _U)
    if len(starts):
        low = _power_table(inverse, min(SLICE, max(1, n)) + 1)
        for lo in range(0, int(starts.max()) + 1, SLICE):
            a, b = np.searchsorted(starts, lo, "left"), np.searchsorted(starts, lo + SLICE, "left")
            back[a:b] = low[starts[a:b] - lo] * _U(pow(inverse, lo, 2**64))
    return mix((at[1] - at[0]) * back + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""(starts, ends, first) of the \n-split lines of each text, like str.split: a text has one line more than it has \n."""
    breaks = np.flatnonzero(data == 10)
    per_doc = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate(([0], np.cumsum(per_doc)))
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    return starts, ends, first
