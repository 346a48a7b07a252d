"""Vectorised text kernels over Arrow string arrays.

Every operator of this subpackage that works on words sees them the same way: ASCII letters are
lower-cased, words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``, and a word is named by a
64-bit hash of its bytes.  The work is done on the raw UTF-8 buffer of a whole Arrow batch, so no Python
code runs per row or per word.  Memory is bounded by ``SEGMENT`` bytes of text at a time however long a
document is; only the hashes of one document (8 bytes a word) are kept together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text hashed at a time.
SEGMENT = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for every place in a segment."""
    if not _powers:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                table = np.full(SEGMENT + 1, base, dtype=np.uint64)
                table[0] = 1
                _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of low[start:end] for each span; low has at most SEGMENT bytes."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables()
    with np.errstate(over="ignore"):
        sums = np.empty(len(low) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _word_spans(low: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of low; cuts: offsets that end a document and so a word."""
    if not len(low):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = ~WHITESPACE[low]
    before, after = np.empty(len(low), dtype=bool), np.empty(len(low), dtype=bool)
    before[0], before[1:] = True, ~text[:-1]
    after[-1], after[:-1] = True, ~text[1:]
    before[cuts[cuts < len(low)]] = True
    after[cuts[cuts > 0] - 1] = True
    return np.flatnonzero(text & before), np.flatnonzero(text & after) + 1


@dataclass
class Words:
    """Words of consecutive rows: row ``first + i`` has ``h[off[i]:off[i + 1]]``."""

    first: int
    off: np.ndarray
    h: np.ndarray
    #: Bytes of these rows, lower-cased, and the word spans in them.
    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.off))


def buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    _, off, data = arr.buffers()
    off = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1] if off is not None and len(arr) else np.zeros(len(arr) + 1, dtype=np.int64)
    return off, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


def iter_words(arr: pa.Array | pa.ChunkedArray, lower: bool = True, table: np.ndarray | None = None) -> Iterator[Words]:
    """The words of every row, in runs of rows of at most SEGMENT bytes; a longer row comes alone.

    table maps bytes before words are found, LOWER unless given."""
    table = LOWER if table is None else table
    off, data = buffers(arr)
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + SEGMENT, side="right")) - 1
        last = min(max(last, first + 1), n)
        raw = data[off[first] : off[last]]
        low = table[raw] if lower else raw
        if len(low) <= SEGMENT:
            cuts = off[first : last + 1] - off[first]
            starts, ends = _word_spans(low, cuts)
            yield Words(first, np.searchsorted(starts, cuts), _hash_spans(low, starts, ends), low, starts, ends)
        else:
            yield _long_row(first, low)
        first = last


def _long_row(first: int, low: np.ndarray) -> Words:
    """One row of more than SEGMENT bytes, hashed in segments that end between words."""
    starts, ends, hashes, at = [], [], [], 0
    while at < len(low):
        end = min(at + SEGMENT, len(low))
        if end < len(low) and not WHITESPACE[low[end]]:
            blank = np.flatnonzero(WHITESPACE[low[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:  # a single word longer than a segment
                while end < len(low) and not WHITESPACE[low[end]]:
                    ahead = np.flatnonzero(WHITESPACE[low[end : end + SEGMENT]])
                    end = end + int(ahead[0]) if len(ahead) else min(end + SEGMENT, len(low))
        part = low[at:end]
        if len(part) <= SEGMENT:
            s, e = _word_spans(part, np.array([0, len(part)]))
            hashes.append(_hash_spans(part, s, e))
        else:
            s, e = np.array([0]), np.array([len(part)])
            hashes.append(np.array([xxhash.xxh64_intdigest(part.tobytes())], dtype=np.uint64))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    h = np.concatenate(hashes)
    return Words(first, np.array([0, len(h)]), h, low, np.concatenate(starts), np.concatenate(ends))


def hash_words(words: list[str]) -> np.ndarray:
    """The hash of each given string, as iter_words gives it for a word (no lower-casing, no splitting)."""
    parts = [w.encode() for w in words]
    low = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    return _hash_spans(low, ends - np.array([len(p) for p in parts]), ends)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row and their offsets; a row of 1 to n - 1 words has one, the
    whole sequence, and a row without words none."""
    counts = np.diff(w.off)
    total = len(w.h)
    out = np.zeros(total, dtype=np.uint64)
    if not total:
        return out, w.off
    left = np.repeat(w.off[1:], counts) - np.arange(total)  # words from here to the row's end
    with np.errstate(over="ignore"):
        for j in range(min(n, total)):
            mult = np.uint64((0xA24BAED4963EE407 + 2 * j * 0x9FB21C651E98DF25) & _M64 | 1)
            part = mix(w.h[j:] + mult) * mult
            out[: total - j] += np.where(left[: total - j] > j, part, np.uint64(0))
        out = mix(out + np.minimum(left, n).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    keep = left >= n
    short = np.flatnonzero((counts > 0) & (counts < n))
    keep[w.off[short]] = True
    return out[keep], np.concatenate([[0], np.cumsum(np.where(counts >= n, counts - n + 1, np.minimum(counts, 1)))])


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each place, and a mask of the places that have n words in their row."""
    total = len(w.h)
    out = np.zeros(total, dtype=np.uint64)
    if not total:
        return out, np.zeros(0, dtype=bool)
    ok = np.repeat(w.off[1:], np.diff(w.off)) - np.arange(total) >= n
    with np.errstate(over="ignore"):
        for j in range(min(n, total)):
            mult = np.uint64((0xA24BAED4963EE407 + 2 * j * 0x9FB21C651E98DF25) & _M64 | 1)
            out[: total - j] += mix(w.h[j:] + mult) * mult
        return mix(out + np.uint64(n) * np.uint64(0xC2B2AE3D27D4EB4F)), ok


def spaced(w: Words, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """As windows(), of the words at the offsets from each place: hash, and whether the last of them is in the row."""
    total = len(w.h)
    out = np.zeros(total, dtype=np.uint64)
    if not total:
        return out, np.zeros(0, dtype=bool)
    ok = np.repeat(w.off[1:], np.diff(w.off)) - np.arange(total) > offsets[-1]
    with np.errstate(over="ignore"):
        for k, j in enumerate(offsets):
            mult = np.uint64((0xA24BAED4963EE407 + 2 * (7 * k + j) * 0x9FB21C651E98DF25) & _M64 | 1)
            out[: max(0, total - j)] += mix(w.h[j:] + mult) * mult
        return mix(out + np.uint64(sum(1 << j for j in offsets)) * np.uint64(0xD6E8FEB86659FD93)), ok
