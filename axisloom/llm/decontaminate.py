"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The seeds are the n-word windows of the benchmark items, and windows with gaps: all choices of n among n + 2 words in
a row that begin with the first.  An alignment without insertions that reaches the default score has three words
of five in common on average, so in some five words in a row three, whichever they are: edits that leave no run of words
whole are found as well.  One pass counts every seed over the whole
corpus.  A second pass looks the seeds up in every document, clusters the hits of an item by diagonal, and
aligns the words around a cluster with the item, the clusters with the rarest seeds first.  No seed is
dropped for its count: a cluster is left out only when the words it shares with the item can't reach the
score asked for, or that of an alignment already found.  An item of fewer than ``short_words`` words counts
only where all of it stands, word for word; one of fewer than n words is a seed as a whole.  Nothing is shuffled but seed counts; a document
is aligned in the task that read it.

The benchmark goes to the executors in blocks of at most ``block_words`` words (a few MB), so its size
is bounded whatever the benchmark holds; a larger benchmark takes more blocks, each with its own passes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K

MATCH, MISMATCH, GAP = 2, -1, 1


@dataclass(frozen=True)
class Rule:
    """Parameters of the search."""

    n: int = 3
    #: Words of a seed may be spread over so many more than n.
    spread: int = 2
    #: Items of fewer words are found only whole, word for word.
    short_words: int = 5
    #: Distinct seeds that a cluster must hold (one for items with fewer than 6 seeds).
    min_seeds: int = 2
    #: Alignment score over that of the whole item, from which a document counts as contaminated.
    min_score: float = 0.4
    block_words: int = 1_000_000


@dataclass
class Items:
    """A block of benchmark items and their seeds."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted distinct hashes
    start: np.ndarray  # seeds[i] is at places start[i]:start[i + 1] of item and place
    item: np.ndarray
    place: np.ndarray
    count: np.ndarray  # of each seed, over all documents
    sizes: tuple[int, ...] = ()  # of the items that are shorter than a window

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in seeds, -1 where it is none."""
        if not len(self.seeds):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        return np.where(self.seeds[at] == h, at, -1)


def _shapes(n: int, spread: int) -> list[tuple[int, ...]]:
    """The offsets of windows with gaps: n of n + spread words in a row, from the first."""
    return [(0, *rest) for rest in itertools.combinations(range(1, n + spread), n - 1) if rest != tuple(range(1, n))]


def _windows(w: K.Words, n: int, sizes: tuple[int, ...], spread: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, hash) of all windows of n words, of those of each smaller size that some item has, and of those with gaps."""
    out = []
    for h, ok in itertools.chain((K.windows(w, size) for size in (n, *sizes)), (K.spaced(w, shape) for shape in _shapes(n, spread))):
        at = np.flatnonzero(ok)
        out.append((at, h[at]))
    return out


def _items(ids: list, texts: list[str], n: int, spread: int) -> Items:
    kept, words, hashes, item, place = [], [], [], [], []
    for w in K.iter_words(pa.array(texts, pa.string())):
        by_size = {size: K.windows(w, size) for size in range(1, n + 1)}
        gapped = [K.spaced(w, shape) for shape in _shapes(n, spread)]
        for i in range(len(w)):
            lo, hi = w.off[i], w.off[i + 1]
            if hi == lo:
                continue
            for h, ok in (by_size[min(n, hi - lo)], *(gapped if hi - lo >= n else ())):
                at = np.flatnonzero(ok[lo:hi])
                hashes.append(h[lo:hi][at])
                item.append(np.full(len(at), len(kept)))
                place.append(at)
            kept.append(ids[w.first + i])
            words.append(w.h[lo:hi])
    flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    seeds, inverse = np.unique(flat, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    cat = lambda x: np.concatenate(x)[order].astype(np.int32) if x else np.zeros(0, dtype=np.int32)
    return Items(kept, words, seeds, np.searchsorted(inverse[order], np.arange(len(seeds) + 1)), cat(item), cat(place), np.zeros(len(seeds), dtype=np.int64), tuple(sorted({len(x) for x in words if len(x) < n})))


def _filter(seeds: np.ndarray) -> np.ndarray:
    """A bit for each 20-bit prefix that some seed has."""
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(seeds >> np.uint64(44)).astype(np.int64)] = True
    return bits


def _hits(items: Items, bits: np.ndarray, w: K.Words, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Places whose window is a seed, and the seed's index, in order of place."""
    places, seeds = [], []
    for at, h in _windows(w, rule.n, items.sizes, rule.spread):
        some = bits[(h >> np.uint64(44)).astype(np.int64)]
        at, found = at[some], items.lookup(h[some])
        places.append(at[found >= 0])
        seeds.append(found[found >= 0])
    at, seed = np.concatenate(places), np.concatenate(seeds)
    order = np.argsort(at, kind="stable")
    return at[order], seed[order]


def _counted(docs: DataFrame, text: str, items: Items, rule: Rule) -> Items:
    """items with the counts of their seeds over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((items, _filter(items.seeds)))

    def count(batches):
        own, bits = shared.value
        total = np.zeros(len(own.seeds), dtype=np.int64)
        for batch in batches:
            for w in K.iter_words(batch.column(0)):
                total += np.bincount(_hits(own, bits, w, rule)[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["seed", "n"])

    counts = np.zeros(len(items.seeds), dtype=np.int64)
    for r in docs.select(text).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.seed] = r.n
    return replace(items, count=counts)


def smith_waterman(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word hashes x with y: (score, end in x, end in y), ends exclusive.

    Match +2, mismatch -1, a gap of k words -k.  Rows run over y; the gap along x is a running maximum.
    """
    if not len(x) or not len(y):
        return 0, 0, 0
    ramp = np.arange(1, len(x) + 1, dtype=np.int64) * GAP
    prev, best = np.zeros(len(x) + 1, dtype=np.int64), (0, 0, 0)
    for j, word in enumerate(y):
        row = np.maximum(prev[:-1] + np.where(x == word, MATCH, MISMATCH), prev[1:] - GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + ramp) - ramp, 0)
        at = int(np.argmax(row))
        if row[at] > best[0]:
            best = (int(row[at]), at + 1, j + 1)
        prev = np.concatenate([[0], row])
    return best


def _clusters(diag: np.ndarray, gap: int) -> list[np.ndarray]:
    order = np.argsort(diag, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(diag[order]) > gap) + 1)


def align_row(h: np.ndarray, hits: tuple[np.ndarray, np.ndarray], items: Items, rule: Rule, seeds_of: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """(item, score, first word, end word, seeds) of the best alignment with each item that the row's hits call for."""
    at, seed = hits
    reps = np.diff(items.start)[seed]
    place = np.repeat(at, reps)
    flat = np.repeat(items.start[seed] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
    item, where = items.item[flat], items.place[flat]
    seed = np.repeat(seed, reps)
    out = []
    for k in np.unique(item):
        own = item == k
        y = items.words[k]
        pad = max(3, len(y) // 5)
        least, best = (rule.min_score if len(y) >= rule.short_words else 1.0) * MATCH * len(y), None
        clusters = _clusters((place - where)[own], max(2, len(y) // 2))
        for c in sorted(clusters, key=lambda c: items.count[seed[own][c]].min()):
            n_seeds = len(np.unique(seed[own][c]))
            if n_seeds < (rule.min_seeds if seeds_of[k] >= 6 else 1):
                continue
            diag = (place - where)[own][c]
            lo, hi = max(0, int(diag.min()) - pad), min(len(h), int(diag.max()) + len(y) + pad)
            # no alignment scores more than its matches, at most one for each word of either side
            most = MATCH * min(np.count_nonzero(np.isin(h[lo:hi], y)), np.count_nonzero(np.isin(y, h[lo:hi])))
            if most < least or (best and most < best[0]):
                continue
            score, end, end_y = smith_waterman(h[lo:hi], y)
            if score >= least and (best is None or (-score, lo + end) < (-best[0], best[2])):
                _, back, _ = smith_waterman(h[lo : lo + end][::-1], y[:end_y][::-1])
                best = (score, lo + end - back, lo + end, n_seeds)
        if best:
            out.append((int(k), best[0] / (MATCH * len(y)), best[1], best[2], best[3]))
    return out


def _search(batch_text, items: Items, bits: np.ndarray, rule: Rule, seeds_of: np.ndarray):
    """(row, alignments) of the rows of a batch that have any."""
    for w in K.iter_words(batch_text):
        at, seed = _hits(items, bits, w, rule)
        row = np.searchsorted(w.off, at, side="right") - 1
        for r in np.unique(row):
            lo, hi = np.searchsorted(row, [r, r + 1])
            found = align_row(w.h[w.off[r] : w.off[r + 1]], (at[lo:hi] - w.off[r], seed[lo:hi]), items, rule, seeds_of)
            if found:
                yield w.first + int(r), found


def _blocks(bench: DataFrame, key: str, text: str, rule: Rule) -> Iterator[Items]:
    """The benchmark in blocks of at most block_words words (or one item), one at a time."""
    ids, texts, words = [], [], 0
    for r in bench.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").orderBy("k", "t").toLocalIterator():
        n = len(r.t.split())
        if ids and words + n > rule.block_words:
            yield _items(ids, texts, rule.n, rule.spread)
            ids, texts, words = [], [], 0
        ids.append(r.k)
        texts.append(r.t)
        words += n
    if ids:
        yield _items(ids, texts, rule.n, rule.spread)


def _prepared(docs: DataFrame, text: str, bench: DataFrame, bench_key: str, bench_text: str, rule: Rule):
    sc = docs.sparkSession.sparkContext
    for block in _blocks(bench, bench_key, bench_text, rule):
        items = _counted(docs, text, block, rule)
        yield sc.broadcast((items, _filter(items.seeds), np.bincount(items.item, minlength=len(items.ids))))


def contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", bench_key: str = "item_id", bench_text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row for each document row and benchmark item that align with at least ``rule.min_score``:
    (key, item key, score, first_word, end_word, n_seeds); score is in (0, 1], the words are counted from 0.

    Items of fewer than ``rule.short_words`` words have rows only for whole copies, of score 1.  Null and empty
    texts, of documents and of items, align with nothing.  Rows that repeat give rows that repeat; a null key
    stays null.  Of alignments of one score the first in the text is given.  Empty tables give an empty result.
    Other columns are ignored; key columns of one name are an error.
    """
    if key == bench_key:
        raise ValueError("the key columns of documents and benchmark must have different names in the result")
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(bench_key, bench.schema[bench_key].dataType), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("n_seeds", T.LongType())])
    parts = []
    for shared in _prepared(docs, text, bench, bench_key, bench_text, rule):

        def search(batches, shared=shared):
            items, bits, seeds_of = shared.value
            for batch in batches:
                rows, cells = [], []
                for r, found in _search(batch.column(1), items, bits, rule, seeds_of):
                    for k, score, first, end, n in found:
                        rows.append(r)
                        cells.append((items.ids[k], score, first, end, n))
                cols = list(zip(*cells, strict=True)) if cells else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, f) for c, f in zip(cols, _arrow(out)[1:], strict=True)], out.names)

        parts.append(docs.select(key, text).mapInArrow(search, out))
    if not parts:
        return docs.sparkSession.createDataFrame([], out)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole


def decontaminated(docs: DataFrame, bench: DataFrame, text: str = "text", bench_key: str = "item_id", bench_text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of docs, with all their columns, that align with no benchmark item."""
    at = docs.columns.index(text)
    for shared in _prepared(docs, text, bench, bench_key, bench_text, rule):

        def drop(batches, shared=shared):
            items, bits, seeds_of = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for r, _ in _search(batch.column(at), items, bits, rule, seeds_of):
                    keep[r] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(drop, docs.schema)
    return docs


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
