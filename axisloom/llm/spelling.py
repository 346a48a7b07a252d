"""Spelling variants: words one edit apart, by two-dimensional range reporting.

Words of one length L are points in a plane: their place in forward order and their place in reverse order.  For an
edit at position p of a word, the words that share what stands before p are an interval of the forward order, those that
share what stands after it are an interval of the reverse order, and the words in both differ from it at p alone.  A
wavelet tree over the reverse places in forward order reports the points of the two intervals.  Replacements look among
words of the same length, insertions among those one longer; deletions are insertions seen from the other word.

Edits in a word's second half keep its first half, edits in the first half keep the second: so words meet in groups of
one length and one half, twice each, and a task holds the groups of one bucket.  A group of more than ``split``
words is dealt over several parts, each of which every query of the group visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if, drop_stored, stored

#: Letters whose maximal runs are words.
LETTERS = r"A-Za-zÀ-ÿ"
NEAR = "word string, near long, best_n long, best string"
#: Codes that a task holds in one matrix of words at most, unless one word alone has more.
CELLS = 8_000_000


class WaveletTree:
    """Points (position, value) of a permutation; reports those of many rectangles at once."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        now = np.asarray(values, dtype=np.int64)
        for level in reversed(range(max(1, int(len(now) - 1).bit_length()))):
            ones = (now >> level & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~ones)))
            self.levels.append((level, zeros))
            now = np.concatenate((now[~ones], now[ones]))

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of every point with left <= position < right and low <= value < high."""
        query = np.flatnonzero((left < right) & (low < high))
        left, right, node = left[query], right[query], np.zeros(len(query), dtype=np.int64)
        for level, zeros in self.levels:
            l0, r0 = zeros[left], zeros[right]
            child = [(l0, r0, node * 2), (zeros[-1] + left - l0, zeros[-1] + right - r0, node * 2 + 1)]
            kept = []
            for a, b, v in child:
                k = np.flatnonzero((a < b) & (v << level < high[query]) & (v + 1 << level > low[query]))
                kept.append((query[k], a[k], b[k], v[k]))
            query, left, right, node = (np.concatenate(x) for x in zip(*kept, strict=True))
        return query, node


def _codes(words: list[str], wide: bool) -> np.ndarray:
    """The code points of words of one length, a row each."""
    data = "".join(words).encode("utf-32-le" if wide else "latin-1", "surrogatepass")
    return np.frombuffer(data, dtype=np.uint32 if wide else np.uint8).reshape(len(words), -1)


def _interval(sorted_words: np.ndarray, prefix: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places among sorted words, all of the given length, of those that begin with each prefix."""
    wide = prefix.dtype != np.uint8
    text = f"{'U' if wide else 'S'}{width}"
    low = np.zeros((len(prefix), width), dtype=prefix.dtype)
    low[:, : prefix.shape[1]] = prefix
    high = low.copy()
    high[:, prefix.shape[1] :] = 0x10FFFF if wide else 0xFF
    return np.searchsorted(sorted_words, low.view(text).ravel(), "left"), np.searchsorted(sorted_words, high.view(text).ravel(), "right")


class _Plane:
    """The words of one length in forward and reverse order."""

    def __init__(self, codes: np.ndarray):
        self.width = codes.shape[1]
        text = f"{'S' if codes.dtype == np.uint8 else 'U'}{self.width}"
        ahead, back = np.ascontiguousarray(codes).view(text).ravel(), np.ascontiguousarray(codes[:, ::-1]).view(text).ravel()
        order, self.reverse = np.argsort(ahead), np.argsort(back)
        self.ahead, self.back = ahead[order], back[self.reverse]
        place = np.empty(len(order), dtype=np.int64)
        place[self.reverse] = np.arange(len(order))
        self.tree = WaveletTree(place[order])

    def near(self, q: np.ndarray, p: int, insert: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the words that an edit of the queries at p gives, a query's own text included."""
        left, right = _interval(self.ahead, q[:, :p], self.width)
        some = np.flatnonzero(left < right)
        low, high = _interval(self.back, q[some, p if insert else p + 1 :][:, ::-1], self.width)
        found, value = self.tree.report(left[some], right[some], low, high)
        return some[found], self.reverse[value]


def _pairs(words: list[str], length: np.ndarray, role: np.ndarray, forward: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, rows one edit away, whether the edit is an insertion) of one bucket.  role: 1 for words to find, 2 for
    queries of their own length, 4 for queries of the next."""
    wide = any(max(w) > "\xff" for w in words)
    for size in np.unique(length[role & 1 > 0]).tolist():
        target = np.flatnonzero((length == size) & (role & 1 > 0))
        codes = _codes([words[i] for i in target], wide)
        plane, half = _Plane(codes), size // 2
        for insert, own in ((False, size), (True, size - 1)):
            asking = np.flatnonzero((length == own) & (role & (4 if insert else 2) > 0))
            for at in range(0, len(asking), max(1, CELLS // size)) if own else ():
                rows = asking[at : at + max(1, CELLS // size)]
                q = _codes([words[i] for i in rows], wide)
                for p in range(half, own + insert) if forward else range(min(half, own + insert)):
                    i, t = plane.near(q, p, insert)
                    if insert:  # of equal results the first position counts
                        fresh = codes[t, p] != q[i, p - 1] if p else np.ones(len(i), dtype=bool)
                    else:
                        fresh = codes[t, p] != q[i, p]
                    yield rows[i[fresh]], target[t[fresh]], insert


def _bucket(table: pa.Table) -> pa.Table:
    """Near words of one bucket of rows (word, n, role, forward): for each word their number and the best of them."""
    words, n, role = table["word"].to_pylist(), table["n"].to_numpy(), table["role"].to_numpy()
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.cumsum([0, *(words[a] != words[b] for a, b in zip(order, order[1:], strict=False))])[: len(words)]
    rank = np.empty(len(words), dtype=np.int64)
    rank[order] = place
    # parts of one group that meet in a bucket bring a query more than once: the row that is also a word to find stays
    once = np.lexsort((-role, role == 4, rank))
    once = once[np.flatnonzero(np.diff(rank[once] * 2 + (role[once] == 4), prepend=-1))]
    words, n, role, rank = [words[i] for i in once], n[once], role[once], rank[once]
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    count, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1)

    def add(owner: np.ndarray, other: np.ndarray) -> None:
        np.add.at(count, owner, 1)
        order = np.lexsort((rank[other], -n[other], owner))
        first = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        mine, new, old = owner[first], other[first], best[owner[first]]
        better = (old < 0) | (n[new] > n[old]) | ((n[new] == n[old]) & (rank[new] < rank[old]))
        best[mine[better]] = new[better]

    for a, b, insert in _pairs(words, length, role, bool(table["forward"][0].as_py())):
        if len(a):
            add(a, b)
            if insert:
                add(b, a)
    k = np.flatnonzero(count)
    return pa.table({"word": pa.array([words[i] for i in k], pa.string()), "near": count[k], "best_n": n[best[k]], "best": pa.array([words[i] for i in best[k]], pa.string())})


def near_words(words: DataFrame, bucket_rows: int = 200_000, split: int = 50_000) -> DataFrame:
    """(word, near, best_n, best) for words (word, n), distinct and without U+0000: how many others differ by one inserted, deleted or
    replaced code point, and which of them has the largest n (ties: the smallest in code-point order); no row for
    words without any.  Null words are left out."""
    words = words.filter("word is not null")
    size = F.length("word")
    half = (size / 2).cast("int")  # what edits in the second half keep
    longer = ((size + 1) / 2).cast("int")
    visit = lambda role, width, forward, key: F.struct(F.lit(role).alias("role"), width.alias("width"), F.lit(forward).alias("forward"), key.alias("key"))
    own = F.array(visit(3, size, True, F.substr("word", F.lit(1), half)), visit(3, size, False, F.substr("word", half + 1)))
    ask = F.array(visit(4, size + 1, True, F.substr("word", F.lit(1), longer)), visit(4, size + 1, False, F.substr("word", longer)))
    rows = words.select("word", "n", F.explode(F.concat(own, ask)).alias("v")).select("word", "n", "v.*")
    rows = rows.withColumn("group", F.xxhash64("width", "forward", "key")).drop("key")
    hot = stored(rows.filter("role = 3").groupBy("group").agg(F.ceil(F.count("*") / F.lit(split)).cast("int").alias("parts")).filter("parts > 1"), "hot_groups")
    rows = rows.join(broadcast_if(hot, hot.count(), 100_000), "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("role", F.when((F.col("role") == 3) & (F.col("part") != F.col("mine")), F.lit(2)).otherwise(F.col("role")))
    buckets = max(1, -(-4 * words.count() // bucket_rows))
    place = F.pmod(F.xxhash64("group", "part"), F.lit(buckets)) * 2 + F.col("forward").cast("int")
    found = rows.select(place.alias("bucket"), "word", F.col("n").cast("long").alias("n"), F.col("role").cast("int").alias("role"), "forward").groupBy("bucket").applyInArrow(_bucket, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form), acyclic and one for each word: the last of the forms that follow from the
    word.  Every round doubles the steps made."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        following = stored(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = following.filter("moved").limit(1).count()
        drop_stored(now)
        now = following.select("word", "root")
        if not moved:
            return now


def misspelt(run: Column, key: Column, one_in: int) -> Column:
    """run, or for one in ``one_in`` of (key, run) by crc32 of ``<key>:<run>``, run without its code point number crc32 mod
    length, from 0; a null key is written ``null``."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", letters: str = LETTERS, min_length: int = 5, min_count: int = 3, one_in: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of all texts, A-Z lower-cased, of at least min_length code points and min_count
    occurrences.  With one_in, runs are misspelt by key first."""
    low = docs.select(F.col(key).alias("k"), F.translate(F.col(text), UPPER, LOWER).alias("t"))
    runs = low.select("k", F.explode(F.regexp_extract_all("t", F.lit(f"[{letters}]{{{max(1, min_length)},}}"), F.lit(0))).alias("run"))
    word = misspelt(F.col("run"), F.col("k"), one_in) if one_in else F.col("run")
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= max(1, min_length)) & (F.col("n") >= min_count))


def spelling_variants(words: DataFrame, ratio: float = 2.0, bucket_rows: int = 200_000, split: int = 50_000) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for words (word, n), distinct.

    form is the near word of largest n (ties: the smallest in code-point order) if that n is at least ratio times the
    word's, else null; root is the last word when forms are followed, the word itself without a form.  Ratios of
    1 or less would let forms run in circles and are refused.  No words give no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, bucket_rows, split)
    joined = words.join(near, "word", "left")
    good = F.col("best_n") >= F.lit(ratio) * F.col("n")
    variants = stored(joined.select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "variants")
    roots = with_roots(variants.filter("form is not null"))
    return variants.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
