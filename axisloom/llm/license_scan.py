"""License scans by patience alignment.

A text and a licence template are aligned on the words that occur once in each: the longest increasing
subsequence of their places anchors the alignment, and the gaps between anchors are aligned in the same
way, after common words at their ends.  Coverage is the share of the template's words that align.

A long document says its words many times, so the alignment looks at one window of ``slack`` times the
template's length at a time.  The words that a window and the template have in common, each as often as
both have it, bound what can align in it, and are counted for all windows at once.  The window of the
largest bound is aligned first; what is found in it is cut out, and the text before and after it is searched
in the same way, down to windows whose bound is too small.  A window that fails is aligned with a quarter of
the template's length before and after it, and no window in that stretch is tried again, so a text full of
licence words takes time in proportion to its length.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .license_texts import TEMPLATES

#: Lower-cases ASCII letters and turns the punctuation at which words of notices differ into blanks.
_TABLE = K.LOWER.copy()
_TABLE[[ord(c) for c in ".,;:()\"'`*#!?<>[]{}/\\|_=~"]] = 32


def _words(texts: list[str]) -> list[np.ndarray]:
    return [w.h[w.off[i] : w.off[i + 1]] for w in K.iter_words(pa.array(texts, pa.string()), table=_TABLE) for i in range(len(w))]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first place, whose second places rise too."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _once(words: list, lo: int, hi: int) -> dict:
    """Place of every word that occurs once in words[lo:hi]."""
    out: dict = {}
    for i in range(lo, hi):
        out[words[i]] = -1 if words[i] in out else i
    return {w: i for w, i in out.items() if i >= 0}


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of two word lists, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i >= k or j >= m:
            continue
        one, two = _once(a, i, k), _once(b, j, m)
        anchors = _increasing([(p, two[w]) for w, p in one.items() if w in two])
        if not anchors:
            continue
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (k, m)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


@dataclass(frozen=True)
class Found:
    license: str
    coverage: float
    first: int
    end: int
    matched: int


class Scanner:
    """Templates by name, ready to be looked for."""

    def __init__(self, templates: dict[str, str], min_coverage: float, slack: float):
        self.names = list(templates)
        words = _words([templates[n] for n in self.names])
        self.words = [w.tolist() for w in words]
        self.vocab = [np.unique(w) for w in words]
        self.all = np.unique(np.concatenate(words)) if words else np.zeros(0, dtype=np.uint64)
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.all >> np.uint64(48)).astype(np.int64)] = True
        self.member = np.array([np.isin(self.all, v) for v in self.vocab]).reshape(len(self.names), len(self.all))
        #: How often each template has each of all words.
        self.times = [np.bincount(np.searchsorted(self.all, w), minlength=len(self.all)) for w in words]
        self.min_coverage, self.slack = min_coverage, slack

    def scan(self, h: np.ndarray) -> list[Found]:
        """All licences in a document, given as word hashes."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)])
        if not len(at):
            return []
        place = np.minimum(np.searchsorted(self.all, h[at]), len(self.all) - 1)
        ok = self.all[place] == h[at]
        at, place = at[ok], place[ok]
        out = []
        for t, name in enumerate(self.names):
            own = self.member[t, place]
            for first, end, matched in self._occurrences(h, at[own], place[own], t):
                out.append(Found(name, matched / len(self.words[t]), first, end, matched))
        return sorted(out, key=lambda f: (-f.matched, -f.coverage, f.first, f.license))

    def _occurrences(self, h: np.ndarray, at: np.ndarray, word: np.ndarray, t: int) -> list[tuple[int, int, int]]:
        """(first place, end, aligned words) of every occurrence of template t; at: places of its words in h."""
        n = len(self.words[t])
        need, span = int(np.ceil(self.min_coverage * n)), int(np.ceil(self.slack * n))
        pad, found, todo = n // 4, [], [(0, len(at))]
        while todo:
            i, k = todo.pop()
            if k - i < need:
                continue
            bound = _in_common(at[i:k], word[i:k], self.times[t], span)
            edge = int(at[k - 1]) + 1
            while bound.max() >= need:
                # the last of the best: it leaves out words before the occurrence
                s = i + len(bound) - 1 - int(np.argmax(bound[::-1]))
                lo, hi = int(at[s]), min(int(at[s]) + span, edge)
                pairs = patience(h[lo:hi].tolist(), self.words[t])
                if len(pairs) < need:
                    lo, hi = max(lo - pad, int(at[i])), min(lo + span + pad, edge)
                    pairs = patience(h[lo:hi].tolist(), self.words[t])
                if len(pairs) >= need:
                    first, end = lo + pairs[0][0], lo + pairs[-1][0] + 1
                    found.append((first, end, len(pairs)))
                    todo += [(i, int(np.searchsorted(at, first))), (int(np.searchsorted(at, end)), k)]
                    break
                tried = slice(*(np.searchsorted(at[i:k], [int(at[s]) - pad, int(at[s]) + pad + 1])))
                bound[tried] = 0
        return found


def _in_common(at: np.ndarray, word: np.ndarray, times: np.ndarray, span: int) -> np.ndarray:
    """For the window of span words from each place in at: the words that it has in common with a template that
    has word w times[w] times."""
    order = np.lexsort((at, word))
    # the place as many occurrences of the same word back as the template has of it: windows from there on up to
    # the word itself count it
    back = np.full(len(at), -1, dtype=np.int64)
    rank = np.arange(len(at)) - times[word[order]]
    ok = (rank >= 0) & (word[order][np.maximum(rank, 0)] == word[order])
    back[order[ok]] = at[order[rank[ok]]]
    after = np.searchsorted(at, np.maximum(back, at - span), side="right")
    steps = np.bincount(after, minlength=len(at) + 1) - np.bincount(np.arange(len(at)) + 1, minlength=len(at) + 1)
    return np.cumsum(steps)[: len(at)]


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, min_coverage: float = 0.75, slack: float = 1.25) -> DataFrame:
    """One row per document row: (key, license, coverage, licenses).

    licenses lists every occurrence of a template of which at least min_coverage aligns within slack times
    its length, as (license, coverage, first_word, end_word), most aligned words first; license and coverage are
    the first one's, NULL and 0.0 where there is none; of equally many the larger coverage, then the place,
    then the name decides.  Words are split at blanks and punctuation and counted from 0.  Null and empty texts have none; rows
    that repeat, also in their key, and null keys each have their own result; an empty table gives an empty
    one.  Other columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, min_coverage, slack))
    one = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    out = T.StructType([docs.schema[key], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("licenses", T.ArrayType(one))])
    cell = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))

    def scan(batches):
        for batch in batches:
            found = []
            for w in K.iter_words(batch.column(1), table=_TABLE):
                found += [shared.value.scan(w.h[w.off[i] : w.off[i + 1]]) for i in range(len(w))]
            lists = [[{"license": f.license, "coverage": f.coverage, "first_word": f.first, "end_word": f.end} for f in fs] for fs in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fs[0].license if fs else None for fs in found], pa.string()), pa.array([fs[0].coverage if fs else 0.0 for fs in found], pa.float64()), pa.array(lists, cell)], out.names)

    return docs.select(F.col(key), F.col(text)).mapInArrow(scan, out)
