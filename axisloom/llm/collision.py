"""Near-duplicates of embeddings by collision-counting projections.

Vectors are brought to length 1 and projected on many random Gaussian directions.  A direction moves two vectors at
distance d apart by a normal deviate of scale d, independent of the others: so each projection, sorted, has a window
around a query that a vector at the threshold's distance falls into with known probability, and the number of windows
in which it does is binomial.  The least count is the largest that keeps ``recall`` of pairs that lie exactly at the
threshold; closer pairs pass more often.  Pairs that pass are verified by their cosine in double precision.

Only vectors of one label and dimension meet.  A label's vectors are dealt into blocks, every pair of blocks is one
task's work, and a task hands on sums and a spanning forest of its links, never the links themselves: its output
grows with its vectors, whatever groups of copies they hold.  Equal vectors of a label are one row with a count.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, stored
from .components import components

FOUND = "key binary, links long, a long, b long"


def least_count(projections: int, p: float, recall: float) -> int:
    """The largest count that a binomial of so many draws of probability p reaches with probability recall at least."""
    tail = 1.0
    for k in range(projections + 1):
        if tail < recall:
            return max(1, k - 1)
        tail -= math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
    return projections


def window_probability(window: float) -> float:
    """That a normal deviate lies within window of its mean."""
    return math.erf(window / math.sqrt(2))


@lru_cache(maxsize=8)
def directions(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


class Forest:
    """Components of numbered nodes, and the links that joined them."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []
        self.members = [[i] for i in range(n)]

    def join(self, node: int, others: np.ndarray) -> None:
        for other in np.unique(self.label[others]).tolist():
            own = int(self.label[node])
            if other == own:
                continue
            small, large = sorted((own, other), key=lambda k: len(self.members[k]))
            self.links.append((node, int(others[np.argmax(self.label[others] == other)])))
            self.label[self.members[small]] = large
            self.members[large] += self.members[small]
            self.members[small] = []


def collisions(unit: np.ndarray, first: np.ndarray, second: np.ndarray, reach: float, window: float, projections: int, least: int, seed: int):
    """(query, candidates) for rows of unit: candidates of second whose projections lie in the windows of a query of
    first in at least so many projections.  Where first is second, every pair comes once."""
    at = unit @ directions(unit.shape[1], projections, seed)
    own = len(first) == len(second) and bool((first == second).all())
    orders, lows, highs = [], [], []
    for j in range(projections):
        order = np.argsort(at[second, j], kind="stable")
        line = at[second[order], j]
        orders.append(order)
        lows.append(np.searchsorted(line, at[first, j] - window * reach, "left"))
        highs.append(np.searchsorted(line, at[first, j] + window * reach, "right"))
    count = np.zeros(len(second), dtype=np.uint16)
    for k, q in enumerate(first.tolist()):
        count[:] = 0
        for order, low, high in zip(orders, lows, highs, strict=True):
            count[order[low[k] : high[k]]] += 1
        near = np.flatnonzero(count[k + 1 :] >= least) + k + 1 if own else np.flatnonzero(count >= least)
        if len(near):
            yield q, second[near]


def _task(threshold: float, window: float, projections: int, least: int, seed: int):
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))

    def found(table: pa.Table) -> pa.Table:
        """Links of one pair of blocks: for each vector the copies it is linked to, and links that join components."""
        n, values = table.num_rows, table["vector"].combine_chunks()
        raw = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        block, copies, ids = table["block"].to_numpy(), table["copies"].to_numpy(), table["id"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links, forest = np.zeros(n, dtype=np.int64), Forest(n)
        for q, near in collisions(unit, first, second, reach, window, projections, least, seed):
            linked = near[unit[near] @ unit[q] >= threshold]
            if len(linked):
                links[q] += copies[linked].sum()
                links[linked] += copies[q]
                forest.join(q, linked)
        k = np.flatnonzero(links)
        a, b = ([x[side] for x in forest.links] for side in (0, 1))
        pad = [None] * len(a)
        keys = table["key"].combine_chunks()
        return pa.table({"key": pa.concat_arrays([keys.take(pa.array(k)).cast(pa.binary()), pa.array(pad, pa.binary())]), "links": pa.concat_arrays([pa.array(links[k]), pa.array(pad, pa.int64())]), "a": pa.array([None] * len(k) + ids[a].tolist(), pa.int64()), "b": pa.array([None] * len(k) + ids[b].tolist(), pa.int64())})

    return found


def usable(vector: str, label: str, key: str) -> Column:
    """Whether a row can link: key and label known, components known and finite and not all zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(key).isNotNull() & F.col(label).isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, projections: int = 24, window: float = 1.5, recall: float = 0.9999, block_rows: int = 32_768, seed: int = 1) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of df.

    Rows link when their labels are equal and the cosine is at least threshold; n_links counts other rows linked directly,
    component_id is the smallest key reachable by links, kept whether that is the row's own.  window is half the
    width of a projection's window, in units of the distance at the threshold; recall is the share of pairs exactly at the
    threshold that the count lets through, and fixes the count.

    Rows whose key or label is null, and vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; neither do vectors of different dimension.  A row with a null key has a null component and isn't kept.
    Rows that repeat a key are vectors of their own, each with its links, in one component if they link with
    anything.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    least = least_count(projections, window_probability(window), recall)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.col("label"), F.col("vector").cast("string")), 256))
    rows = rows.withColumn("ok", usable("vector", "label", "id")).withColumn("key", F.when(F.col("ok"), digest))
    alike = rows.filter("ok").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    alike = stored(alike.withColumn("dim", F.size("vector")), "vectors")
    sizes = alike.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    sizes = stored(sizes, "blocks")
    dealt = alike.join(broadcast_if(sizes, sizes.count(), 100_000), ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    found = stored(dealt.select("label", "dim", "low", "high", "block", "key", "id", "copies", "vector").groupBy("label", "dim", "low", "high").applyInArrow(_task(threshold, window, projections, least, seed), FOUND), "links")
    links = found.filter("links is not null").groupBy("key").agg(F.sum("links").alias("links"))
    group = components(found.filter("a is not null"), "a", "b")
    known = alike.select("key", "id", "copies").join(links, "key", "left").join(group.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "key").join(known, "key", "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
