"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles.  All sets are put in one global order, rare shingles first, where
"rare" comes from a count sketch over every document (a fixed 8 MB whatever the corpus holds; with any
counts the order stays global and the join exact).

A set of size s that needs an overlap of at least ``ceil(t * s)`` shares l shingles of its first
``s - ceil(t * s) + l`` with every set that it links to.  Each set picks the l from 1 to ``max_match``
whose estimated cost (postings read, plus candidates left after asking for l matches) is least, and a
pair becomes a candidate when it shares the smaller of its two l.  Size and position filters apply to
every shared shingle, and so does a parity bitmap: each shingle flips one of 512 bits of its set, so two
sets differ in at least as many shingles as their bitmaps differ in bits.  Sets of more than ``WIDE_FROM``
shingles have a second bitmap of a bit for each shingle; candidates pass it before their texts are moved.

Equal sets are collapsed to one representative before anything is joined.  Candidates come in two steps
that together lose no link between components:

* star: in each posting list everyone is paired with the list's most central member, so a list of a
  million near copies makes a million pairs; verified links are closed to components;
* rest: members outside the central member's component are paired with the members of other components.

Posting lists are kept by shingle and band of set sizes.  Sets that link are in the same band or in two that
touch, so each set is in the lists of its own band and of the next, and a pair is counted in the list that is
the own one of either.  Shingles that documents of very different sizes share by chance meet in no list.

A set is named by the smallest key that has it.  A key that repeats with different texts has several sets;
they are one node, so their names are linked before components are closed.

The result has one row per document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import broadcast_if, drop_stored, stored
from .components import components

#: log2 of the counters of the sketch.
SKETCH_BITS = 20
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 8
#: Estimated cost of verifying a candidate, in postings read.
VERIFY_COST = 50.0
#: Ids that may be broadcast as a filter (8 bytes each).
BROADCAST_IDS = 500_000
#: log2 of the bits of the filter that drops shingles which no two documents share.
SHARED_BITS = 26
#: Size from which a set has a wide bitmap.
WIDE_FROM = 1024
_BLOCK = 4096


def _need(num: int, den: int, size):
    """Least overlap of a set of this size with any set that links to it: ceil(num * size / den)."""
    return -((-num * size) // den)


def _band(num: int, den: int, size: int) -> int:
    """Sizes that link differ by at most den / num: a band of their logarithm (the margin is for its rounding)."""
    return int(math.log(size) / (math.log(den / num) * (1 + 1e-9) + 1e-9)) if size else 0


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _parity(s: np.ndarray, bits: int = 64 * PARITY_WORDS) -> np.ndarray:
    """The parity bitmap of a set of hashes; bits is a power of two."""
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def _wide(s: np.ndarray) -> bytes | None:
    """The wide bitmap of a large set."""
    return _parity(s, 1 << (len(s) - 1).bit_length()).tobytes() if len(s) > WIDE_FROM else None


def _differ(a: bytes, b: bytes) -> int:
    """Bits in which two wide bitmaps differ, the longer one folded to the length of the other."""
    x, y = sorted((np.frombuffer(v, dtype=np.uint64) for v in (a, b)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _sets(arr, n: int):
    """(row, sorted distinct shingle hashes) of every row."""
    for w in K.iter_words(arr):
        sh, off = K.shingles(w, n)
        for i in range(len(w)):
            yield w.first + i, np.unique(sh[off[i] : off[i + 1]])


def shingle_sketch(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Counts of shingles over all documents, in 2**SKETCH_BITS counters."""
    size = 1 << SKETCH_BITS

    def count(batches):
        flat = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for w in K.iter_words(batch.column(0)):
                sh, _ = K.shingles(w, n)
                flat += np.bincount(_buckets(sh), minlength=size)
        used = np.flatnonzero(flat.reshape(-1, _BLOCK).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([flat[b * _BLOCK : (b + 1) * _BLOCK].astype("<i4" if flat.max(initial=0) < 2**31 else "<i8").tobytes() for b in used], pa.binary())], ["block", "counts"])

    def add(key, t):
        total = np.zeros(_BLOCK, dtype=np.int64)
        for v in t.column("counts"):
            raw = v.as_buffer()
            total += np.frombuffer(raw, dtype="<i4" if len(raw) == 4 * _BLOCK else "<i8")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    partial = docs.select(text).mapInArrow(count, "block int, counts binary")
    out = np.zeros(size, dtype=np.int64)
    for r in partial.groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(bytes(r.counts), dtype="<i8")
    return out


def _signatures(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, max_match: int, sketch: np.ndarray) -> DataFrame:
    """(id, size, k1, k2, match, prefix, parity, band, wide) of every document; k1 and k2 name the set."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    id_type = docs.schema[key].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("size", T.IntegerType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("match", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType())), T.StructField("band", T.LongType()), T.StructField("wide", T.BinaryType())])

    def sign(batches):
        table = shared.value
        noise = table.mean()
        for batch in batches:
            size, k1, k2, match, pre, wide, parity = [], [], [], [], [], [], [np.zeros(0, dtype=np.int64)]
            for _, s in _sets(batch.column(1), n):
                m = len(s)
                size.append(m)
                with np.errstate(over="ignore"):
                    k1.append(K.mix(np.array([np.add.reduce(K.mix(s)) + np.uint64(m)]))[0])
                    k2.append(K.mix(np.array([np.add.reduce(K.mix(s ^ np.uint64(0xABC98388FB8FAC03))) ^ np.uint64(m)]))[0])
                parity.append(_parity(s))
                wide.append(_wide(s))
                if not m:
                    match.append(0)
                    pre.append(np.zeros(0, dtype=np.int64))
                    continue
                seen = table[_buckets(s)]
                order = np.lexsort((s, seen))
                base = m - _need(num, den, m)
                most = min(max_match, m - base)
                rare = np.cumsum(np.maximum(seen[order[: base + most]] - noise, 0.0))
                cost = [rare[base + k - 1] * (1 + VERIFY_COST / k) + base + k for k in range(1, most + 1)]
                pick = int(np.argmin(cost)) + 1
                match.append(pick)
                pre.append(s[order[: base + pick]].view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(p) for p in pre])]).astype(np.int32)
            flat = np.concatenate(pre) if pre else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(np.array(k1, dtype=np.uint64).view(np.int64)), pa.array(np.array(k2, dtype=np.uint64).view(np.int64)), pa.array(match, pa.int32()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat)), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(np.concatenate(parity))), pa.array([_band(num, den, m) for m in size], pa.int64()), pa.array(wide, pa.binary())],
                out.names,
            )

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(sign, out)


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """A filter of 2**SHARED_BITS bits that every given token passes."""
    place = F.col("token").bitwiseAND(F.lit((1 << SHARED_BITS) - 1))
    words = tokens.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(token & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (SHARED_BITS - 6), dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _shared_prefixes(signed: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(id, k1, k2, size, match, pos, own, token) with the lists of a set that pass the bitmap, of sets with any."""
    shared = signed.sparkSession.sparkContext.broadcast(bitmap)
    ids = signed.schema["id"]
    out = T.StructType([ids, T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("match", T.IntegerType()), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("own", T.ArrayType(T.BooleanType())), T.StructField("token", T.ArrayType(T.LongType()))])

    def keep(batches):
        bits = shared.value
        for batch in batches:
            lists, band = batch.column(5), batch.column(6).to_numpy()
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            off = off - off[0]
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            pos = np.arange(len(flat)) - off[:-1][row] + 1
            # the list of the own band, then that of the next
            row, pos, own = np.repeat(row, 2), np.repeat(pos, 2), np.tile([True, False], len(flat))
            flat = np.repeat(flat, 2) ^ (band[row] + ~own)
            at = flat & ((1 << SHARED_BITS) - 1)
            ok = (bits[at >> 6] >> (at & 63)) & 1 == 1
            n = np.bincount(row[ok], minlength=len(off) - 1)
            some = np.flatnonzero(n)
            bounds = pa.array(np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32))
            part = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*part.columns[:5], *[pa.ListArray.from_arrays(bounds, pa.array(x[ok])) for x in (pos.astype(np.int32), own, flat)]], out.names)

    return signed.filter("size > 0 and id is not null").select("id", "k1", "k2", "size", "match", "prefix", "band").mapInArrow(keep, out)


def _screened(pairs: DataFrame, wide: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) but those whose wide bitmaps, from (rep, size, wide), say that they can't link."""
    both = pairs.join(wide.toDF("a", "sa", "wa"), "a", "left").join(wide.toDF("b", "sb", "wb"), "b", "left").select("a", "b", "sa", "sb", "wa", "wb")

    def screen(batches):
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            ok = [wa is None or wb is None or _differ(wa, wb) <= sa + sb - 2 * _need(num, num + den, sa + sb) for sa, sb, wa, wb in rows]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(screen, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """(a, b, linked) of every candidate pair, from the whole texts."""
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(broadcast_if(ids, ids.count(), BROADCAST_IDS), "id", "left_semi")
    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches):
        for batch in batches:
            linked = []
            for (_, x), (_, y) in zip(_sets(batch.column(2), n), _sets(batch.column(3), n), strict=True):
                inter = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(inter > 0 and den * inter >= num * (len(x) + len(y) - inter))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    kind = pairs.schema["a"].dataType
    return full.select("a", "b", "ta", "tb").mapInArrow(verify, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("linked", T.BooleanType())]))


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, max_match: int = 4) -> DataFrame:
    """One row per document: (key, n_shingles, component_id, n_class).

    Two documents link when ``den * |x & y| >= num * |x | y|`` for their sets of n-word shingles (a document
    of fewer words has one shingle, its whole word sequence).  component_id is the smallest key reachable
    by links, n_class the number of rows whose set is equal.  Null and empty texts, and texts without
    words, have an empty set, link with nothing and are their own component.  Rows that repeat a key are
    one node, with the links of all its texts, and share its component; a row with a null key keeps a null
    component.  Columns of docs other than the two aren't read, whatever their names.  An empty table gives an
    empty result.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be in (0, 1]")
    sketch = shingle_sketch(docs, text, n)
    signed = stored(_signatures(docs, key, text, n, num, den, max_match, sketch), "signatures")
    sets = stored(signed.filter("size > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n_class")), "sets")
    listed = signed.filter("size > 0 and id is not null").select("band", F.explode("prefix").alias("t")).select(F.explode(F.array(F.struct(F.col("t").bitwiseXOR(F.col("band")).alias("token"), F.lit(True).alias("own")), F.struct(F.col("t").bitwiseXOR(F.col("band") + 1).alias("token"), F.lit(False).alias("own")))).alias("l")).select("l.*")
    shared = listed.groupBy("token").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 and own").select("token")
    # a posting list with one member makes no pair, so only prefixes' shared shingles move on
    kept = _shared_prefixes(signed, _bitmap(shared)).join(sets.select("k1", "k2", F.col("rep").alias("id")), ["k1", "k2", "id"])
    rows = stored(kept.select(F.col("id").alias("rep"), "size", "match", F.explode(F.arrays_zip("pos", "own", "token")).alias("p")).select("rep", "size", "match", "p.pos", "p.own", "p.token"), "rows")
    hubs = rows.groupBy("token").agg(F.count("*").alias("n"), F.max("own").alias("some"), F.min(F.struct("pos", "rep", "size", "match")).alias("hub")).filter("n > 1 and some").select("token", "hub")
    posts = stored(rows.join(hubs, "token"), "postings")
    drop_stored(rows)

    def near(p: str, q: str):
        """Size and position filters for two rows of a posting list, as SQL."""
        need = f"ceil({num} * ({p}.size + {q}.size) / {num + den})"
        return F.expr(f"least({p}.pos, {q}.pos) + least({p}.size - {p}.pos, {q}.size - {q}.pos) >= {need} and {den} * {p}.size >= {num} * {q}.size and {den} * {q}.size >= {num} * {p}.size")

    def alike(p: str, q: str):
        """Parity filter: bits that differ can't be more than shingles that may."""
        differ = " + ".join(f"bit_count({p}[{i}] ^ {q}[{i}])" for i in range(PARITY_WORDS))
        return differ

    # one row a set: a name that stands for several sets has the bitmap of each
    maps = signed.join(sets.select("k1", "k2", F.col("rep").alias("id")), ["k1", "k2", "id"]).select(F.col("id").alias("rep"), "k1", "k2", "size", "parity", "wide").dropDuplicates(["rep", "k1", "k2"]).drop("k1", "k2")
    maps = stored(maps.join(posts.select("rep").distinct(), "rep", "left_semi"), "parity")

    def mapped(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the parity filter."""
        both = pairs.join(maps.toDF("a", "sa", "pa"), "a").join(maps.toDF("b", "sb", "pb"), "b")
        return both.filter(F.expr(f"{alike('pa', 'pb')} <= sa + sb - 2 * ceil({num} * (sa + sb) / {num + den})")).select("a", "b")

    # keys that repeat with different texts: their sets are one node, and no one bitmap speaks for it
    several = stored(signed.filter("size > 0 and id is not null").groupBy("id").agg(F.min("k1").alias("l1"), F.max("k1").alias("h1"), F.min("k2").alias("l2"), F.max("k2").alias("h2")).filter("l1 <> h1 or l2 <> h2").select("id"), "several")
    wide = maps.filter("wide is not null").select("rep", "size", "wide").join(several.withColumnRenamed("id", "rep"), "rep", "left_anti")
    maps = maps.drop("wide")
    star = posts.alias("p").filter(F.expr("rep <> hub.rep") & near("p", "hub")).select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()
    star = stored(_screened(mapped(star), wide, num, den), "pairs")
    tried = stored(_verified(star, docs, key, text, n, num, den).groupBy("a", "b").agg(F.max("linked").alias("linked")), "star")
    same = signed.filter("size > 0").join(several, "id", "left_semi").join(sets, ["k1", "k2"]).filter("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    same = stored(same, "same")
    comps = stored(components(tried.filter("linked").select("a", "b").union(same), "a", "b"), "components")

    def placed(df: DataFrame, node: str, comp: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(node), F.col("component").alias(comp)), node, "left").withColumn(comp, F.coalesce(comp, node))

    open_posts = placed(posts.select("token", "own", "rep", "pos", "size", "match", F.col("hub.rep").alias("hub_rep")), "rep", "comp")
    open_posts = placed(open_posts, "hub_rep", "hub_comp")
    # lists whose members are all in one component are done
    columns = ["token", "own", "rep", "pos", "size", "match", "comp", "hub_comp"]
    outside = stored(open_posts.filter("comp <> hub_comp").select(*columns), "outside")
    left = open_posts.join(outside.select("token").distinct(), "token", "left_semi").select(*columns)
    sides = [x.join(maps.select("rep", F.col("size").alias("s"), "parity"), "rep").filter("size = s").drop("s") for x in (outside, left)]
    pairs = (
        sides[0].alias("x")
        .join(sides[1].alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr("(x.own or y.own) and x.comp <> y.comp and (y.comp = y.hub_comp or x.rep < y.rep)") & near("x", "y") & F.expr(f"{alike('x.parity', 'y.parity')} <= x.size + y.size - 2 * ceil({num} * (x.size + y.size) / {num + den})"))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.least("x.match", "y.match").alias("m"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"), F.min("m").alias("m"))
        .filter("shared >= m")
        .select("a", "b")
        .join(tried.select("a", "b"), ["a", "b"], "left_anti")
    )
    pairs = stored(_screened(pairs, wide, num, den), "pairs")
    for done in (posts, outside, maps):
        drop_stored(done)
    rest = _verified(pairs, docs, key, text, n, num, den).filter("linked").select("a", "b")
    linked = tried.filter("linked").select("a", "b").union(rest).union(same)
    final = stored(components(linked, "a", "b"), "components")
    rep = sets.select("k1", "k2", "rep", "n_class").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n_class", F.coalesce("component", "rep").alias("comp"))
    return signed.select("id", "size", "k1", "k2").join(rep, ["k1", "k2"], "left").select(
        F.col("id").alias(key),
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"),
        F.coalesce("n_class", F.lit(1)).alias("n_class"),
    )


def one_of_each_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, without near duplicates: of each component of
    jaccard_classes() the row with the smallest key stays.

    Where a key repeats, rows are named by the key and a digest of the text: texts of one key that aren't near
    duplicates all stay, of rows that repeat both one does.  Rows with a null key can't be told apart and all stay.
    """
    n, distinct = docs.agg(F.count(key), F.count_distinct(key)).first()
    name = F.col(key) if n == distinct else F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("text")))
    named = docs.select(name.alias("__id"), F.col(text).alias("__text"))
    classes = stored(jaccard_classes(named, "__id", "__text", **how).select("__id", "component_id"), "classes")
    keep = classes.filter("__id = component_id").select("__id").distinct()
    kept = docs.join(keep, name == keep["__id"], "left_semi")
    if n != distinct:
        kept = kept.withColumn("__id", name).dropDuplicates(["__id"]).drop("__id")
    if classes.filter("__id is null").limit(1).count():
        kept = kept.unionByName(docs.filter(F.col(key).isNull()))
    return kept.select(*docs.columns)
