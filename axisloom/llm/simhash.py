"""Document fingerprints: SimHash over weighted words and word pairs, and permuted block tables for near fingerprints.

All of it is DataFrame operations.  A fingerprint has 128 bits.  The terms of a text are its distinct words, with
weight 3 if longer than three characters and else 1 (short words are the common ones), and its distinct pairs
of a word and the next, with weight 1; each term's two 64-bit hashes vote with its weight for or against every bit.
A changed word so moves 3 to 5 of the votes, and a word that fills half a text (a cell border, a
filler) has no more say than others.

Votes are counted four at a time: ``(h >> k) & 0x0001000100010001`` spreads every sixteenth bit of a hash
over the 16-bit lanes of a long, so 32 sums in one generated aggregation serve 128 counters.  A lane holds
the votes of 10,922 terms of weight 3; longer term lists are summed in chunks of that many, and chunks in
64 sums of 32-bit lanes, so texts of any length count in full.  The aggregation runs on rows that are
already dealt by their key, without a shuffle of its own.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

BITS = 128
_LANES = 0x0001000100010001
_PAIRS = 0x0000FFFF0000FFFF
_CHUNK = 10_922
#: Bits that near fingerprints may differ in.  It holds 93 % of the 3,891 pairs of different texts of 0.17 GB of
#: documents whose 3-word shingles have a Jaccard of 0.9 or more (10 bits would hold 81 %, 13 bits 96 %); of unrelated
#: texts, one pair in 10,000 is nearer than 41 bits.
RADIUS = 12
#: Keys that this divides are the queries of a near search.
QUERY_STEP = 50


def words_of(text: Column) -> Column:
    """The words, ASCII letters lower-cased, as an array."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), "")


def terms_of(words: Column) -> Column:
    """The distinct words and the distinct pairs of a word and the next (with a space between them, which no word holds),
    as an array; words should be a column, as it is read more than once."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(F.array_distinct(words), F.array_distinct(pairs))


def fingerprints(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """keys and, for the i-th of texts, the halves a<i> and b<i> of its fingerprint as longs.

    The keys name the rows.  Null texts and texts without words have an all-zero fingerprint; equal texts
    have equal fingerprints.
    """
    tagged = rows.select(*keys, F.posexplode(F.array(*[words_of(F.col(t)) for t in texts])).alias("tag", "words"))
    terms = tagged.select(*keys, "tag", F.posexplode_outer(terms_of(F.col("words"))).alias("pos", "term"))
    weight = F.when(F.col("term").isNull(), 0).when(F.instr("term", " ") > 0, 1).when(F.length("term") > 3, 3).otherwise(1).cast("long")
    hashed = terms.select(*keys, "tag", F.floor(F.coalesce("pos", F.lit(0)) / _CHUNK).cast("int").alias("chunk"), F.xxhash64("term").alias("h0"), F.xxhash64("term", F.lit(1)).alias("h1"), weight.alias("w"))
    votes = [F.sum(F.col("w") * F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))).alias(f"{h}_{k}") for h in ("h0", "h1") for k in range(16)]
    chunks = hashed.groupBy(*keys, "tag", "chunk").agg(F.sum("w").alias("w"), *votes)
    wide = [F.sum((F.shiftrightunsigned(f"{h}_{k}", 16) if odd else F.col(f"{h}_{k}")).bitwiseAND(F.lit(_PAIRS))).alias(f"{h}_{k}_{odd}") for h in ("h0", "h1") for k in range(16) for odd in (0, 1)]
    summed = chunks.groupBy(*keys, "tag").agg(F.sum("w").alias("w"), *wide)

    def half(h: str) -> Column:
        out = F.lit(0).cast("long")
        for bit in range(64):
            lane, k = divmod(bit, 16)
            pair = F.col(f"{h}_{k}_{lane % 2}")
            votes = F.shiftrightunsigned(pair, 32) if lane >= 2 else pair.bitwiseAND(F.lit(0xFFFFFFFF))
            out = out.bitwiseOR(F.when(2 * votes > F.col("w"), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0))).otherwise(F.lit(0)).cast("long"))
        return out

    halves = summed.select(*keys, "tag", half("h0").alias("a"), half("h1").alias("b"))
    of = lambda c, i: F.max(F.when(F.col("tag") == i, F.col(c))).alias(f"{c}{i}")
    return halves.groupBy(*keys).agg(*[of(c, i) for i in range(len(texts)) for c in ("a", "b")])


def as_text(a: Column, b: Column) -> Column:
    """The fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return F.lit(1.0) - (F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))) / F.lit(float(BITS))


def distance(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Bits in which two fingerprints, given by their halves, differ."""
    return F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))


def _half(fp: Column, second: bool) -> Column:
    """Half of a fingerprint as text, as a long."""
    part = lambda i: F.conv(F.substring(fp, 1 + 8 * i + 16 * second, 8), 16, 10).cast("long")
    return F.shiftleft(part(0), 32).bitwiseOR(part(1))


def next_keys(docs: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, size, next): the next smaller key of each key, and the largest after the smallest.

    Keys are dealt into ranges once (and stored, so that a range stays what it is), ordered within their
    range, and the ranges' largest keys are chained: one row a range.  Null keys are left out; of rows that
    repeat a key one is kept, with the largest size.
    """
    ids = docs.select(F.col(key).alias("id"), size.alias("size")).filter("id is not null")
    n, distinct = ids.agg(F.count("*"), F.count_distinct("id")).first()
    if n != distinct:
        ids = ids.groupBy("id").agg(F.max("size").alias("size"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(ids.repartitionByRange(parts, F.col("id").desc()).withColumn("part", F.spark_partition_id()), "ranges")
    tops = ranged.groupBy("part").agg(F.max("id").alias("top"))
    order = W.orderBy(F.col("top").desc())
    chain = tops.select("part", F.coalesce(F.lead("top").over(order), F.first("top").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    inner = ranged.withColumn("lead", F.lead("id").over(W.partitionBy("part").orderBy(F.col("id").desc())))
    return inner.join(chain, "part").select("id", "size", F.coalesce("lead", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_near).

    The edited text is the text with its last ``floor(n_chars / 3)`` code points replaced by the first as
    many (or all) of the next document's, in descending order of keys; the last document is followed by
    the first, and a single document by itself.  Null texts count as empty.  Rows that repeat a key are
    edited alike, with the longest text of the next key; a row with a null key has no next document: its
    end is cut, and near_next compares with the empty text.  n_near, for keys that QUERY_STEP divides (null for
    the others), is the number of rows of all whose fingerprint is within RADIUS bits, by block tables.  An
    empty table gives an empty result.  Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    chain = stored(next_keys(docs, key, F.length(body)), "chain")
    rows = chain.count()
    full = docs.select(F.col(key).alias("id"), body.alias("body"))
    repeats = rows != docs.filter(F.col(key).isNotNull()).count()
    repeats = repeats or bool(docs.filter(F.col(key).isNull()).limit(1).count())
    if repeats:
        full = full.groupBy("id", "body").agg(F.count("*").alias("times"))
    else:  # the same filter for both joins below, so that they read one exchange of these rows
        full = full.filter("id is not null")
    donors = full.select(F.col("id").alias("next"), "body").join(chain, "next").select("id", F.substring("body", F.lit(1), F.floor(F.col("size") / 3).cast("int")).alias("piece"), F.length("body").alias("of"))
    if repeats:
        donors = donors.groupBy("id").agg(F.max(F.struct("of", "piece")).alias("d")).select("id", "d.piece")
    n = F.length("body")
    cut = F.floor(n / 3).cast("int")
    both = full.join(donors.select("id", "piece"), "id", "left").withColumn("n_chars", n.cast("long"))
    both = both.withColumn("edited", F.concat(F.substring("body", F.lit(1), n - cut), F.substring(F.coalesce("piece", F.lit("")), F.lit(1), cut)))
    both = both if repeats else both.withColumn("times", F.lit(1).cast("long"))
    both = both.select("id", "n_chars", "times", F.sha2("edited", 256).alias("sha"), "body", "edited", *([F.xxhash64("body").alias("h")] if repeats else []))
    done = stored(fingerprints(both, ["id", "n_chars", "times", "sha", *(["h"] if repeats else [])], ["body", "edited"]), "fingerprints")
    of_next = done.filter("id is not null").groupBy("id").agg(F.max(F.struct("n_chars", "a0", "b0")).alias("d")) if repeats else done.filter("id is not null").select("id", F.struct("n_chars", "a0", "b0").alias("d"))
    after = chain.select("id", "next").join(of_next.select(F.col("id").alias("next"), F.col("d.a0").alias("a2"), F.col("d.b0").alias("b2")), "next").drop("next")
    out = done.join(after, "id", "left").withColumns({"a2": F.coalesce("a2", F.lit(0)), "b2": F.coalesce("b2", F.lit(0))})
    if repeats:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    out = out.select(
        F.col("id").alias(key),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("a0"), F.col("b0")).alias("fingerprint"),
        as_text(F.col("a1"), F.col("b1")).alias("edited_fingerprint"),
        likeness(F.col("a0"), F.col("b0"), F.col("a1"), F.col("b1")).alias("near_edited"),
        likeness(F.col("a0"), F.col("b0"), F.col("a2"), F.col("b2")).alias("near_next"),
    )
    asked = F.pmod(F.col(key).cast("long") if docs.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(key), F.lit(QUERY_STEP)) == 0
    all_prints = done.select(F.col("id").alias(key), as_text(F.col("a0"), F.col("b0")).alias("fingerprint"), *(["times"] if repeats else []))
    if repeats:
        all_prints = all_prints.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    near = near_counts(all_prints, asked, key=key, blocks=blocks_for(rows, RADIUS))
    named = near.select(F.col("fingerprint").alias("__asks"), "n_near")
    # rows that don't ask have keys of their own, which no fingerprint equals: nulls would all be dealt to one task
    own = F.concat(F.lit("-"), F.coalesce(F.col(key).cast("string"), F.col("edited_sha256")))
    return out.withColumn("__asks", F.when(asked, F.col("fingerprint")).otherwise(own)).join(named, "__asks", "left").drop("__asks")


def blocks_for(rows: int, radius: int, mates: int = 512) -> int:
    """The least number of blocks with which the bits of a table's key are so many that, of rows unrelated
    fingerprints, at most so many share a key.  The tables grow in number with it, and the search stays in proportion: with one query in QUERY_STEP rows,
    an entry that a table moves is compared with some ten."""
    need = math.log2(max(1, rows) / mates) if rows > mates else 0
    return next((b for b in range(radius + 1, BITS + 1) if BITS * (b - radius) / b >= need), BITS)


def _masks(ranges: list[tuple[int, int]]) -> list[Column]:
    """Two longs whose bits inside the ranges are set."""
    masks = [0, 0]
    for lo, hi in ranges:
        for bit in range(lo, hi):
            masks[bit // 64] |= 1 << (63 - bit % 64)
    return [F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks]


def _table_key(a: Column, b: Column, ranges: list[tuple[int, int]]) -> Column:
    """The key of a table as a struct of two longs: the halves with all bits outside the ranges cleared."""
    masks = _masks(ranges)
    return F.struct(a.bitwiseAND(masks[0]).alias("a"), b.bitwiseAND(masks[1]).alias("b"))


def block_matches(asked: DataFrame, classes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(asked's class x, classes' class y, bits) of all fingerprints within the radius of each other, by
    permuted block tables; both sides have (class, a, b), a pair of equal fingerprints is one of them.

    The bits are cut into blocks; every choice of ``blocks - radius`` of them is a table, keyed by the bits of
    its blocks.  Two fingerprints within the radius agree on all blocks of some table; a pair is taken from the
    first such table only.

    Both sides are dealt by key and sorted: by its size before it is repeated for every table, the planner would take the asked
    side for one that the driver can collect and send out.
    """
    if not 0 <= radius < blocks < 63:
        raise ValueError("the radius must be smaller than the number of blocks, which are 62 at most")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    number = lambda n: F.lit(n).cast("long")
    tables = [
        F.struct(number(sum(1 << i for i in kept)).alias("table"), number((2 << kept[-1]) - 1).alias("upto"), _table_key(F.col("a"), F.col("b"), [(edges[i], edges[i + 1]) for i in kept]).alias("key"))
        for kept in combinations(range(blocks), blocks - radius)
    ]
    keyed = lambda df, p: df.select(F.col("class").alias(p), F.col("a").alias(f"a{p}"), F.col("b").alias(f"b{p}"), F.explode(F.array(*tables)).alias("at")).select(p, f"a{p}", f"b{p}", "at.*")
    far = distance(F.col("ax"), F.col("bx"), F.col("ay"), F.col("by"))
    both = keyed(asked, "x").hint("merge").join(keyed(classes, "y").drop("upto"), ["table", "key"]).filter(far <= radius)
    # tables are in the order of their blocks, so the first one is that of the first blocks that agree; one term a block keeps
    # the code of the join short enough to be compiled
    same = number(0)
    for i, block in enumerate(zip(edges, edges[1:])):
        a, b = _masks([block])
        same = same + F.when(F.col("ax").bitwiseXOR(F.col("ay")).bitwiseAND(a).bitwiseOR(F.col("bx").bitwiseXOR(F.col("by")).bitwiseAND(b)) == 0, number(1 << i)).otherwise(number(0))
    first = same.bitwiseAND(F.col("upto")) == F.col("table")
    return both.filter(first).select("x", "y", far.cast("int").alias("bits"))


def _classes(fps: DataFrame, key: str, fp: str) -> tuple[DataFrame, DataFrame]:
    fps = fps.select(F.col(key).alias("id"), F.col(fp).alias("fp")).filter("id is not null and fp is not null")
    found = fps.groupBy("fp").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    return fps, found


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, key: str = "doc_id", fp: str = "fingerprint", blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All pairs of fingerprints within the radius, as (pairs, members).

    members has (key, class): class is the smallest key with the same fingerprint; pairs has (a, b, bits)
    for classes a < b whose fingerprints differ in at most radius bits.  Null keys and fingerprints are
    left out.  With more blocks keys are longer and tables more; radius + 1 unless given (see blocks_for).
    """
    fps, found = _classes(fps, key, fp)
    members = fps.join(found, "fp").select(F.col("id").alias(key), "class")
    sides = found.select("class", _half(F.col("fp"), False).alias("a"), _half(F.col("fp"), True).alias("b"))
    pairs = block_matches(sides, sides, radius, blocks or radius + 1).filter("x < y")
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "bits"), members


def near_counts(fps: DataFrame, asked: Column, radius: int = RADIUS, key: str = "doc_id", fp: str = "fingerprint", blocks: int | None = None) -> DataFrame:
    """(fp, n_near) for the fingerprints of the rows that asked, a condition on key, holds for: the number of rows,
    of all, whose fingerprint differs in at most radius bits, themselves included.

    The search of a stated query set against all rows; rows of equal fingerprints are one entry of the tables,
    with their number.  Null keys and fingerprints are left out.
    """
    fps, found = _classes(fps, key, fp)
    halves = (_half(F.col("fp"), False).alias("a"), _half(F.col("fp"), True).alias("b"))
    queries = fps.withColumnRenamed("id", key).filter(asked).select("fp").distinct().select(F.col("fp").alias("class"), *halves)
    entries = found.select(F.col("copies").alias("class"), *halves)
    near = block_matches(queries, entries, radius, blocks or radius + 1)
    return near.groupBy(F.col("x").alias(fp)).agg(F.sum("y").alias("n_near"))
