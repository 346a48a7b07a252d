"""Mixing sources to target weights by capped water-filling.

Sources get weights; together they share a budget of words.  A source's target is its weight's share of
the budget, clamped at ``max_epochs`` times its size, and what a clamp frees is shared by weight among
the others until none is above its clamp.  The clamped sources are a prefix of the sources ordered by
clamp over weight, so the fixed point is one window over the table of sources.

A document of a source with rate ``target / size`` is taken ``floor(rate)`` times whole.  The fraction
left over is a seeded draw: documents are ordered by a keyed digest of their id and taken once more until
the source's target is met to the word; only the document where the line falls is taken in part.  Rows that
repeat an id and a size are drawn as a unit, and where the line falls in one they share its words evenly.
The order is never sorted as a whole: sizes are summed by source and leading digits of the digest; two
steps of 256 cells find the cell in which the line falls, and only that one's ids are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, word_count

#: Hex digits of the digest that a step looks at (16**2 cells a source), and those that make a cell.
STEP_DIGITS, CELL_DIGITS = 2, 4


def _digest(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"|{seed}")).cast("binary"))


def water_fill(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size) with weight and target.

    Sources are ordered by code point, null last, and take the weights in turn, repeating.  If the clamps
    together hold less than the budget, every source stops at its clamp.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs))).withColumn("budget", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
    order = W.orderBy(F.col("clamp") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = ranked.withColumn("left", F.col("budget") - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    ranked = ranked.withColumn("clamped", F.col("clamp") * F.col("open") <= F.col("left") * F.col("weight"))
    # after the first source that isn't clamped none is; all of them split what is left there
    rest = F.first(F.when(~F.col("clamped"), F.struct("left", "open")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = ranked.withColumn("rest", rest)
    return ranked.select("source", "source_size", "weight", F.when(F.col("clamped"), F.col("clamp")).otherwise(F.col("rest.left") * F.col("weight") / F.col("rest.open")).alias("target"))


def _line(parts: DataFrame, place: list[str], size: str) -> DataFrame:
    """(source, edge): of parts (source, place, size, room) in order of place, the one in which the running sum of
    size passes the room, with the room that is left in it; a source whose parts all fit has no row."""
    order = W.partitionBy("source").orderBy(*place)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = parts.withColumn("left", F.col("room") - before).filter(f"left >= 0 and left < {size}")
    return at.groupBy(F.col("source").alias("s")).agg(F.min(F.struct(*place, *[c for c in parts.columns if c not in ("source", "room", *place)], F.col("left").alias("room"))).alias("edge"))


def _of(df: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """df joined with a table of sources, s, in which null is a source; broadcast where it is small."""
    return df.join(F.broadcast(side) if _small(side) else side, F.col("source").eqNullSafe(F.col("s")), how).drop("s")


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document row: (key, size, source_size, target, taken, repeats, part) and the columns in keep.

    size counts the words of the text (null: 0), taken the words that the mix takes, repeats how often the
    document is taken whole and part the words of one further, partial repetition.  taken is
    ``repeats * size + part`` and at most ``max_epochs * size`` rounded up to a whole repetition's words.
    Documents without words are never taken.  Null sources are a source of their own, null keys one key.  Rows
    that repeat a key in one source and size share its draw; where the line falls among them they are taken
    alike, and the source may then miss its target by less than a word for each of them.  The same rows and
    seed give the same mix however they are partitioned.  An empty table gives an empty result.
    """
    digest = _digest(F.col(key), seed)
    sized = docs.select(F.col(key).alias("__key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), digest.alias("digest"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    narrow = sized.select("source", "size", "digest")
    cells = stored(narrow.groupBy("source", F.substring("digest", 1, CELL_DIGITS).alias("cell")).agg(F.sum("size").alias("words")), "cells")
    plan = water_fill(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    # whole repetitions, and the words that are left for one more of some documents
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("extra", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")), "plan")
    steps = cells.groupBy("source", F.substring("cell", 1, STEP_DIGITS).alias("step")).agg(F.sum("words").alias("words"))
    step = _line(_of(steps, plan.select(F.col("source").alias("s"), F.col("extra").alias("room"))), ["step"], "words")
    inside = _of(cells, step).filter(F.substring("cell", 1, STEP_DIGITS) == F.col("edge.step"))
    cell = stored(_line(inside.select("source", "cell", "words", F.col("edge.room").alias("room")), ["cell"], "words"), "edge")
    # the ids of the one cell of each source in which the line falls, rows of one id and size as a unit
    inside = _of(narrow, cell).filter(F.substring("digest", 1, CELL_DIGITS) == F.col("edge.cell"))
    units = inside.groupBy("source", "digest", "size").agg(F.count("*").alias("rows"), F.max("edge.room").alias("room")).withColumn("words", F.col("size") * F.col("rows"))
    stop = stored(_line(units.select("source", "digest", "size", "rows", "words", "room"), ["digest", "size"], "words"), "stop")
    side = plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "extra").join(stop.select(F.col("s").alias("s2"), F.col("edge").alias("stop")), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    full = _of(sized, stored(side, "plan"))
    mine, stops = F.struct("digest", "size"), F.struct(F.col("stop.digest").alias("digest"), F.col("stop.size").alias("size"))
    # without a stop all rows fit, or none is wanted
    again = F.when(F.col("stop").isNull(), (F.col("extra") > 0).cast("int")).when(mine < stops, 1).otherwise(0)
    part = F.when(F.col("stop").isNotNull() & (mine == stops), F.floor(F.col("stop.room") / F.col("stop.rows"))).otherwise(0).cast("long")
    full = full.withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + again).otherwise(0).cast("long")).withColumn("part", part)
    return full.select(
        F.col("__key").alias(key),
        F.col("size"),
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"),
        "repeats",
        "part",
        *[F.col(f"__keep_{c}").alias(c) for c in keep if c != key],
    )


def _small(df: DataFrame, limit: int = 100_000) -> bool:
    """Whether a table of sources has at most limit rows."""
    return df.limit(limit + 1).count() <= limit


def materialised(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **how) -> DataFrame:
    """The mixed corpus itself: every row of docs as often as the mix takes it, with docs' columns.

    A partial repetition keeps the text up to its last taken word, and its n_chars.
    """
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # what docs calls its columns can clash with nothing
    how = {"source": "source"} | how
    full = mixed(docs.withColumnsRenamed(names), names[key], names[text], keep=tuple(c for c in names.values() if c != names[key]), **how | {"source": names[how["source"]]})
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("repeats").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))
    out = full.select(*names.values(), F.explode(copies).alias("words"))
    own = names[text]
    cut = F.expr(f"array_join(slice(filter(split(`{own}`, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), 1, cast(words as int)), ' ')")
    out = out.withColumn(own, F.when(F.col("words") >= 0, cut).otherwise(F.col(own)))
    if n_chars in names:
        at = names[n_chars]
        out = out.withColumn(at, F.when(F.col("words") >= 0, F.length(own).cast(docs.schema[n_chars].dataType)).otherwise(F.col(at)))
    return out.select(*[F.col(v).alias(c) for c, v in names.items()])
