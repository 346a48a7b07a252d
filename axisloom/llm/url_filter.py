"""URL filters by dated lists: validity intervals and an as-of join.

A list is a log of dated entries: (entry, kind, action, at), where entry is a host suffix or a host and
path prefix, kind is ``host`` or ``path``, and action is ``block``, ``allow`` or ``remove``.  The actions on one
entry become intervals, each valid from its date until the entry's next date.  A capture is matched at
its fetch time with every entry in force whose host suffix or path prefix its URL has; the most specific
one decides (path before host, then the longer), and ``allow`` wins a tie.

Captures are reduced to (key, fetch time) before the join, and keys that no list entry has go by an
inner join on the key, so a hot host costs one narrow row a capture; the planner splits its partition
(the join is an inner join straight on two exchanges) or broadcasts the list where it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Host of an http(s) URL, lower-cased, without user, port and a final dot; NULL if there is none."""
    h = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def path(url: Column) -> Column:
    """Path of a URL with its leading slash, '/' if it has none."""
    p = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def keys(h: Column, p: Column, depth: int) -> Column:
    """All list entries that a URL can match, as structs (kind, key): its host suffixes, and its host with
    every path prefix that ends at a slash or at the path's end, of at most depth segments."""
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    upto = F.least(F.size(parts), F.lit(depth))
    prefixes = F.transform(
        F.when(upto > 0, F.sequence(F.lit(1), F.greatest(upto, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.lit("path").alias("kind"), F.concat(h, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key")),
    )
    return F.concat(suffixes, prefixes)


def intervals(log: DataFrame) -> DataFrame:
    """(kind, key, action, since, until) of a log (entry, kind, action, at): until is exclusive, NULL while in
    force.  Entries are compared lower-cased (host part) without a final slash or dot; of actions on the
    same entry at the same time the last in the order allow, block, remove holds.  Rows with a null are
    ignored."""
    entry = F.regexp_replace(F.trim("entry"), r"[./]+$", "")
    cut = F.instr(entry, "/")
    key = F.when(cut > 0, F.concat(F.lower(F.expr("substring_index(regexp_replace(trim(entry), '[./]+$', ''), '/', 1)")), F.substring(entry, cut, F.length(entry)))).otherwise(F.lower(entry))
    log = log.filter("entry is not null and kind in ('host', 'path') and action in ('allow', 'block', 'remove') and at is not null").select("kind", key.alias("key"), "action", "at")
    last = log.groupBy("kind", "key", "at").agg(F.max("action").alias("action"))
    spans = last.withColumn("until", F.lead("at").over(W.partitionBy("kind", "key").orderBy("at")))
    return spans.filter("action <> 'remove'").select("kind", "key", "action", F.col("at").alias("since"), "until")


def judged(captures: DataFrame, log: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row per capture: (key, url, fetched_at, blocked, rule, rule_action, rule_since).

    rule is the deciding entry, NULL if none is in force at the fetch time; blocked says whether its action is
    block.  Null and unparsable URLs and null fetch times match nothing.  Captures that repeat (same key,
    URL and time) each get the same judgement.  Empty tables give an empty result or no matches.
    """
    spans = intervals(log)
    # no prefix longer than the list's deepest path can match
    depth = spans.filter("kind = 'path'").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    rows = captures.select(F.col(key).alias("id"), F.col(url).alias("u"), F.col(fetched).alias("f"))
    at = rows.filter("u is not null and f is not null").select("id", "u", "f", host(F.col("u")).alias("h"), path(F.col("u")).alias("p")).filter("h is not null")
    asked = at.select("id", "u", "f", F.explode(keys(F.col("h"), F.col("p"), depth)).alias("k")).select("id", "u", "f", "k.kind", "k.key")
    hit = asked.join(spans, ["kind", "key"]).filter((F.col("since") <= F.col("f")) & (F.col("until").isNull() | (F.col("f") < F.col("until"))))
    rank = F.struct((F.col("kind") == "path").cast("int").alias("path"), F.length("key").alias("size"), (F.col("action") == "allow").cast("int").alias("allow"), "key", "action", "since")
    best = hit.groupBy("id", "u", "f").agg(F.max(rank).alias("best"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("u") == F.col("u2")) & (F.col("f") == F.col("f2"))
    out = rows.join(best.toDF("id2", "u2", "f2", "best"), same, "left")
    return out.select(
        F.col("id").alias(key),
        F.col("u").alias(url),
        F.col("f").alias(fetched),
        F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
        F.col("best.key").alias("rule"),
        F.col("best.action").alias("rule_action"),
        F.col("best.since").alias("rule_since"),
    )


def allowed(captures: DataFrame, log: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures, with all their columns, that no entry in force at their fetch time blocks."""
    verdicts = judged(captures, log, key, url, fetched).filter("blocked").select(F.col(key).alias("__k"), F.col(url).alias("__u"), F.col(fetched).alias("__f")).distinct()
    return captures.join(verdicts, F.col(key).eqNullSafe(F.col("__k")) & (F.col(url) == F.col("__u")) & (F.col(fetched) == F.col("__f")), "left_anti")
