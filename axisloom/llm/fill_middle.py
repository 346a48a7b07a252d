"""Fill-in-middle transformation by escaped marker injection.

A delimiter is escaped in the text, regexp_replace appends it after every unit, its count is the number of units,
and substring_index takes the parts by rank; parts are unescaped and assembled with the markers.  Everything is
built-in functions on one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter and the character that escapes both.
DELIMITER, ESCAPE = "\x01", "\x02"
#: Units as regular expressions over the escaped text, in which an escaped character is two.
UNITS = {
    "char": rf"(?s){ESCAPE}[ed]|.",
    "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+",
    "line": r"[^\n]*\n|[^\n]+",
}
MARKERS = ("<P>", "<S>", "<M>")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _part(text: Column) -> Column:
    return unescaped(F.replace(text, F.lit(DELIMITER), F.lit("")))


def split_parts(df: DataFrame, text: str, first: Column, second: Column, unit: str = "char", n: str = "n") -> DataFrame:
    """df with n units and the columns prefix, middle and suffix of text (null: empty): first(n) and second(n), columns
    over n and the others of df, are the numbers of units after which prefix and middle end.

    unit is a key of UNITS or a regular expression of one group-free unit over the escaped text whose matches cover it.
    """
    injected = F.regexp_replace(escaped(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({UNITS.get(unit, unit)})"), F.lit("$1" + DELIMITER))
    out = df.withColumn("__injected", injected)
    out = out.withColumn(n, (F.length("__injected") - F.length(F.replace("__injected", F.lit(DELIMITER), F.lit("")))).cast("long"))
    out = out.withColumns({"__a": first.cast("int"), "__b": second.cast("int")})
    out = out.withColumn("__head", F.call_function("substring_index", "__injected", F.lit(DELIMITER), F.col("__b")))
    prefix = F.call_function("substring_index", "__injected", F.lit(DELIMITER), F.col("__a"))
    middle = F.call_function("substring_index", "__head", F.lit(DELIMITER), F.col("__a") - F.col("__b"))
    suffix = F.when(F.col("__b") < F.col(n), F.call_function("substring_index", "__injected", F.lit(DELIMITER), (F.col("__b") - F.col(n) - 1).cast("int"))).otherwise(F.lit(""))
    return out.withColumns({"prefix": _part(prefix), "middle": _part(middle), "suffix": _part(suffix)}).drop("__injected", "__head", "__a", "__b")


def draw(key: Column, k: int, seed: int = 1) -> Column:
    """The k-th group of 8 hex digits, from 0, of sha256 of ``<seed>:<key>`` as an unsigned number; a null key is
    written ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", share: int = 90, spm_share: int = 20, seed: int = 1, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(key, text, n, form, prefix, middle, suffix, output) of every row of docs.

    Two draws of the row's key cut its n units into prefix, middle and suffix.  form is ``plain`` (output is the text)
    for empty texts, texts that hold a marker, and 100 - share percent of the rest; else ``spm`` for spm_share percent
    (suffix, prefix, middle) and ``psm`` (prefix, suffix, middle).  Of plain rows the parts are null.

    A null text counts as empty; a null key is drawn as ``null``; rows that repeat a key and text give equal outputs;
    other columns of docs are ignored, whatever their names.  An empty table gives no rows.
    """
    p, s, m = markers
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    h = [F.col(f"__h{k}") for k in range(4)]
    rows = rows.withColumns({f"__h{k}": draw(F.col("__key"), k, seed) for k in range(4)})
    cuts = (h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1))
    rows = split_parts(rows, "__text", F.least(*cuts), F.greatest(*cuts), unit)
    has = F.lit(False)
    for x in markers:
        has = has | F.contains("__text", F.lit(x))
    plain = (F.col("n") == 0) | has | (h[2] % 100 >= share)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spm_share, "spm").otherwise("psm"))
    is_plain = F.col("form") == "plain"
    whole = F.when(is_plain, F.col("__text")).when(F.col("form") == "spm", F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
    rows = rows.withColumn("output", whole.otherwise(F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")))
    kept = [F.when(~is_plain, F.col(c)).alias(c) for c in ("prefix", "middle", "suffix")]
    return rows.select(F.col("__key").alias(key), F.col("__text").alias(text), "n", "form", *kept, "output")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text of an output, by its form: every marker stands in it once."""
    p, s, m = markers
    after = lambda c, x: F.call_function("substring_index", c, F.lit(x), F.lit(-1))
    before = lambda c, x: F.call_function("substring_index", c, F.lit(x), F.lit(1))
    middle = after(output, m)
    psm = F.concat(after(before(output, s), p), middle, after(before(output, m), s))
    spm = F.concat(after(before(output, m), p), middle, after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): what fill_in_middle by code points makes
    of every row, and the digest of the text rebuilt from output and form."""
    made = fill_in_middle(docs, key, text, seed=seed)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(key, "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
