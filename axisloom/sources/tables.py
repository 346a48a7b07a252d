"""Sources: numeric tables with a label, and label dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.transforms import clean


#: Cells that count as missing in a CSV file.
MISSING = ("", "na", "nan", "null", "none", "n/a")


def _number(c: str, kind: str) -> Column:
    """A cell as a number; missing ones are NULL, anything else that is no number is an error."""
    cell = F.trim(F.col(c))
    bad = F.raise_error(F.concat(F.lit(f"column {c}: not a number: "), cell)).cast(kind)
    return F.when(cell.isNull() | F.lower(cell).isin(*MISSING), F.lit(None).cast(kind)).otherwise(F.coalesce(cell.try_cast(kind), bad))


def read_csv(spark: SparkSession, path: str, features: list[str], label: str | None = None, name: str | None = None) -> DataFrame:
    """A CSV file with a header: features as double, label as long, name as string; no schema inference.

    Raises ValueError for missing feature columns; a cell that is neither a number nor missing fails the read.
    """
    raw = spark.read.option("header", True).csv(path)
    check_columns(raw, features)
    cols = [_number(f, "double").alias(f) for f in features]
    if label and label in raw.columns:
        cols.append(_number(label, "bigint").alias(label))
    if name and name in raw.columns:
        cols.append(F.col(name))
    return raw.select(*cols)


def from_rows(spark: SparkSession, rows, features: list[str], label: str = "cls") -> DataFrame:
    """A small in-memory matrix whose last column is the label, as a table of doubles and a long."""
    data = [(*map(float, r[:-1]), None if r[-1] is None else int(r[-1])) for r in rows]
    return spark.createDataFrame(data, ", ".join([*(f"`{f}` double" for f in features), f"`{label}` long"]))


def demo_table(spark: SparkSession, rows: int = 100, features: int = 10, classes: int = 2, seed: int = 42) -> DataFrame:
    """A seeded table of normal features f0, f1, ... whose first two are shifted by the class, for trying things out."""
    ids = spark.range(rows).withColumn("cls", (F.col("id") % classes).cast("int"))
    shift = lambda j: F.lit(3.0) * F.col("cls") if j < 2 else F.lit(0.0)
    return ids.select("id", *[(F.randn(seed + j) + shift(j)).alias(f"f{j}") for j in range(features)], "cls")


def read_dictionary(spark: SparkSession, path: str, value: str = "bigint") -> DataFrame:
    """(name, value) of a JSON object of one level."""
    text = spark.read.option("wholetext", True).text(path)
    kind = f"map<string,{value}>"
    return text.select(F.explode(F.from_json("value", kind)).alias("name", "value"))


def check_columns(df: DataFrame, needed: list[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def feature_table(df: DataFrame, features: dict[str, str] | list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Features as doubles with NaN as NULL (a dict renames), and the columns in keep."""
    names = features if isinstance(features, dict) else {f: f for f in features}
    check_columns(df, [*names.values(), *keep])
    return df.select(*[clean(F.col(c)).alias(n) for n, c in names.items()], *keep)


def label_dictionary(df: DataFrame, label: str) -> DataFrame:
    """(label, cls): distinct known labels, numbered from 0 in order."""
    found = df.select(F.col(label).alias("label")).filter("label is not null").distinct()
    return found.withColumn("cls", (F.row_number().over(W.orderBy("label")) - 1).cast("int"))


def with_class(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    """df with cls, -1 where the label isn't in the dictionary.

    The dictionary goes to the tasks: a row of it is a class, and rows dealt by a few labels would crowd into as many tasks.
    """
    side = F.broadcast(dictionary.select(F.col("label").alias("__label"), "cls"))
    return df.join(side, F.col(label) == F.col("__label"), "left").drop("__label").withColumn("cls", F.coalesce("cls", F.lit(-1)))


def with_names(df: DataFrame, cls: str, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """df with the name of its class, 'Unknown (id)' where there is none."""
    side = F.broadcast(dictionary.select(F.col("cls").alias("__cls"), F.col("label").cast("string").alias(name)))
    out = df.join(side, F.col(cls) == F.col("__cls"), "left").drop("__cls")
    return out.withColumn(name, F.coalesce(name, F.concat(F.lit("Unknown ("), F.col(cls).cast("string"), F.lit(")"))))


def unmapped(df: DataFrame, name: str, dictionary: DataFrame, key: str = "name") -> DataFrame:
    """Distinct names without an entry in the dictionary."""
    return df.select(F.col(name).alias("name")).filter("name is not null").distinct().join(dictionary.select(F.col(key).alias("name")), "name", "left_anti")


def with_colours(df: DataFrame, colours: DataFrame, name: str = "name", default: str = "red") -> DataFrame:
    side = F.broadcast(colours.select(F.col("name").alias("__name"), F.col("value").alias("colour")))
    return df.join(side, F.col(name) == F.col("__name"), "left").drop("__name").withColumn("colour", F.coalesce("colour", F.lit(default)))


def open_rows(cls: str = "cls", pred: str = "pred") -> Column:
    """Labelled rows that no rule has predicted."""
    return (F.col(cls) >= 0) & (F.coalesce(F.col(pred), F.lit(-1)) < 0)


#: Schema of points as they are exported.
POINT = T.StructType([T.StructField("PC1", T.DoubleType()), T.StructField("PC2", T.DoubleType()), T.StructField("label", T.StringType())])
