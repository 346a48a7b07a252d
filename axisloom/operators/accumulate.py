"""An axis grown term by term over stored running sums.

The features are a table bucketed by key, and every version of the axis is another: for each row, the sum of its valid
terms so far and their number.  Adding a term joins the last version with one feature, bucket by bucket, so nothing is
shuffled and no earlier term is evaluated again; taking terms back drops versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON
from ..functions.transforms import clean, transform
from .axis import Axis, Term


class AxisAccumulator:
    """Versions of one axis over df, whose key column holds no null and no value twice.

    Tables go to the session's warehouse under names of their own until close().
    """

    def __init__(self, df: DataFrame, key: str, features: list[str], buckets: int | None = None, epsilon: float = EPSILON):
        self.spark, self.key, self.features, self.epsilon = df.sparkSession, key, features, epsilon
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"axisloom_{uuid.uuid4().hex}"
        self.terms: list[Term] = []
        self._save(df.select(key, *features), "base")

    def _save(self, df: DataFrame, what: str) -> None:
        # one file a bucket: rows are dealt by the hash that buckets go by
        df.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").mode("overwrite").saveAsTable(f"{self.name}_{what}")

    def _table(self, what: str | int) -> DataFrame:
        return self.spark.table(f"{self.name}_{what}")

    @property
    def axis(self) -> Axis:
        return Axis(tuple(self.terms))

    def step(self, term: Term) -> DataFrame:
        """(key, total, valid) with one more term: what add() stores."""
        c = transform(clean(F.col(term.feature)), term.transform, self.epsilon)
        c = -c if term.sign < 0 else c
        add, known = F.coalesce(c, F.lit(0.0)), c.isNotNull().cast("int")
        own = self._table("base").select(self.key, term.feature)
        if not self.terms:
            return own.select(self.key, add.alias("total"), known.alias("valid"))
        before = self._table(len(self.terms)).hint("merge")
        return own.join(before, self.key).select(self.key, (F.col("total") + add).alias("total"), (F.col("valid") + known).alias("valid"))

    def add(self, term: Term) -> AxisAccumulator:
        following = self.step(term)
        self.terms.append(term)
        following.write.bucketBy(self.buckets, self.key).sortBy(self.key).format("parquet").mode("overwrite").saveAsTable(f"{self.name}_{len(self.terms)}")
        return self

    def rollback(self, terms: int = 1) -> AxisAccumulator:
        """Takes the last terms back."""
        if not 0 <= terms <= len(self.terms):
            raise ValueError(f"{terms} of {len(self.terms)} terms")
        for _ in range(terms):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{len(self.terms)}")
            self.terms.pop()
        return self

    def values(self) -> DataFrame:
        """(key, value, valid) of the axis as it is: NULL without a valid term."""
        if not self.terms:
            return self._table("base").select(self.key, F.lit(None).cast("double").alias("value"), F.lit(0).alias("valid"))
        n: Column = F.lit(len(self.terms)) / F.nullif("valid", F.lit(0))
        return self._table(len(self.terms)).select(self.key, F.nanvl(F.col("total") * n, F.lit(None).cast("double")).alias("value"), "valid")

    def close(self) -> None:
        self.rollback(len(self.terms))
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_base")
