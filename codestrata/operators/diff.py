"""Keyed difference of two tables, and its application.

Rows are compared by the hash-partitioned key alone; a change is told by the payload as one struct, null-safe. Keys must be unique; use
``dedupe_first`` where they may not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key. A key may be as frequent as it likes: a partial minimum goes before the shuffle."""
    cols = [c for c in df.columns if c not in key]
    rank = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    return df.groupBy(*key).agg(F.min_by(F.struct(*cols), rank).alias("__row")).select(*key, "__row.*") if cols else df.distinct()


def diff(old: DataFrame, new: DataFrame, key: list[str], payload: list[str] | None = None) -> DataFrame:
    """(key, change_type, old_<payload>, new_<payload>) of all rows that were added, deleted or modified."""
    payload = payload or [c for c in new.columns if c not in key]
    o = old.select(*key, F.struct(*payload).alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(*key, F.struct(*payload).alias("__new"), F.lit(True).alias("__in_new"))
    both = o.join(n, key, "full_outer")
    kind = F.when(F.col("__in_old").isNull(), "ADD").when(F.col("__in_new").isNull(), "DELETE").when(~F.col("__old").eqNullSafe(F.col("__new")), "MODIFY")
    out = both.withColumn("change_type", kind).where("change_type IS NOT NULL")
    return out.select(*key, "change_type", *[F.col(f"__old.{c}").alias(f"old_{c}") for c in payload], *[F.col(f"__new.{c}").alias(f"new_{c}") for c in payload])


def summary(delta: DataFrame, by: list[str] | None = None) -> DataFrame:
    return delta.groupBy(*(by or []), "change_type").agg(F.count("*").alias("n"))


def apply(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """``base`` after ``delta``: touched keys go, added and modified rows come. apply(old, diff(old, new)) == new."""
    payload = [c for c in base.columns if c not in key]
    untouched = base.join(delta.select(*key), key, "left_anti")
    fresh = delta.where("change_type <> 'DELETE'").select(*key, *[F.col(f"new_{c}").alias(c) for c in payload])
    return untouched.select(*key, *payload).unionByName(fresh).select(*base.columns)


def missing_keys(base: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Deleted or modified keys that the base doesn't have: such a delta belongs to another base."""
    return delta.where("change_type <> 'ADD'").select(*key).join(base.select(*key), key, "left_anti")


def remove_by_key(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key), key, "left_anti")


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side`` left or right; repeated rows count as often as they are surplus."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows surplus on either side, and whether the tables are equal as multisets. One shuffle: signed counts by row."""
    cols = a.columns
    signed = a.withColumn("__n", F.lit(1)).unionByName(b.select(*cols).withColumn("__n", F.lit(-1)))
    net = signed.groupBy(*cols).agg(F.sum("__n").alias("__n"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("__n") > 0, F.col("__n"))), F.lit(0)).cast("long").alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("__n") < 0, -F.col("__n"))), F.lit(0)).cast("long").alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def first_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Like ``dedupe_first``, as a window; for keys of few rows, where all columns are to keep their places."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__rn = 1").drop("__rn")
