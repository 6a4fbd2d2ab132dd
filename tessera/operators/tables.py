"""Changes of whole tables: first of a key, deletion, merge, dedup, evolution, clustering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key; null is one key.

    The first place of each key is a pre-aggregated minimum, joined back, so that a key of very many
    rows is never gathered. ``order`` must tell rows apart.
    """
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    firsts = df.groupBy(key).agg(F.min(by).alias("__first")).select(F.col(key).alias("__key"), "__first")
    return df.join(firsts, df[key].eqNullSafe(F.col("__key")) & (by == F.col("__first")), "left_semi")


def later_duplicates(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The rows that ``keep_first`` drops."""
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    firsts = df.groupBy(key).agg(F.min(by).alias("__first")).select(F.col(key).alias("__key"), "__first")
    return df.join(firsts, df[key].eqNullSafe(F.col("__key")) & (by == F.col("__first")), "left_anti")


def drop_listed(df: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is not listed; this drops every row of a listed content, the first too."""
    return df.join(listed.select(on).distinct(), on, "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; unknown (null) keeps a row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def merge_update(target: DataFrame, source: DataFrame, on: str) -> DataFrame:
    """``target`` with all columns of ``source``: those of the row with the same key where there is
    one, else the old value or null. Keys of ``source`` must be unique (see ``assert_unique``)."""
    new = source.select(F.col(on).alias("__on"), F.lit(True).alias("__hit"), *[F.col(f"`{c}`").alias(f"__new_{c}") for c in source.columns if c != on])
    joined = target.join(new, target[on] == F.col("__on"), "left")

    def column(c: str) -> Column:
        old = target[f"`{c}`"] if c in target.columns else F.lit(None)
        return F.when(F.col("__hit"), F.col(f"`__new_{c}`")).otherwise(old).alias(c)

    names = [*target.columns, *[c for c in source.columns if c not in target.columns]]
    return joined.select(*[column(c) if c in source.columns and c != on else target[f"`{c}`"] for c in names])


def assert_unique(df: DataFrame, on: str) -> None:
    """ValueError if two rows have one key."""
    if df.groupBy(on).count().filter("count > 1").limit(1).count():
        raise ValueError(f"several rows have the same {on}")


def assert_same_count(a: DataFrame, b: DataFrame) -> None:
    """ValueError if two tables differ in their number of rows."""
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"row counts differ: {n} and {m}")


def append_evolving(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; columns that one lacks are null."""
    return a.unionByName(b, allowMissingColumns=True)


def cluster(df: DataFrame, by: str, partitions: int | None = None) -> DataFrame:
    """Rows in ranges of a column, sorted within each, so that scans skip by its minima and maxima."""
    dealt = df.repartitionByRange(partitions, by) if partitions else df.repartitionByRange(by)
    return dealt.sortWithinPartitions(by)


def runs(df: DataFrame, key: str, partition: Sequence[str], order: Sequence[str | Column], name: str = "run") -> DataFrame:
    """``df`` with the number of the contiguous run of equal keys that a row is in, from 0."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w) - 1).drop("__new")
