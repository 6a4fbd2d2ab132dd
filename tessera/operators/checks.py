"""Existence, completeness and uniqueness, as joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals(keys: Mapping[str, Any], null_matches: bool = False) -> Column:
    """All columns equal their values. A value None matches nothing, or null with ``null_matches``."""
    if not keys:
        raise ValueError("no keys")
    parts = [F.col(c).isNull() if v is None and null_matches else F.col(c) == F.lit(v) for c, v in keys.items()]
    return reduce(lambda a, b: a & b, parts)


def among(filters: Mapping[str, Sequence[Any]]) -> Column:
    """Each column is one of its values; ValueError for an empty list or none."""
    for c, values in filters.items():
        if isinstance(values, (str, bytes)) or not isinstance(values, (list, tuple, set, frozenset)) or not values:
            raise ValueError(f"filter for {c} must be a list of values that isn't empty")
    return reduce(lambda a, b: a & b, [F.col(c).isin(list(v)) for c, v in filters.items()], F.lit(True))


def exists(df: DataFrame, keys: Mapping[str, Any]) -> bool:
    """Whether a row has these values."""
    return bool(df.filter(equals(keys)).limit(1).count())


def mark_existing(expected: DataFrame, df: DataFrame, on: Sequence[str], flag: str = "found") -> DataFrame:
    """``expected`` with a flag for the keys that ``df`` has; null keys are never found."""
    there = df.select(*on).distinct().withColumn("__there", F.lit(True))
    return expected.join(there, list(on), "left").withColumn(flag, F.coalesce("__there", F.lit(False))).drop("__there")


def split_complete(expected: DataFrame, df: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct expected keys that ``df`` has, and those it lacks."""
    keys = expected.select(*on).distinct()
    return keys.join(df.select(*on), list(on), "left_semi"), keys.join(df.select(*on), list(on), "left_anti")


def unique_rows(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows whose key no other row has."""
    single = df.groupBy(*on).agg(F.count("*").alias("__n")).filter("__n = 1").select(*on)
    return df.join(single, list(on), "left_semi")


def the_row(df: DataFrame, keys: Mapping[str, Any]) -> dict[str, Any]:
    """The only row with these values; ValueError for an unknown column, none or several."""
    if not keys:
        raise ValueError("no keys")
    if unknown := set(keys) - set(df.columns):
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    found = df.filter(equals(keys)).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"Expected exactly 1 row, found {'none' if not found else 'several'}")
    return found[0].asDict()


def first_row(df: DataFrame, keys: Mapping[str, Any], order: Sequence[Column | str] = ()) -> dict[str, Any] | None:
    """A row with these values, the first by ``order`` if given."""
    found = df.filter(equals(keys))
    rows = (found.orderBy(*order) if order else found).limit(1).collect()
    return rows[0].asDict() if rows else None


def project(df: DataFrame, required: Sequence[str], more: str | Sequence[str] | None = None, filters: Mapping[str, Sequence[Any]] | None = None) -> DataFrame:
    """Required and further columns of the rows that pass the filters; ValueError for unknown ones."""
    more = [more] if isinstance(more, str) else list(more or [])
    if unknown := (set(required) | set(more) | set(filters or {})) - set(df.columns):
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    columns = [c for c in df.columns if c in {*required, *more}]
    return (df.filter(among(filters)) if filters else df).select(*columns)
