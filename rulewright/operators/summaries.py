"""Counts for reports: shares, totals, zero-filled cells, first rows of groups, and searches with their totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, percent): counts and their share of the group. The window runs over the counts, not the rows."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 1))


def with_total(rows: DataFrame, by: str, kind: str, kinds: Sequence[str], total: str = "TOTAL") -> DataFrame:
    """A row per value of by and one for all, with a count per kind and n."""
    counted = rows.rollup(by).agg(F.grouping(by).alias("__all"), *(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.count("*").alias("n"))
    return counted.select(F.when(F.col("__all") == 1, total).otherwise(F.col(by)).alias(by), *kinds, "n")


def zero_filled(rows: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, n) for every cell, also those without rows."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return cells.join(counts, by, "left").select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    """The first rows of each group. Spark cuts each map task's groups to them before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= top).drop("__n")


def first_found(rows: DataFrame, key: str, value: str, answers: Mapping[str, DataFrame], default: str, named: str) -> DataFrame:
    """rows with value and via: the first of the answers (each keyed, in order) that has one, else the row's own default."""
    joined = reduce(lambda df, x: df.join(x[1].select(key, F.col(value).alias(f"__{x[0]}")), key, "left"), answers.items(), rows)
    via = reduce(lambda c, name: c.when(F.col(f"__{name}").isNotNull(), name), answers, F.when(F.lit(False), "")).otherwise(named)
    return joined.select(*rows.columns, F.coalesce(*(F.col(f"__{a}") for a in answers), F.col(default)).alias(value), via.alias("via"))


def search(rows: DataFrame, aliases: Mapping[str, Sequence[str]], city: str, column: str, term: str, fields: Sequence[str], order: Sequence[str], top: int) -> tuple[DataFrame, DataFrame]:
    """The first rows of a city (by any of its names) with the term in one of the fields, and a row with the number of all."""
    names = [n.lower() for n in (city, *aliases.get(city, ()))]
    has = reduce(lambda a, b: a | b, (F.coalesce(F.lower(f).contains(term.lower()), F.lit(False)) for f in fields))
    found = rows.where(F.lower(column).isin(names) & has)
    return found.orderBy(*order).limit(top), found.agg(F.count("*").alias("total"))
