"""Rule records: stable ids, duplicate handling, rule-set differences, record store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_ids(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """rows with rule_id: the group's parts and a number by order, of two digits or as many as it takes."""
    n = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("rule_id", F.concat_ws("-", *groups, F.format_string("H%02d", n)))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def poison_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with ok: false for every row of a key that occurs more than once. The count is made before the join."""
    many = rows.groupBy(*key).agg((F.count("*") == 1).alias("ok"))
    return rows.join(many, key)


def compare_sets(base: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): new, modified or removed records."""
    pack = lambda df, name: df.select(key, F.struct(*fields).alias(name))
    both = pack(base, "old").join(pack(new, "now"), key, "full_outer")
    change = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("now")), "modified")
    return both.select(key, change.alias("change")).where("change is not null")


def latest(records: DataFrame, key: str, version: list[str]) -> DataFrame:
    """The newest record of each key, as a map-side maximum rather than a window over all versions."""
    rest = [c for c in records.columns if c != key and c not in version]
    top = records.groupBy(key).agg(F.max(F.struct(*version, *rest)).alias("__top"))
    return top.select(key, *(F.col(f"__top.{c}").alias(c) for c in (*version, *rest)))
