"""Rule status at a date, and what changes between dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_at(as_of: Column, stage: Column, enacted: Column, sunset: Column, first_effective: Column) -> Column:
    """failed, pending, not_yet_effective or in_force; an enacted rule without effective date is in force."""
    return (
        F.when(stage == "failed", "failed").when(stage == "pending", "pending").when(enacted > as_of, "pending")
        .when(sunset <= as_of, "failed").when(first_effective > as_of, "not_yet_effective").otherwise("in_force")
    )


def effective_at(rows: DataFrame, keys: list[str], date: str, as_of: Column) -> DataFrame:
    """Latest effective date up to as_of, else the earliest after; ambiguous if dates lie on both sides."""
    past = F.max(F.when(F.col(date) <= as_of, F.col(date)))
    return rows.groupBy(*keys).agg(F.coalesce(past, F.min(date)).alias("effective"), ((F.min(date) <= as_of) & (F.max(date) > as_of)).alias("ambiguous"))


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str, missing: str = "omitted") -> DataFrame:
    """Keys whose value differs between two answers, with both values; missing where one has no such key, null where it has no value."""
    side = lambda df, name: df.select(*keys, F.struct(F.col(value).cast("string").alias("v")).alias(name))
    both = side(before, "before").join(side(after, "after"), keys, "full_outer")
    told = lambda name: F.when(F.col(name).isNull(), missing).otherwise(F.col(f"{name}.v")).alias(name)
    return both.select(*keys, told("before"), told("after")).where("not before <=> after")


def timeline(facts: DataFrame, status: Column, days: Column) -> DataFrame:
    """facts with d, before and after: each of their days (an array) on which the status is not that of the day before.

    status reads the column as_of. Both days are decided in the row itself, so nothing is shuffled.
    """
    each = facts.withColumn("d", F.explode(F.array_distinct(days)))
    at = lambda rows, day, name: rows.withColumn("as_of", day).withColumn(name, status)
    return at(at(each, F.date_sub("d", 1), "before"), F.col("d"), "after").drop("as_of").where("before <> after")
