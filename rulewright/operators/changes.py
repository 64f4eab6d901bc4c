"""Tests of what a change reaches, and what is still to come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def affected(results: DataFrame, place: str, address: str, wanted: list[str], result: str = "result", flag: str = "flag") -> DataFrame:
    """(place, affected, flagged): addresses with one of the wanted results, and those of them with a conflict flag."""
    hits = results.groupBy(place, address).agg(F.bool_or(F.col(result).isin(wanted)).alias("__hit"), F.bool_or(flag).alias("__flag"))
    return hits.groupBy(place).agg(F.count_if("__hit").alias("affected"), F.count_if(F.col("__hit") & F.col("__flag")).alias("flagged"))


def pending(results: DataFrame, owner: str, rule: str, effective: str, result: str = "result") -> DataFrame:
    """(owner, rule, effective, place) of rules that are not in force yet, numbered by date."""
    place = F.row_number().over(Window.partitionBy(owner).orderBy(effective, rule))
    return results.where(F.col(result).isin("pending", "not_yet_effective")).select(owner, rule, effective, place.cast("long").alias("place"))
