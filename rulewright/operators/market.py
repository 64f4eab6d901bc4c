"""Honest price figures: none below a minimum sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SAMPLE = 3


def price_summary(listings: DataFrame, keys: list[str], rent: str) -> DataFrame:
    """Count, minimum, exact median and maximum of usable rents per key; figures from LEAST_SAMPLE rows on."""
    value = F.expr(f"try_cast({rent} as double)")
    usable = listings.withColumn("__rent", value).where("__rent > 0 and not isnan(__rent)")
    figure = lambda c: F.when(F.count("*") >= LEAST_SAMPLE, F.round(c, 3))
    return usable.groupBy(*keys).agg(F.count("*").alias("n"), figure(F.min("__rent")).alias("low"), figure(F.median("__rent")).alias("median"), figure(F.max("__rent")).alias("high"))
