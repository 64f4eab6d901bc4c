"""What may be sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 100_000


def small(rows: DataFrame, most: int = MOST) -> DataFrame:
    """rows marked to be broadcast if a count shows that they are at most ``most``; else as they are, to be shuffled."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
