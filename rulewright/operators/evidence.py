"""Hash-chained evidence: every link holds its predecessor's hash. A null text reads as an empty one; of links of one order the smaller text is first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def link_hashes(events: DataFrame, chain: str, order: str, text: str) -> DataFrame:
    """events with sha (of predecessor's text, ':' and own text) and prev_sha (the predecessor's sha)."""
    w = Window.partitionBy(chain).orderBy(order, text)
    own = F.coalesce(text, F.lit(""))
    sha = F.sha2(F.concat(F.coalesce(F.lag(own).over(w), F.lit("")), F.lit(":"), own), 256)
    linked = events.withColumn("sha", sha)
    return linked.withColumn("prev_sha", F.lag("sha").over(w))


def chain_status(links: DataFrame, chain: str, order: str, text: str, claimed: str, claimed_prev: str) -> DataFrame:
    """links with valid: own hash and link are right, and so were all before it."""
    w = Window.partitionBy(chain).orderBy(order, text)
    true = link_hashes(links, chain, order, text)
    good = (F.col(claimed) == F.col("sha")) & F.col(claimed_prev).eqNullSafe(F.col("prev_sha"))
    return true.withColumn("valid", F.min(good.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def rollup(signatures: DataFrame, chain: str, role: str, valid: str, required: list[str]) -> DataFrame:
    """(chain, valid_roles, overall) of signatures with a verdict each.

    overall: invalidated if any is not valid, signed if each required role has a valid one, partial if some have, else pending.
    """
    has = lambda r: F.bool_or((F.col(role) == r) & F.col(valid)).cast("int")
    rows = signatures.groupBy(chain).agg(F.bool_and(valid).alias("__all"), sum((F.coalesce(has(r), F.lit(0)) for r in required[1:]), F.coalesce(has(required[0]), F.lit(0))).cast("long").alias("valid_roles"))
    overall = F.when(~F.col("__all"), "invalidated").when(F.col("valid_roles") == len(required), "signed").when(F.col("valid_roles") > 0, "partial").otherwise("pending")
    return rows.select(chain, "valid_roles", overall.alias("overall"))
