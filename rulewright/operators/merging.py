"""Merging rule records: chains of merged records, and greedy clusters of compatible ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def follow(records: DataFrame, key: str, into: str) -> DataFrame:
    """(key, last): where each record's chain of ``into`` ends; null if it runs in a circle.

    Pointers are doubled: every round halves what is left of a chain, so as many rounds as the number of records has
    binary digits end all chains, and what still moves then runs in a circle. A pointer to no record ends the chain
    there. A round is kept until the next one has been computed from it.
    """
    pointers = records.select(key, F.coalesce(into, key).alias("last")).persist()
    moving = records.where(F.col(into).isNotNull() & (F.col(into) != F.col(key))).select(F.col(key).alias("last"), F.lit(True).alias("__open"))
    for _ in range(pointers.count().bit_length() + 1):
        ahead = pointers.select(F.col(key).alias("last"), F.col("last").alias("__next"))
        now = pointers.join(ahead, "last", "left").select(key, F.coalesce("__next", "last").alias("last"), F.col("last").alias("__was")).persist()
        done = now.where("last <> __was").isEmpty()
        now.count()
        pointers.unpersist()
        pointers = now
        if done:
            break
    return pointers.join(moving, "last", "left").select(key, F.when(F.col("__open").isNull(), F.col("last")).alias("last"))


def merge_clusters(rules: DataFrame, group: list[str], signature: str, value: str, effective: str, order: str) -> DataFrame:
    """rules with ``cluster``, the order value of the cluster's first record.

    Within a group and signature, records go in order to the first cluster all of whose members have an
    equal or missing value and an equal or missing effective date. A missing one is compatible with any, so
    the outcome depends on the order and a cluster cannot be found by key alone. Records that agree in
    everything compared always fall in one cluster, so only the first of each is sent to the greedy step:
    what a task holds is the number of different claims about one section of a law.
    """
    keys = [*group, signature]
    seen = rules.groupBy(*keys, value, effective).agg(F.min(order).alias("__first"))
    kinds = {f.name: f.dataType.simpleString() for f in seen.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, value, effective)) + f", cluster {kinds['__first']}"

    def greedy(claims: pd.DataFrame) -> pd.DataFrame:
        clusters: list[tuple[object, set, set]] = []
        names = []
        for first, v, d in claims.sort_values("__first")[["__first", value, effective]].itertuples(index=False):
            v, d = (None if pd.isna(x) else x for x in (v, d))
            for name, values, dates in clusters:
                if (v is None or values <= {v}) and (d is None or dates <= {d}):
                    break
            else:
                name, values, dates = first, set(), set()
                clusters.append((name, values, dates))
            values |= {v} - {None}
            dates |= {d} - {None}
            names.append(name)
        out = claims.sort_values("__first").drop(columns="__first")
        out["cluster"] = names
        return out

    found = seen.groupBy(*keys).applyInPandas(greedy, schema)
    on = [rules[c].eqNullSafe(found[c]) for c in (*keys, value, effective)]
    return rules.join(found, on).select(*(rules[c] for c in rules.columns), "cluster")
