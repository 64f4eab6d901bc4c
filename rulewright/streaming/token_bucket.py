"""Token bucket per key: requests in order, a capacity, and a refill rate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, PER_SECOND = 10.0, 10 / 60


def admit(times: list[float], tokens: float | None, last: float | None) -> tuple[list[bool], float, float | None]:
    """Which requests at the given seconds pass, and the state after them."""
    tokens, out = CAPACITY if tokens is None else tokens, []
    for t in times:
        tokens = min(CAPACITY, tokens + (t - (t if last is None else last)) * PER_SECOND)
        last = t
        out.append(tokens >= 1)
        tokens -= tokens >= 1
    return out, tokens, last


def decide(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """(key, order, allowed) for a batch: sorted partitions are read as a stream, so no key is held whole."""
    fields = f"{key} long, {order} long, allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = None, None, None
        for pdf in batches:
            parts = []
            for k, g in pdf.groupby(key, sort=False):
                tokens, last = (tokens, last) if k == now else (None, None)
                now = k
                ok, tokens, last = admit(g["__s"].tolist(), tokens, last)
                parts.append(pd.DataFrame({key: g[key].to_numpy(), order: g[order].to_numpy(), "allowed": ok}))
            if parts:
                yield pd.concat(parts)

    rows = events.where(F.col(key).isNotNull()).select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("__s"))
    return rows.repartition(key).sortWithinPartitions(key, "__s", order).mapInPandas(run, fields)


def stream(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """The same over a stream, with the bucket as state per key."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (None, None)
        pdf = pd.concat(list(frames)).sort_values(["__s", order])
        ok, tokens, last = admit(pdf["__s"].tolist(), tokens, last)
        state.update((float(tokens), float(last)))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": ok})

    rows = events.where(F.col(key).isNotNull()).select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("__s"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, allowed boolean", "tokens double, last double", "append", "NoTimeout")
