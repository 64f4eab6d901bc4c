"""Centroid clustering of embeddings: weighted dedup, then Lloyd rounds over distinct vectors in whole numbers.

Vectors are quantised to floor(UNITS * x) and equal ones grouped with their multiplicity, so that copies cost a
map-side count and no round reads a vector twice. Each round is one pass over the written distinct vectors:
numpy finds the nearest centroid of a batch and a task returns K rows of weighted sums, which Spark adds up as
decimals; only K x WIDTH sums come to the driver, for the exact floor(sum / count). At the end assignments join
back to the ids by a 128-bit hash of the vector. A vector with a thousandth of all rows or more (at most 1,000
such vectors exist) is joined by broadcast, so no copy group meets in one task; the others are shuffled.

Defined results: rows whose vector is null, has another length or holds a null or a non-finite component are left
out; rows of one id are vectors of their own; a null id is clustered, but starts a centroid only if fewer than
K vectors have an id; with fewer than K vectors there are as many centroids, without any no rows come out. A
component of 2**27 units or more in size, or 2**36 rows, would not fit the sums of 64 bits and raises an error.
Ties go to the smaller centroid, equal start hashes to the smaller vector; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

K, ROUNDS, WIDTH, UNITS, SEED = 8, 10, 64, 1024, 3
LIMIT, MOST_ROWS = 1 << 27, 1 << 36
#: A vector with more than a HEAVY-th of all rows is joined by broadcast; there are at most HEAVY of them.
HEAVY = 1000
#: Vectors compared at a time in a task.
BLOCK = 8192


def quantised(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, vector) of the rows with width finite components: floor(UNITS * x) as int."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where((F.size("x") == width) & F.forall("x", finite))
    too_large = F.exists("x", lambda x: F.abs(x) * UNITS >= LIMIT - 1)
    whole = F.transform("x", lambda x: F.floor(x * UNITS).cast("int"))
    return rows.select("vec_id", F.when(too_large, F.raise_error(F.lit("a component does not fit the sums")).cast("array<int>")).otherwise(whole).alias("vector"))


def _key(vector: Column) -> list[Column]:
    """Two hashes with different seeds: n distinct vectors have a collision with a probability of n*n / 2**129."""
    return [F.xxhash64(vector).alias("key1"), F.xxhash64(F.lit(SEED), vector).alias("key2")]


def distinct(rows: DataFrame) -> DataFrame:
    """(vector, weight): every distinct vector and its number of rows."""
    return rows.groupBy("vector").agg(F.count("*").alias("weight"))


def start(rows: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in that order."""
    named = rows.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [list(r.vector) for r in named.orderBy(F.asc_nulls_last("hash"), "vector").limit(k).collect()]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            yield batch, batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (the smaller of equal ones) and the squared distance."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = far.argmin(axis=1)
    return at.astype(np.int32), far[np.arange(len(x)), at]


def _round(table: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after one round over (vector, weight)."""
    held = np.array(centroids, np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(held), width + 1), np.int64)
        for batch, x in _blocks(batches, width):
            at, weight = nearest(x, held)[0], batch.column("weight").to_numpy()
            for c in np.unique(at):
                mine = at == c
                sums[c] += np.append(weight[mine] @ x[mine], weight[mine].sum())
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(held)), pa.int32()), "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    parts = table.mapInArrow(partial, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "value"))
    total = {(r.cluster, r["at"]): int(r.value) for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    move = lambda c: [total[c, j] // total[c, width] for j in range(width)] if total.get((c, width)) else centroids[c]
    return [move(c) for c in range(len(centroids))]


def _assigned(table: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    held = np.array(centroids, np.int64).reshape(-1, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, width):
            at, far = nearest(x, held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)], [*batch.schema.names, "cluster", "distance"])

    return table.mapInArrow(assign, "vector array<int>, weight long, cluster int, distance long").select(*_key(F.col("vector")), "weight", "cluster", "distance")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    rows = quantised(vectors, width)
    table = scratch.keep(distinct(rows), "distinct")
    count = table.agg(F.sum("weight")).first()[0] or 0
    if count >= MOST_ROWS:
        raise ValueError("too many rows for sums of 64 bits")
    centroids = start(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        moved = _round(table, centroids, width)
        if moved == centroids:  # later rounds would change nothing
            break
        centroids = moved
    known = scratch.keep(_assigned(table, centroids, width), "assigned")
    inertia = {r.cluster: int(r.s) for r in known.groupBy("cluster").agg(F.sum(F.col("weight").cast("decimal(19,0)") * F.col("distance")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = F.broadcast(spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    keyed = rows.select("vec_id", *_key(F.col("vector")))
    heavy = (F.col("weight") * HEAVY > count).alias("heavy")
    split = known.select("key1", "key2", "cluster", "distance", heavy)
    first = keyed.join(F.broadcast(split.where("heavy").drop("heavy")), ["key1", "key2"], "left")
    rest = keyed.join(F.broadcast(split.where("heavy").select("key1", "key2")), ["key1", "key2"], "left_anti").join(split.where("not heavy").drop("heavy"), ["key1", "key2"])
    out = first.where("cluster is not null").select("vec_id", "cluster", "distance").union(rest.select("vec_id", "cluster", "distance"))
    return out.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = K, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED) -> str:
    """The clustering of embeddings as DuckDB SQL, a few steps a round."""
    steps = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({UNITS} * x::double)::bigint) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        f"d AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM e)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v)::int - 1 AS c FROM e QUALIFY c < {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, (arg_min(c, (f, c))) AS c, min(f) AS f FROM (SELECT r, c, sum((x - y) * (x - y))::bigint AS f FROM d JOIN c{i} USING (j) GROUP BY r, c) GROUP BY r)")
        if i < rounds:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, j, coalesce(m, y) AS y FROM c{i} LEFT JOIN (SELECT c, j, (sum(x) - (sum(x) % count(*) + count(*)) % count(*))::hugeint // count(*) AS m FROM d JOIN a{i} USING (r) GROUP BY c, j) USING (c, j))")
    steps.append(f"t AS (SELECT c, sum(f)::bigint AS s FROM a{rounds} GROUP BY c)")
    steps.append(f"h AS (SELECT c, sha256(string_agg(y::bigint::varchar, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"WITH {', '.join(steps)} SELECT vec_id, c AS cluster, f AS distance, t.s AS cluster_inertia, (SELECT sum(s) FROM t)::bigint AS inertia, centroid_sha256 FROM e JOIN a{rounds} USING (r) JOIN t USING (c) JOIN h USING (c)"
