"""MinHash near-dedup with odd sketches.

One pass over whole texts makes, per document, the set of its shingle fingerprints, ``bands * rows``
MinHash samples over that set, a hash per band, and an odd sketch: each (sample number, sample) pair
flips one bit, so that the XOR of two sketches counts the samples in which two documents differ, and
``1 - d / k`` with ``d = -n/2 * ln(1 - 2 * popcount / n)`` estimates a high similarity closely.
Documents with equal sets form a class by their set digest and are represented by their smallest id.
Representatives that share a band are candidates (``clusters``), sketches reject the clearly
different ones (four standard deviations beyond the threshold), a parity bitmap over the whole set rejects
more without loss (its XOR counts at most the shingles that differ), and the rest are confirmed on their
full shingle sets.

Defined results: null and blank texts have an empty set and link with nothing; rows of one id
are one vertex (with unlike texts it is compared by the one of the smallest hash, and each of them joins its copies); a null id is never linked and has a null component; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import link_buckets, multiple
from .common import Scratch, small_batches, with_ids
from .words import FP_MASK, chunks, mix, shingle_sets

SKETCH_BITS = 256
#: Samples in a sketch for each one in the bands.
OVERSAMPLED = 1
#: Bits of the parity bitmap over a whole shingle set, whose XOR never counts more than the sets differ by.
PARITY_BITS = 2048
_ODD = [f"o{i}" for i in range(SKETCH_BITS // 64)]

_SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, parity array<long>, " + ", ".join(f"{o} long" for o in _ODD)


def _signatures(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(7)
    k = bands * rows * OVERSAMPLED
    times, plus = rng.integers(0, 1 << 62, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, k, dtype=np.uint64)
    for batch in batches:
        parts: list[list[np.ndarray]] = []
        for chunk in chunks(batch.column(2), lower=True):
            fp, doc = shingle_sets(chunk, words)
            n = np.bincount(doc, minlength=chunk.docs)
            has = np.flatnonzero(n)
            at = np.searchsorted(doc, has)
            set_a, set_b = np.zeros(chunk.docs, np.uint64), np.zeros(chunk.docs, np.uint64)
            band, odd = np.zeros((chunk.docs, bands), np.uint64), np.zeros((chunk.docs, len(_ODD)), np.uint64)
            if len(has):
                mixed = mix(fp)
                set_a[has], set_b[has] = np.add.reduceat(mixed, at), np.add.reduceat(mix(mixed + np.uint64(99)), at)
                for j in range(k):
                    low = np.minimum.reduceat((mixed * times[j] + plus[j]) >> np.uint64(32), at)
                    if j < bands * rows:
                        band[has, j // rows] = mix(band[has, j // rows] + low + np.uint64(j + 1))
                    bit = mix(low + np.uint64((j + 1) << 32)) & np.uint64(SKETCH_BITS - 1)
                    odd[has, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
            flips = np.bincount(doc * PARITY_BITS + (fp & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=chunk.docs * PARITY_BITS)
            parity = np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(chunk.docs, -1)
            parts.append([n, set_a.view(np.int64), set_b.view(np.int64), band.view(np.int64), odd.view(np.int64), parity, n > 0])
        if not parts:
            continue
        n, set_a, set_b, band, odd, parity, some = (np.concatenate(x) for x in zip(*parts, strict=True))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * x.shape[1]))).astype(np.int32)), pa.array(x[some].ravel()))  # noqa: B023, E731
        columns = [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(set_a), pa.array(set_b), lists(band), lists(parity), *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(len(_ODD)))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "parity", *_ODD])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _one_each(rows: DataFrame) -> DataFrame:
    """One row of each id, that of the smallest text hash: the same one wherever rows are picked."""
    order = Window.partitionBy("doc_id").orderBy("text_hash")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "text_hash")


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Set size and digest, band hashes and odd sketch of every document."""
    small_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(lambda it: _signatures(it, words, bands, rows), _SIGNATURE)


def _sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in chunks(texts, lower=True):
        fp, doc = shingle_sets(chunk, words)
        out += np.split(fp, np.searchsorted(doc, np.arange(1, chunk.docs)))
    return out


def _confirmed(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [100 * (same := len(np.intersect1d(x, y, assume_unique=True))) >= percent * (len(x) + len(y) - same) for x, y in zip(_sets(batch.column(2), words), _sets(batch.column(3), words), strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(hits, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def sketch_limit(percent: int, samples: int) -> int:
    """The most set bits in the XOR of two sketches: four standard deviations above the mean at the threshold.

    Each sample that differs flips a bit in either sketch, and bits flipped twice are not seen.
    """
    differ = 1 - percent / 100
    seen = math.exp(-4 * samples * differ / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - seen)
    spread = (2 * seen) ** 2 * samples * differ * (1 - differ) + mean * (1 - mean / SKETCH_BITS) / 4
    return math.ceil(mean + 4 * spread**0.5)


def sketch_distance(x: str, y: str) -> Column:
    bits = [F.bit_count(F.col(f"{x}{o}").bitwiseXOR(F.col(f"{y}{o}"))) for o in _ODD]
    return sum(bits[1:], bits[0])


def parity_allows(x: str, y: str, percent: int) -> Column:
    """Can two sets still be similar enough? Their sizes bound how much they may differ, the XOR shows part of it."""
    total, smaller = F.col(f"{x}n_shingles") + F.col(f"{y}n_shingles"), F.least(f"{x}n_shingles", f"{y}n_shingles")
    seen = F.aggregate(F.zip_with(f"{x}parity", f"{y}parity", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, n: acc + n)
    return (100 * smaller >= percent * (total - smaller)) & (seen * (100 + percent) <= total * (100 - percent))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 21, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Documents link when 100 * |A and B| >= percent * |A or B| over distinct word shingles. A pair just
    at 85 % is missed by all 21 bands of 6 rows with a probability of 8e-5.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    sig = scratch.keep(signatures(docs, words, bands, rows), "signatures")
    digest = ["n_shingles", "set_a", "set_b"]
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    reps = scratch.keep(sig.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *digest], "left_semi").transform(_one_each), "representatives")
    members = multiple(reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node")), scratch)
    nodes = scratch.keep(members.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    texts = scratch.keep(_one_each(with_ids(_texts(docs), nodes, "doc_id")), "texts")
    limit = sketch_limit(percent, bands * rows * OVERSAMPLED)
    marks = ["n_shingles", "parity", *_ODD]
    side = lambda key, name: reps.select(F.col("doc_id").alias(key), *(F.col(o).alias(name + o) for o in marks))

    def alike(x: str, y: str) -> Column:
        return (sketch_distance(x, y) <= limit) & parity_allows(x, y, percent)

    def confirm(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(alike("x", "y")).select("a", "b")
        full = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirmed(it, words, percent), "a long, b long")

    def may_link(x: str, y: str) -> Column:
        shared = F.array_min(F.array_intersect(f"{x}.bands", f"{y}.bands"))
        return alike(f"{x}.", f"{y}.") & (shared == F.col(f"{x}.key"))

    marked = reps.select(F.col("doc_id").alias("node"), "bands", *marks)
    labels, _ = link_buckets(members, confirm, scratch, lambda nodes: with_ids(marked, nodes, "node"), may_link)
    scratch.drop(reps, members, nodes, texts)
    named = classes.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*digest, F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", *digest).join(named, digest, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the smallest id of each group; columns as they came."""
    verdict = near_duplicates(docs, words, percent)
    gone = verdict.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
