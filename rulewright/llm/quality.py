"""Quality rules: surface rules, then a hashed n-gram log-likelihood ratio.

Features are hashed words and word pairs. Two multinomials over the same buckets are counted: the raw
corpus (every document) and the trusted target (the documents labelled good and not toxic; with
``sample``, only as many, those with the smallest id hashes). A document's score is the mean over its
features of log p_target - log p_raw, in units of 2**-20 so that sums are exact; it passes at
``threshold`` or more. Counts are added up per task before the shuffle, which takes the table in PARTS
compressed rows of a task. The number of buckets grows with
the square root of the target's length, as its vocabulary does: with too few, junk shares the buckets of
good words; with too many for the target, good documents outside of it score like junk.

Defined results: a null or blank text has no words, fails the surface rules and scores 0; repeated rows
are counted and judged each by itself; without any trusted row every score is 0; a null id is judged
like any other row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, small_batches
from .words import Chunk, chunks, windows

#: Least bits of a bucket number, and buckets for the square root of the target's characters.
LEAST_BITS = 13
BUCKETS_PER_ROOT = 50
#: The table of counts is added up in so many parts, each a row of a task.
PARTS = 64
UNIT = 1 << 20
#: Characters that count as symbols.
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
#: A document's mean log-likelihood ratio must be at least this.
THRESHOLD = -0.1

_IS_SYMBOL = np.isin(np.arange(256), SYMBOLS)
_VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score_units long, n_features long"


def table_bits(target_chars: int) -> int:
    """Bits of a bucket number for a target of so many characters."""
    return max(LEAST_BITS, round(math.log2(BUCKETS_PER_ROOT * math.sqrt(max(target_chars, 1)))))


def _features(chunk: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and document of every feature, and the word hashes."""
    word = chunk.span_hash(chunk.start, chunk.end)
    pair, first = windows(word, chunk.doc, 2)
    feature = np.concatenate((word, pair)) >> np.uint64(64 - bits)
    return feature.astype(np.int64), np.concatenate((chunk.doc, chunk.doc[first] if len(first) else first)), word


def _parts(raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    """A row per part of the table that has a count: the counts as compressed 64-bit numbers."""
    rows = [(i, r, t) for i, (r, t) in enumerate(zip(np.split(raw, PARTS), np.split(target, PARTS), strict=True)) if r.any()]
    packed = [pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in side], pa.binary()) for side in ([r for _, r, _ in rows], [t for _, _, t in rows])]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], pa.int32()), *packed], ["part", "raw", "target"])


def _unpacked(counts: pa.BinaryScalar, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts.as_buffer(), 8 * size, "zstd"), np.int64)


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The counts of a task's rows, added up."""
    raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for batch in batches:
        trusted = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for chunk in chunks(batch.column(0)):
            feature, doc, _ = _features(chunk, bits)
            np.add.at(raw, feature, 1)
            np.add.at(target, feature[trusted[chunk.first + doc]], 1)
    yield _parts(raw, target)


def _sums(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The sums of the parts that a task gets, row by row: it holds one table at most, however many rows come."""
    raw, target, size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), (1 << bits) // PARTS
    for batch in batches:
        for i, r, t in zip(*batch.columns, strict=True):
            at = slice(i.as_py() * size, (i.as_py() + 1) * size)
            raw[at] += _unpacked(r, size)
            target[at] += _unpacked(t, size)
    yield _parts(raw, target)


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> np.ndarray:
    """Log-likelihood ratio of every bucket, in units. sample: most labelled rows that the target is fitted on, all if None."""
    small_batches(docs.sparkSession)
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    good = good if sample is None else good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(sample)
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    good = F.broadcast(good) if few else good
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.join(good, rows["doc_id"] == good["trusted_id"], "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    bits = table_bits(rows.where("trusted").agg(F.sum(F.length("text"))).first()[0] or 0)
    kind = "part int, raw binary, target binary"
    counted = rows.mapInArrow(lambda it: _counts(it, bits), kind).repartition("part").mapInArrow(lambda it: _sums(it, bits), kind)
    raw, target, size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), (1 << bits) // PARTS
    for i, r, t in zip(*counted.toArrow().columns, strict=True):  # PARTS rows at most
        at = slice(i.as_py() * size, (i.as_py() + 1) * size)
        raw[at], target[at] = _unpacked(r, size), _unpacked(t, size)
    if not target.sum():
        return np.zeros(len(raw), np.int32)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * len(raw))) - np.log((raw + 0.5) / (raw.sum() + 0.5 * len(raw)))
    return np.rint(ratio * UNIT).astype(np.int32)


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(chunk: Chunk) -> np.ndarray:
    """Per document: lines with a word, less the distinct ones."""
    edge = np.zeros(len(chunk.data) + 1, bool)
    edge[chunk.bounds] = True
    newline = chunk.data == 10
    start = np.flatnonzero(edge[:-1] | np.concatenate(([False], newline[:-1]))) if len(chunk.data) else np.empty(0, np.int64)
    end = np.flatnonzero(edge[1:] | newline)
    # a newline at a document's end closes a line and leaves an empty one, which has no word
    end = np.where(newline[end], end, end + 1) if len(end) else end
    words = np.concatenate(([0], np.cumsum(~chunk.blank)))
    some = words[end] > words[start]
    start, end = start[some], end[some]
    doc = np.searchsorted(chunk.bounds, start, "right") - 1
    line = chunk.span_hash(start, end)
    order = np.lexsort((line, doc))
    same = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=chunk.docs)


def _repeated(chunk: Chunk, word: np.ndarray) -> np.ndarray:
    """Per document: words covered by 3-word windows found twice or more in it."""
    window, first = windows(word, chunk.doc, 3)
    covered = np.zeros(len(word) + 3, bool)
    if len(first):
        doc = chunk.doc[first]
        order = np.lexsort((window, doc))
        w, d = window[order], doc[order]
        same = (w[1:] == w[:-1]) & (d[1:] == d[:-1])
        at = first[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
        for j in range(3):
            covered[at + j] = True
    return np.bincount(chunk.doc[covered[: len(word)]], minlength=chunk.docs)


def _verdicts(texts: pa.Array, ratio: np.ndarray) -> list[np.ndarray] | None:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score in units and n_features of every text."""
    parts = []
    for chunk in chunks(texts):
        feature, doc, word = _features(chunk, len(ratio).bit_length() - 1)
        score = np.zeros(chunk.docs, np.int64)
        np.add.at(score, doc, ratio[feature])
        code_points = (~chunk.blank) & ((chunk.data & 0xC0) != 0x80)
        parts.append([chunk.word_counts(), _per_doc(code_points, chunk.bounds), _per_doc(_IS_SYMBOL[chunk.data], chunk.bounds), _dup_lines(chunk), _repeated(chunk, word), score, np.bincount(doc, minlength=chunk.docs)])
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else None


def _judge(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _verdicts(batch.column(1), ratio)
        if found:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], [x.split()[0] for x in _VERDICT.split(", ")])


def _accept(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows that judge() keeps; the last column is the text as a string."""
    for batch in batches:
        found = _verdicts(batch.column(batch.num_columns - 1), ratio)
        if found:
            n_words, _, _, _, n_repeat, score, n = found
            base = (n_words < 50) | (100 * n_repeat > 50 * n_words)
            kept = ~base & (score / UNIT / np.maximum(n, 1) >= threshold)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1])).filter(pa.array(kept))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int | None = None) -> DataFrame:
    """doc_id, the surface counts, base_failed, score (mean log-likelihood ratio) and kept, per row of docs."""
    ratio = fit(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lambda it: _judge(it, ratio), _VERDICT)
    score = F.when(F.col("n_features") > 0, F.col("score_units") / F.lit(float(UNIT)) / F.col("n_features")).otherwise(F.lit(0.0))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*counts, base.alias("base_failed"), score.alias("score"), (~base & (score >= threshold)).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, columns as they came. Each row is judged by itself, whatever its id."""
    ratio = fit(docs, labels)
    rows = docs.select("*", F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(lambda it: _accept(it, ratio, threshold), docs.schema)
