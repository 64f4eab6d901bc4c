"""LM scoring by a subword lattice: the marginal probability of a text over all its segmentations.

A text is its lower-cased words and one end. The pieces of an existing byte-level vocabulary are its unigrams:
their probabilities are the counts (plus one) in the vocabulary's own segmentation of the training words, each
with a blank before it. A word's probability is the sum over all ways to cut blank and word into pieces, found
by a forward recursion in log space; no piece goes over the end of a word, so a text's probability is the
product of its words' and the end's, and each different word of the corpus runs through the recursion once.

1. Every document becomes a bag of its different words (numpy in Arrow batches), written once.
2. Bags add up to the table of different words: training count, documents, lattice probability.
3. Words that hold more than a WORD_SHARE-th of all bag rows (so at most WORD_SHARE of them) meet the bags by
   broadcast, the others by a shuffle on the word; sums per document are whole units of 2**-36, so their order
   does not matter.

The table of words grows with the corpus and stays distributed; the driver holds the counts of the pieces only.

Defined results: a null or blank text is one end; a null id reads as an empty one, which is a training document;
repeated rows and rows of one id are documents of their own; words are runs of other bytes than 0x20 and
0x09-0x0D, only A-Z are lower-cased; without any training document all counts are 0; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .packing import RUN, _encoder, _tokenizer, tokenizer_file, vocabulary
from .words import CHUNK_BYTES, Chunk, chunks

MODULUS, HELD_OUT = 7, 2
UNIT = 1 << 36
#: Words with more than this part of all bag rows are joined by broadcast.
WORD_SHARE = 50_000
#: Bytes of words, times positions, that the recursion works on at a time.
CELLS = 1 << 16
_BAG = "row long, doc_id long, held_out boolean, n_tokens long, bag array<struct<word: string, n: int>>"


def _chunk(data: np.ndarray) -> Chunk:
    none = np.empty(0, np.int64)
    return Chunk(0, 0, data, none, none, none, none, none)


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges start..end of data as a string column."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at].tobytes())).cast(pa.string())


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column("text"), lower=True):
            mine = batch.slice(chunk.first, chunk.docs)
            word = chunk.span_hash(chunk.start, chunk.end)
            order = np.lexsort((word, chunk.doc))
            word, doc = word[order], chunk.doc[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(word))).astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=chunk.docs)))).astype(np.int32)
            words = _gather(chunk.data, chunk.start[order[first]], chunk.end[order[first]])
            bag = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([words, pa.array(count)], ["word", "n"]))
            tokens = pa.array(chunk.word_counts().astype(np.int64) + 1)
            yield pa.RecordBatch.from_arrays([mine.column("row"), mine.column("doc_id"), mine.column("held_out"), tokens, bag], ["row", "doc_id", "held_out", "n_tokens", "bag"])


def bags(docs: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT) -> DataFrame:
    """row, doc_id, held_out, n_tokens, bag of every document. row numbers hold once the result is written."""
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rest = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"), (rest == held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_bags, _BAG)


def _large(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, by rows and bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= CHUNK_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    """The pieces of a rank file by id."""
    import base64

    with open(path, "rb") as f:
        by_id = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    return [by_id[i] for i in range(len(by_id))]


def piece_counts(words: DataFrame, path: str, tokenizer: str) -> dict[int, int]:
    """How often the vocabulary's segmentation of the words (word, count) has each piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = _encoder(path), np.zeros(len(_pieces(path)), np.int64)
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("count").to_pylist(), strict=True):
                ids = (_tokenizer(tokenizer, True) if len(word) >= RUN else encode)(" " + word)
                for i in ids if len(ids) < 64 else ():
                    total[i] += n
                if len(ids) >= 64:
                    total += np.bincount(ids, minlength=len(total)) * n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["piece", "n"])

    return {r.piece: r.n for r in words.mapInArrow(count, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}


class Lattice:
    """Forward recursion over pieces with given log probabilities (natural)."""

    def __init__(self, pieces: list[bytes], weight: np.ndarray):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        end = np.cumsum(size)
        hashes = _chunk(data).span_hash(end - size, end)
        self.tables = []
        for n in np.unique(size):
            mine = np.flatnonzero(size == n)
            order = mine[np.argsort(hashes[mine])]
            self.tables.append((int(n), hashes[order], weight[order]))

    def _same_length(self, chunk: Chunk, sums: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """Log probabilities of the byte ranges of one length."""
        alpha = np.full((length + 1, len(start)), -np.inf)
        alpha[0] = 0
        step = max(1, CELLS // len(start))
        for first in range(1, length + 1, step):
            last = min(first + step, length + 1)
            found = []
            for n, table, weight in self.tables:
                if n >= last:
                    break
                ends = np.arange(max(first, n), last)
                to = start[None, :] + ends[:, None]
                hashes = chunk.span_hash(to - n, to, sums)
                at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
                hit = table[at] == hashes
                if hit.any():
                    cells = np.full((last - first, len(start)), -np.inf)
                    cells[ends[0] - first :] = np.where(hit, weight[at], -np.inf)
                    found.append((n, cells))
            sizes = np.array([n for n, _ in found])
            stack = np.stack([cells for _, cells in found])
            for e in range(first, last):
                k = int(np.searchsorted(sizes, e, "right"))
                ways = alpha[e - sizes[:k]] + stack[:k, e - first]
                top = ways.max(axis=0)
                alpha[e] = top + np.log(np.exp(ways - top).sum(axis=0))
        return alpha[length]

    def log_probability(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The log of the sum over all segmentations of each word, with a blank before it."""
        raw = [b" " + (w.encode() if isinstance(w, str) else w) for w in (words.to_pylist() if isinstance(words, pa.Array) else words)]
        chunk = _chunk(np.frombuffer(b"".join(raw), np.uint8))
        sums, size = chunk.sums(), np.array([len(w) for w in raw], np.int64)
        start = np.cumsum(size) - size
        out = np.empty(len(raw))
        for n in np.unique(size):
            mine = np.flatnonzero(size == n)
            for at in range(0, len(mine), CELLS // 16):
                part = mine[at : at + CELLS // 16]
                out[part] = self._same_length(chunk, sums, start[part], int(n))
        return out


def word_table(words: DataFrame, weight: np.ndarray, path: str) -> DataFrame:
    """words (word, count, docs) with units: their log10 probability in UNITs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(_pieces(path), weight)
        for batch in _large(batches):
            units = np.rint(lattice.log_probability(batch.column("word")) / math.log(10) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(units)], [*batch.schema.names, "units"])

    return words.mapInArrow(run, "word string, count long, docs long, units long")


def score(docs: DataFrame, modulus: int = MODULUS, held_out: int = HELD_OUT, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words, add one) and score (lattice), log10.

    Learns from the documents whose crc32(doc_id as text) mod modulus is not held_out; scores all.
    """
    spark = docs.sparkSession
    path, tokenizer = path or vocabulary(), tokenizer or tokenizer_file()
    scratch = Scratch(spark, "lattice")
    held = scratch.keep(bags(docs, modulus, held_out), "bags")
    each = held.select("row", "held_out", F.inline("bag"))
    words = each.groupBy("word").agg(F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("n"))).alias("count"), F.count("*").alias("docs"))
    words = scratch.keep(words, "words")
    ends = held.where("not held_out").count()
    sums = words.agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v"), F.sum("docs").alias("rows")).first()
    total, kinds, rows = (sums.n or 0) + ends, sums.v + (ends > 0), sums.rows or 0

    seen = piece_counts(words.where("count > 0").select("word", "count"), path, tokenizer)
    size = len(_pieces(path)) + 1  # the pieces and the end
    over = math.log(sum(seen.values()) + ends + size)
    weight = np.array([math.log(seen.get(i, 0) + 1) for i in range(size - 1)]) - over
    end_score = (math.log(ends + 1) - over) / math.log(10)

    table = scratch.keep(word_table(words, weight, path), "scored")
    common = (F.col("docs") * WORD_SHARE > rows).alias("common")
    about = table.select("word", "count", F.round(F.log10(F.col("count") + 1) * UNIT).cast("long").alias("base"), "units", common)
    often = F.broadcast(about.where("common").drop("common"))
    plain = each.select("row", "word", "n")
    met = plain.join(often, "word").union(plain.join(F.broadcast(about.where("common").select("word")), "word", "left_anti").join(about.where("not common").drop("common"), "word").select("word", "row", "n", "count", "base", "units"))
    exact = lambda c: F.sum((F.col("n") * F.col(c)).cast("decimal(19,0)")).cast("double") / UNIT
    per_row = met.groupBy("row").agg(F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("known"), exact("base").alias("base"), exact("units").alias("marginal"))
    out = held.select("row", "doc_id", "held_out", "n_tokens").join(per_row, "row", "left")
    zero: Column = F.lit(0.0)
    base = F.coalesce("base", zero) + math.log10(ends + 1) - F.col("n_tokens") * math.log10(total + kinds + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.coalesce("marginal", zero) + end_score).alias("score"),
    )
