"""Best-fit packing by minimum bin slack.

Texts become token ids with a closing id 0; only documents longer than a sequence are cut. Which pieces
share a sequence depends on their lengths alone, so the plan is made from the histogram of lengths (one
count per length, at most ``size`` rows whatever the corpus): the largest length left seeds a bin, a
bitset subset-sum over the lengths still available finds the fullest feasible combination for the rest
of it, and that combination is repeated for as many bins as the counts allow, then removed. A piece
finds its place by its length and its rank among the pieces of that length; ranks are counted in salted
groups, so that a length that holds most pieces is spread out.

Defined results: a null or blank text is packed like any text (an empty one is the closing id alone);
repeated rows and null ids are packed row by row; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

SIZE = 2048
#: Texts with a run of twice as many characters without a change between blanks and others go to the tokenizer
#: itself: the faster encoder takes such a run as one piece, in time that grows with its square.
RUN = 1024
CLOSE = 0
_BLANK = re.compile(r"\s")
_PIECES = "doc_id long, piece int, start long, length long, ids binary"


@lru_cache(maxsize=2)
def _encoder(path: str, added: str | None = None):
    """Text to ids. added: a tokenizer file; its added tokens are then found in texts as tokenizers finds them."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {}
    if added:
        with open(added, encoding="utf-8") as f:
            tokens = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):  # what tiktoken cannot express
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(added)
            return lambda text: whole.encode(text, add_special_tokens=False).ids
        special = {t["content"]: t["id"] for t in tokens}
        ranks = {k: v for k, v in ranks.items() if v not in special.values()}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return (lambda text: encoding.encode(text, allowed_special="all")) if special else encoding.encode_ordinary


@lru_cache(maxsize=2)
def _tokenizer(path: str, plain: bool):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = plain
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def has_long_run(text: str) -> bool:
    """Is one of the stretches of RUN characters all blank, or free of blanks? Any run of 2 * RUN holds one."""
    cuts = (text[i : i + RUN] for i in range(0, len(text) - RUN + 1, RUN))
    return any(x.isspace() or not _BLANK.search(x) for x in cuts)


def vocabulary() -> str:
    """The vocabulary of byte_bpe_50k.json as ranks: the same ids, several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cut(batches: Iterator[pa.RecordBatch], path: str, size: int, added: str | None) -> Iterator[pa.RecordBatch]:
    encode = _encoder(path, added)
    slow = lambda text: _tokenizer(added or tokenizer_file(), not added)(text)
    for batch in batches:
        doc_ids, rows = batch.column(0).to_pylist(), []
        for doc_id, text in zip(doc_ids, batch.column(1).to_pylist(), strict=True):
            text = text or ""
            ids = np.array([*(slow if has_long_run(text) else encode)(text), CLOSE], "<u4")
            cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
            rows += [(doc_id, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None, added: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every piece of every document.

    The first piece of a document that is cut takes what is left over; the others are full. added: the
    tokenizer file whose added tokens get their ids; without it, their strings are ordinary text.
    """
    small_batches(docs.sparkSession)
    where = path or vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _cut(it, where, size, added), _PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most room: {length: times}.

    Bit s of the set says that some combination has the sum s; a length's copies are added in groups of
    1, 2, 4, ... so that any number of them can be taken.
    """
    reached, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left > 0:
            take = min(group, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & limit
            left, group = left - take, group * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_bins(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, bins, first bin, times in a bin, offset in the bin); bins in total follow.

    Pieces of a length take their ranks in order; within a row, rank r (from the first) is copy r % times
    of bin first + r // times.
    """
    counts, used, rows, made = {k: v for k, v in histogram.items() if v > 0}, dict.fromkeys(histogram, 0), [], 0
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        chosen = fullest(counts, size - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        bins, offset = min(counts[x] // n for x, n in chosen.items()), 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], bins, made, n, offset))
            used[length] += bins * n
            counts[length] -= bins * n
            offset += length * n
            if not counts[length]:
                del counts[length]
        made += bins
    return rows


def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (plan[:, 0] << 44) + plan[:, 1]
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        row = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
        at = rank - row[:, 1]
        names = [c for c in batch.schema.names if c != "rank"]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 3] + at // row[:, 4]), pa.array(row[:, 5] + at % row[:, 4] * length)], [*names, "sequence_id", "offset"])


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """parts (written; doc_id, piece, length and more columns) with sequence_id and offset."""
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per length
    plan = np.array(sorted(plan_bins(histogram, size)), np.int64).reshape(-1, 6)
    salts = max(16, max(histogram.values(), default=0) // 100_000)
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = before.select("length", "__salt", (F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    ranked = salted.withColumn("__row", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "__salt"]).select(*parts.columns, (F.col("__before") + F.col("__row") - 1).alias("rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(lambda it: _place(it, plan), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = True, added: str | None = None) -> DataFrame:
    """Pieces with their place; with_ids: the token ids too, else their CRC-32 only."""
    scratch = Scratch(docs.sparkSession, "packing")
    parts = pieces(docs, size, path, added)
    parts = parts if with_ids else parts.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(scratch.keep(parts, "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids: the sequences themselves; a group holds one sequence."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x")).select("sequence_id", F.expr("aggregate(x, cast('' as binary), (acc, p) -> concat(acc, p.ids))").alias("ids"))
