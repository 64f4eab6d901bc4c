"""Vectorised word, shingle and line fingerprints over Arrow string columns.

A text is a sequence of bytes; words are runs without ASCII white space (0x20, 0x09-0x0D). All
functions take whole texts and work on a chunk of documents at once with numpy, so that no Python
code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; one longer document makes a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Documents in a chunk; a fingerprint shares 64 bits with the document's number in the chunk.
CHUNK_DOCS = 1024
FP_BITS = 54
FP_MASK = np.uint64((1 << FP_BITS) - 1)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1
_P_INV = pow(_P, -1, 1 << 64)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Documents first..first+docs of a batch: their bytes, and the words as byte ranges."""

    first: int
    docs: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    blank: np.ndarray

    def span_hash(self, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums() if sums is None else sums
        _, down = _power(len(self.data) + 1)
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def sums(self) -> np.ndarray:
        up, _ = _power(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=out[1:])
        return out

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)


def chunks(texts: pa.Array, lower: bool = False) -> Iterator[Chunk]:
    """Cut a string column into chunks. Null counts as empty. lower: A-Z become a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        most = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1
        to = min(max(at + 1, most), at + CHUNK_DOCS, len(texts))
        bounds = offsets[at : to + 1] - offsets[at]
        data = raw[offsets[at] : offsets[to]]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        blank = (data == 0x20) | ((data >= 9) & (data <= 13))
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        word = ~blank
        start = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], blank[:-1]))))
        end = np.flatnonzero(word & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
        doc = np.searchsorted(bounds, start, "right") - 1
        yield Chunk(at, to - at, data, bounds, start, end, doc, blank)
        at = to


def windows(word_hash: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside a document, and the index of each one's first word."""
    if len(word_hash) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(word_hash) - n + 1
    first = np.flatnonzero(doc[:m] == doc[n - 1 :])
    total = np.zeros(len(first), np.uint64)
    for j in range(n):
        total += word_hash[first + j] * _STEP[j]
    return mix(total), first


def shingle_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, document) of the distinct n-word shingles, sorted by document, then fingerprint.

    A document with 1..n-1 words has its whole word sequence as the only shingle.
    """
    word_hash = chunk.span_hash(chunk.start, chunk.end)
    shingle, first = windows(word_hash, chunk.doc, n)
    owner = chunk.doc[first] if len(first) else first
    counts = chunk.word_counts()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begins = np.searchsorted(chunk.doc, short)
        extra = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = counts[short] > j
            extra[has] += word_hash[begins[has] + j] * _STEP[j]
        shingle, owner = np.concatenate((shingle, mix(extra + counts[short].astype(np.uint64)))), np.concatenate((owner, short))
    key = np.sort((owner.astype(np.uint64) << np.uint64(FP_BITS)) | (shingle >> np.uint64(64 - FP_BITS)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key & FP_MASK, (key >> np.uint64(FP_BITS)).astype(np.int64)
