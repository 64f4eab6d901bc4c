"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>role newline text <|im_end|> newline`` and read back by a strict
parser that knows the grammar only: a turn must start with the opening mark, its role ends at the first
newline, its text ends at the first closing mark, and no control string may stand inside. Text goes in as
it is if the parser gives back exactly the turn; otherwise its control strings are escaped (a backslash
after the first character, added to any already there, so that unescaping is exact) until it does.
Turns are rendered row by row. A conversation is its turns in order with nothing between, and is read
back whole, as a stream of text: the parser finds the turns and the loss mask in it by itself.

Defined results: a null role or text counts as empty; rows of a conversation go by turn (nulls first),
then by rendered text, and repeated rows stay; null conversation ids are one conversation; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings with a meaning in chat templates; none may stand unescaped in a text.
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROLS))
_ESCAPABLE = re.compile("|".join(f"{re.escape(x[0])}\\\\*{re.escape(x[1:])}" for x in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(x[0])}\\\\+{re.escape(x[1:])}" for x in CONTROLS))


def escape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def parse_turn(segment: str) -> tuple[str, str, int, int]:
    """role, text and the text's place in the rendered turn; ValueError if it isn't one turn of the grammar."""
    if not (segment.startswith(OPEN) and segment.endswith(f"{CLOSE}\n")):
        raise ValueError("not a turn")
    line = segment.find("\n")
    to = len(segment) - len(CLOSE) - 1
    if not len(OPEN) <= line < to:
        raise ValueError("no role line")
    role, text = segment[len(OPEN) : line], segment[line + 1 : to]
    if _CONTROL.search(role) or _CONTROL.search(text) or segment.find(CLOSE) != to:
        raise ValueError("a control string inside a turn")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)
    return role, unescape(text), line + 1, to


def render_turn(role: str, text: str) -> str:
    """The turn's text, escaped only as far as its way back needs."""
    name = role.replace("\\", "\\\\").replace("\n", "\\n")
    for who, what in ((name, text), (name, escape(text)), (escape(name), escape(text))):
        segment = f"{OPEN}{who}\n{what}{CLOSE}\n"
        try:
            if parse_turn(segment)[:2] == (role, text):
                return segment
        except ValueError:
            pass
    raise ValueError("a turn that the grammar cannot hold")


_RENDERED = "conv_id long, turn long, segment string, mask_start int, mask_end int"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        segments, starts, ends = [], [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            segment = render_turn(role or "", text or "")
            _, _, a, b = parse_turn(segment)
            segments.append(segment)
            starts.append(a if role == "assistant" else b)
            ends.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(segments, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [x.split()[0] for x in _RENDERED.split(", ")])


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, segment, mask_start, mask_end: rendered turns and the part that a loss applies to.

    A conversation's text is its segments in order of turn and segment, with nothing between.
    """
    small_batches(conversations.sparkSession)
    c = lambda name, kind: F.col(name).cast(kind).alias(name)
    return conversations.select(c("conv_id", "long"), c("turn", "long"), c("role", "string"), c("text", "string")).mapInArrow(_render, _RENDERED)


class Reader:
    """Reads the text of a conversation, handed over in pieces of any length, turn by turn.

    The grammar alone says where a turn ends and whose text a loss applies to. What is held is one turn.
    """

    def __init__(self) -> None:
        self.rest, self.at = "", 0

    def turns(self, piece: str) -> Iterator[tuple[str, str, int, int, str]]:
        """role, text, the loss mask's start and end in the conversation, and what stands under it."""
        seen, self.rest = max(0, len(self.rest) - len(CLOSE)), self.rest + piece
        while (to := self.rest.find(f"{CLOSE}\n", seen)) >= 0:
            segment, self.rest, seen = self.rest[: to + len(CLOSE) + 1], self.rest[to + len(CLOSE) + 1 :], 0
            role, text, a, b = parse_turn(segment)
            a = a if role == "assistant" else b
            yield role, text, self.at + a, self.at + b, segment[a:b]
            self.at += len(segment)

    def close(self) -> int:
        """The length of the conversation's text; ValueError if it ends inside a turn."""
        if self.rest:
            raise ValueError("a conversation that ends inside a turn")
        return self.at


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = 0
        self.reader = Reader()

    def add(self, piece: str) -> None:
        for role, text, _, _, masked in self.reader.turns(piece):
            self.turns.update(f"{role}\n{text}\n".encode())
            under = unescape(masked)
            self.loss.update(under.encode())
            self.n, self.loss_chars = self.n + 1, self.loss_chars + len(under)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.reader.close()


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.string() if "string" in x else pa.int64() for x in _READ.split(", ")]
    now, digest = None, None
    for batch in batches:
        done = []
        for conv_id, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            if digest is None or conv_id != now:
                if digest is not None:
                    done.append(digest.row(now))
                now, digest = conv_id, _Digest()
            digest.add(piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(digest.row(now), kinds, strict=True)], names)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the mask, parsed from each conversation's rendered text alone.

    A conversation is read as a sorted stream of text; neither the bounds of its rows nor their other columns
    reach the parser. A digest of all its turns cannot be split, but no more than a turn of it is held.
    """
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment").mapInArrow(_read_back, _READ)
