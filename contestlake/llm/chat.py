r"""Chat formatting with offset-aligned masks.

A conversation becomes one text: ``### role: text</turn>`` per turn, a line
feed between turns.  Inside roles and texts every backslash and every control
string gets a backslash in front, so the text can be read back.  The whole
text is encoded once with offsets; turn spans and token spans are both sorted,
and the tokens of a span are found by binary search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.processors import ByteLevel

# The template.
HEAD, COLON, END, BREAK = "### ", ": ", "</turn>", "\n"
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>(?:\n|$)", re.DOTALL)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and where the texts of ``loss_role`` are in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role, _ROLE_CONTROL)}{COLON}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(head + body + END)
        at += len(head) + len(body) + len(END) + len(BREAK)
    return BREAK.join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@cache
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.post_processor = ByteLevel(trim_offsets=False)  # offsets of a word then include its space
    return t


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that share a character with a span; both are sorted and found by binary search, all spans at once."""
    some = spans[spans[:, 0] < spans[:, 1]]
    first = np.searchsorted(offsets[:, 1], some[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], some[:, 1], side="left")
    change = np.zeros(len(offsets) + 1, dtype=np.int64)
    np.add.at(change, first, first < last)
    np.subtract.at(change, last, first < last)
    return np.cumsum(change[:-1]) > 0


def masked_pieces(formatted: str, offsets: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> list[str]:
    """Text under the mask, span by span: the characters of masked tokens, cut at the span's ends.

    A token may begin before a span or end behind it; the span says which of
    its characters count.  Tokens that share a character (parts of one code
    point) count it once.
    """
    out = []
    firsts = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
    lasts = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    for (start, end), first, last in zip(spans.tolist(), firsts.tolist(), lasts.tolist()):
        on = mask[first:last]
        a, b = offsets[first:last, 0][on], np.minimum(offsets[first:last, 1][on], end)
        # Each token counts from where those before it have ended.
        a = np.maximum(a, np.maximum.accumulate(np.r_[start, b[:-1]])) if len(b) else a
        a, b = a[a < b], b[a < b]
        gaps = np.flatnonzero(a[1:] > b[:-1]) + 1
        heads, tails = a[np.r_[0, gaps]] if len(a) else a, b[np.r_[gaps - 1, len(b) - 1]] if len(b) else b
        out.append("".join(formatted[x:y] for x, y in zip(heads.tolist(), tails.tolist())))
    return out


FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_())),
     ("token_start", pa.list_(pa.int32())), ("token_end", pa.list_(pa.int32())),
     ("span_start", pa.list_(pa.int32())), ("span_end", pa.list_(pa.int32()))]
)
FORMATTED_SQL = ("conv_id long, formatted string, ids array<int>, mask array<boolean>, token_start array<int>, "
                 "token_end array<int>, span_start array<int>, span_end array<int>")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Runs of equal conv_id in sorted rows; only one conversation is held."""
    now, turns = None, []
    for b in batches:
        for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            if turns and conv != now:
                yield now, turns
                turns = []
            now = conv
            turns.append((role or "", text or ""))
    if turns:
        yield now, turns


def format_conversations(turns: DataFrame, tokenizer_path: str, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: its text, ids, token mask, token and span offsets (in code points).

    Rows are ordered by turn, then role and text, nulls first; repeated rows
    are repeated turns.  A null text or role is empty; rows without conv_id
    make one conversation without a number.  Conversations are sorted within
    partitions by Spark and read as a stream, one at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        out, size = [], 0
        for conv, some in _conversations(batches):
            text, spans = render(some, loss_role)
            encoded = encoder.encode(text, add_special_tokens=False)
            offsets = np.fromiter(chain.from_iterable(encoded.offsets), np.int32, 2 * len(encoded)).reshape(-1, 2)
            where = np.array(spans, dtype=np.int32).reshape(-1, 2)
            out.append((conv, text, np.array(encoded.ids, dtype=np.int32), token_mask(offsets, where), offsets, where))
            size += len(text)
            if size > 1 << 20:
                yield _arrow(out)
                out, size = [], 0
        yield _arrow(out)

    dealt = turns.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(rows, FORMATTED_SQL)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """One list per array, made of the arrays' own numbers."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    if not rows:
        return pa.RecordBatch.from_pylist([], schema=FORMATTED)
    conv, text, ids, mask, offsets, spans = zip(*rows)
    pairs = [_lists([x[:, k] for x in some]) for some in (offsets, spans) for k in (0, 1)]
    return pa.record_batch([pa.array(conv, pa.int64()), pa.array(text), _lists(ids), _lists(mask), *pairs], names=FORMATTED.names)


def _numbers(column: pa.ListArray) -> tuple[np.ndarray, list[int]]:
    """All numbers of a list column, and where each row's begin and end."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), (ends - ends[0]).tolist()


READ_BACK = pa.schema(
    [("conv_id", pa.int64()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
     ("loss_text", pa.string()), ("formatted_chars", pa.int64())]
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns, text under the loss mask and length, from the formatted text, the mask and the offsets alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            tokens = np.stack([_numbers(b.column(c))[0] for c in ("token_start", "token_end")], axis=1)
            spans = np.stack([_numbers(b.column(c))[0] for c in ("span_start", "span_end")], axis=1)
            mask, at = _numbers(b.column("mask"))
            held = _numbers(b.column("span_start"))[1]
            for i, (conv, text) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist())):
                some = slice(at[i], at[i + 1])
                pieces = masked_pieces(text, tokens[some], mask[some], spans[held[i] : held[i + 1]])
                out.append((conv, [{"role": r, "text": t} for r, t in parse(text)], "".join(map(unescape, pieces)), len(text)))
            columns = list(zip(*out)) or [[] for _ in READ_BACK]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, READ_BACK)], schema=READ_BACK)

    return formatted.mapInArrow(
        rows, "conv_id long, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars long"
    )


def digests(read: DataFrame) -> DataFrame:
    """Numbers and digests of what was read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
