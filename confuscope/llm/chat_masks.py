"""Chat formatting with loss masks aligned by character offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its turns are
intersected with the spans of its tokens by binary search. The template's control strings are
escaped inside texts with a backslash, reversibly; a vocabulary's special tokens in a text are encoded as ordinary text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, NAMED, CLOSE = "### ", ":\n", "\n</turn>\n"
#: Strings that mark turns; a backslash escapes them and itself.
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
#: In a role, the end of the role's name must be unambiguous too.
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:|\n")
_ROLE_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Rendered:
    text: str = ""
    #: (start, end, trained) of each turn's text within the whole, sorted.
    spans: list[tuple[int, int, bool]] = field(default_factory=list)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> Rendered:
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + _ROLE_CONTROL.sub(r"\\\g<0>", role) + NAMED, escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == trained))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return Rendered("".join(parts), spans)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; raises if it is not one. Neither ``NAMED`` within a role
    nor ``CLOSE`` within a text can occur unescaped, so the first one found ends it."""
    turns, at = [], 0
    while at < len(formatted):
        named = formatted.find(NAMED, at)
        close = formatted.find(CLOSE, named + len(NAMED)) if named >= 0 else -1
        if not formatted.startswith(OPEN, at) or named < 0 or close < 0:
            raise ValueError(f"no turn at character {at}")
        role, text = formatted[at + len(OPEN) : named], formatted[named + len(NAMED) : close]
        turns.append((_ROLE_ESCAPED.sub(r"\1", role), unescape(text)))
        at = close + len(CLOSE)
    return turns


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    from tokenizers.processors import ByteLevel

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.post_processor = ByteLevel(trim_offsets=False)
    return t


def mask_tokens(offsets: list[tuple[int, int]], spans: list[tuple[int, int, bool]]) -> tuple[list[int], list[tuple[int, int]]]:
    """(mask, loss): mask has 1 for each token that overlaps a trained span; loss has the characters
    under these tokens within the spans, as sorted ranges that do not overlap.

    Token starts and ends both ascend, so the first and the last token of a span are found by binary search.
    """
    at = np.array(offsets, dtype=np.int64).reshape(-1, 2)
    starts, ends = np.ascontiguousarray(at[:, 0]), np.ascontiguousarray(at[:, 1])
    mask, loss = np.zeros(len(at), dtype=np.int8), []
    for s, e, trained in spans:
        if not trained or s == e:
            continue
        first, last = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        if first >= last:
            continue
        mask[first:last] = 1
        lo, hi = np.maximum(starts[first:last], s), np.maximum.accumulate(np.minimum(ends[first:last], e))
        cut = np.flatnonzero(lo[1:] > hi[:-1])  # tokens that leave characters between them
        loss += zip(lo[np.r_[0, cut + 1]].tolist(), hi[np.r_[cut, len(hi) - 1]].tolist(), strict=True)
    return mask.tolist(), loss


OUT = "conv_id long, n_turns long, formatted string, ids array<int>, mask array<byte>, loss_spans array<struct<start:int,end:int>>, turn_spans array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8())), ("loss_spans", _SPAN), ("turn_spans", _SPAN)])


def format_conversations(
    turns: DataFrame, tokenizer_path: str, trained: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """A row for each conversation: (conv_id, n_turns, formatted, ids, mask, loss_spans, turn_spans).

    Turns are ordered by turn number (nulls first), then role and text, so ties and repeated rows
    have a fixed order. Null roles and texts count as empty. A row with a null conv_id is a conversation of its
    own, as nothing says which it belongs to. loss_spans are the characters of ``formatted`` under the mask. Turns are sorted
    within hash partitions of the conversation and streamed; a conversation is held whole, since it
    is encoded once, but never more than one. An empty table gives an empty result; other columns
    are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, now, held, out = _tokenizer(tokenizer_path), None, [], []

        def finish() -> tuple:
            r = render(held, trained)
            e = tok.encode(r.text, add_special_tokens=False)
            mask, loss = mask_tokens(e.offsets, r.spans)
            span = lambda xs: [{"start": s, "end": e} for s, e, *_ in xs]
            return now[0], len(held), r.text, e.ids, mask, span(loss), span(r.spans)

        for batch in batches:
            for conv, alone, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv, alone):
                    if now is not None:
                        out.append(finish())
                        if len(out) >= 200:
                            yield _pack(out)
                            out = []
                    now, held = (conv, alone), []
                held.append((role, text))
        if now is not None:
            out.append(finish())
        if out:
            yield _pack(out)

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    dealt = rows.repartition(F.col("conv_id"), F.col("alone")).sortWithinPartitions("conv_id", "alone", "turn", "role", "text")
    return dealt.select("conv_id", "alone", "role", "text").mapInArrow(run, OUT)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digest(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). Turns are parsed from the text; loss is the unescaped text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            out = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                both = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), sha256(both.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
