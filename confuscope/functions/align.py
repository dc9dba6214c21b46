"""Alignment of truth and prediction: edit distance with traceback, and global alignment by score.

The tables of all pairs in a batch are filled together, a row of every table at a time: NumPy works
across the batch, so its cost does not fall on each character. Batches are cut so that the
tables stay within a memory bound; of a single table beyond it only some rows are kept and the others are
filled again on the way back. Texts whose places differ no more than their characters do need no table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = T.StructType([T.StructField("t", T.StringType()), T.StructField("p", T.StringType())])
ALIGNMENT = T.ArrayType(PAIR)
ALIGNED = T.StructType([T.StructField("a1", T.StringType()), T.StructField("a2", T.StringType())])
#: Table cells held at once.
CELLS = 24_000_000
#: Characters of both texts whose alignments are handed on together.
CHARS = 1_000_000


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, dtype=np.int64)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out


def _tables(a: list[str], b: list[str], match: int, mismatch: int, gap: int) -> np.ndarray:
    """Lowest-cost tables (pair, row, column) with the given costs of match, mismatch and gap."""
    m, n = max(map(len, a), default=0), max(map(len, b), default=0)
    ca, cb = _codes(a, m, -1), _codes(b, n, -2)
    d = np.empty((len(a), m + 1, n + 1), dtype=np.int32)
    steps = gap * np.arange(n + 1, dtype=np.int32)
    d[:, 0, :] = steps
    for i in range(1, m + 1):
        cost = np.where(ca[:, i - 1 : i] == cb, match, mismatch)
        best = np.minimum(d[:, i - 1, 1:] + gap, d[:, i - 1, :-1] + cost)
        row = np.concatenate([np.full((len(a), 1), i * gap, dtype=np.int32), best.astype(np.int32)], axis=1)
        # A gap from the left adds the same for each column, so it is a running minimum.
        d[:, i, :] = np.minimum.accumulate(row - steps, axis=1) + steps
    return d


def _groups(a: list[str], b: list[str]) -> Iterator[list[int]]:
    """Pairs of alike size, as many as the memory bound allows."""
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    group: list[int] = []
    m = n = 0
    for k in order:
        m2, n2 = max(m, len(a[k])), max(n, len(b[k]))
        if group and (len(group) + 1) * (m2 + 1) * (n2 + 1) > CELLS:
            yield group
            group, m2, n2 = [], len(a[k]), len(b[k])
        group.append(k)
        m, n = m2, n2
    if group:
        yield group


def edit_alignments(truths: list[str], preds: list[str]) -> list[list[tuple[str | None, str | None]]]:
    """Optimal unit-cost alignments, read from the end: an equal pair first, then a substitution, then a
    character of the prediction alone, else one of the truth alone."""
    out: list[list] = [[] for _ in truths]
    rest = []
    for k, (a, b) in enumerate(zip(truths, preds, strict=True)):
        if _straight(a, b):
            out[k] = list(zip(a, b, strict=True))
        elif (len(a) + 1) * (len(b) + 1) > CELLS:
            out[k] = _long_alignment(a, b)
        else:
            rest.append(k)
    for group in _groups([truths[k] for k in rest], [preds[k] for k in rest]):
        group = [rest[g] for g in group]
        d = _tables([truths[k] for k in group], [preds[k] for k in group], 0, 1, 1)
        for at, k in enumerate(group):
            _trace_back(truths[k], preds[k], d[at], 0, len(truths[k]), len(preds[k]), out[k])
            out[k].reverse()
    return out


def _trace_back(a: str, b: str, t: np.ndarray, top: int, i: int, j: int, got: list) -> tuple[int, int]:
    """Add the steps from (i, j) back to row ``top``, the first row of ``t``; to the corner if that is row 0."""
    while i > top or (j and not top):
        r = i - top
        if i and j and (a[i - 1] == b[j - 1] or t[r, j] == t[r - 1, j - 1] + 1):
            i, j = i - 1, j - 1
            got.append((a[i], b[j]))
        elif j and t[r, j] == t[r, j - 1] + 1:
            j -= 1
            got.append((None, b[j]))
        else:
            i -= 1
            got.append((a[i], None))
    return i, j


def _straight(a: str, b: str) -> bool:
    """Whether the alignment place by place is optimal because as many characters have no counterpart anywhere
    as differ in their place. The same then holds for the fronts that the traceback passes, so it takes this path."""
    if len(a) != len(b):
        return False
    if a == b:
        return True
    ca, cb = _codes([a], len(a), -1)[0], _codes([b], len(b), -1)[0]
    _, kind = np.unique(np.r_[ca, cb], return_inverse=True)
    n, kinds = len(a), int(kind.max()) + 1
    common = np.minimum(np.bincount(kind[:n], minlength=kinds), np.bincount(kind[n:], minlength=kinds)).sum()
    return bool(n - common == (ca != cb).sum())


def _long_alignment(a: str, b: str) -> list[tuple[str | None, str | None]]:
    """As edit_alignments, with about twice the square root of the table's rows held at once."""
    ca, cb = _codes([a], len(a), -1)[0], _codes([b], len(b), -1)[0]
    steps = np.arange(len(b) + 1, dtype=np.int32)

    def below(row: np.ndarray, i: int) -> np.ndarray:
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (ca[i - 1] != cb))
        return np.minimum.accumulate(new - steps) + steps

    every = isqrt(len(a)) + 1
    kept, row = [steps], steps
    for i in range(1, len(a) + 1):
        row = below(row, i)
        if i % every == 0:
            kept.append(row)
    got: list = []
    i, j = len(a), len(b)
    while i or j:
        top = max(i - 1, 0) // every * every
        rows = [kept[top // every]]
        for k in range(top + 1, i + 1):
            rows.append(below(rows[-1], k))
        i, j = _trace_back(a, b, np.stack(rows), top, i, j, got)
    return got[::-1]


def global_alignments(firsts: list[str], seconds: list[str], match: int = 2, mismatch: int = -1, gap: int = -1) -> list[tuple[str, str]]:
    """Highest-scoring global alignments with gaps as "-"; from the end a pair goes before a gap in the
    second and that before a gap in the first."""
    out: list[tuple[str, str]] = [("", "")] * len(firsts)
    for group in _groups(firsts, seconds):
        d = -_tables([firsts[k] for k in group], [seconds[k] for k in group], -match, -mismatch, -gap)
        for at, k in enumerate(group):
            a, b, t = firsts[k], seconds[k], d[at]
            i, j, x, y = len(a), len(b), [], []
            while i or j:
                if i and j and t[i, j] == t[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                    i, j = i - 1, j - 1
                    x.append(a[i])
                    y.append(b[j])
                elif i and (not j or t[i, j] == t[i - 1, j] + gap):
                    i -= 1
                    x.append(a[i])
                    y.append("-")
                else:
                    j -= 1
                    x.append("-")
                    y.append(b[j])
            out[k] = "".join(reversed(x)), "".join(reversed(y))
    return out


@F.pandas_udf(ALIGNMENT)
def _align_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, p in batches:
        found = edit_alignments(t.fillna("").tolist(), p.fillna("").tolist())
        yield pd.Series([[{"t": a, "p": b} for a, b in x] for x in found])


@F.pandas_udf(ALIGNED)
def _global_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in batches:
        yield pd.DataFrame(global_alignments(a.fillna("").tolist(), b.fillna("").tolist()), columns=["a1", "a2"])


def align(truth: Column, prediction: Column, case_sensitive: bool = True, normalize: bool = True) -> Column:
    """Array of (t, p); null marks a gap. Null texts count as empty."""
    from .text import fold_case, nfc

    if normalize:
        truth, prediction = nfc(truth), nfc(prediction)
    return _align_udf(fold_case(truth, case_sensitive), fold_case(prediction, case_sensitive))


def with_alignment(pairs: DataFrame, truth: str, prediction: str, case_sensitive: bool = True, normalize: bool = True) -> DataFrame:
    """``pairs`` with a column alignment as of align. The alignments of whole texts are far larger than the texts,
    so they are handed on in slices and not by the batch of rows that is read."""
    from .text import fold_case, nfc

    ready = lambda c: fold_case(nfc(F.col(c)) if normalize else F.col(c), case_sensitive)
    kept = pairs.columns
    schema = T.StructType([*pairs.schema.fields, T.StructField("alignment", ALIGNMENT)])
    rows = pairs.select("*", ready(truth).alias("__t"), ready(prediction).alias("__p"))
    kind = pa.list_(pa.struct([("t", pa.string()), ("p", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, ps = ([x or "" for x in batch.column(c).to_pylist()] for c in ("__t", "__p"))
            ends = np.cumsum([len(x) + len(y) for x, y in zip(ts, ps, strict=True)])
            cuts = [0, *(np.flatnonzero(np.diff(ends // CHARS)) + 1).tolist(), len(ts)] if len(ts) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                found = edit_alignments(ts[lo:hi], ps[lo:hi])
                flat = [x for f in found for x in f]
                both = pa.StructArray.from_arrays([pa.array([x for x, _ in flat], pa.string()), pa.array([y for _, y in flat], pa.string())], ["t", "p"])
                made = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(f) for f in found])], pa.int32()), both).cast(kind)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), made], names=[*kept, "alignment"])

    return rows.mapInArrow(run, schema)


def edit_counts(truths: list[str], preds: list[str]) -> np.ndarray:
    """Rows (matches, substitutions, insertions, deletions) of the alignments."""
    out, rest = np.zeros((len(truths), 4), dtype=np.int32), []
    for k, (a, b) in enumerate(zip(truths, preds, strict=True)):
        if _straight(a, b):
            same = int((_codes([a], len(a), -1) == _codes([b], len(b), -1)).sum())
            out[k, :2] = same, len(a) - same
        else:
            rest.append(k)
    for k, found in zip(rest, edit_alignments([truths[k] for k in rest], [preds[k] for k in rest]), strict=True):
        gaps = sum(t is None for t, _ in found), sum(p is None for _, p in found)
        same = sum(t == p for t, p in found)
        out[k] = same, len(found) - same - sum(gaps), *gaps
    return out


COUNTS = ("matches", "substitutions", "insertions", "deletions")
#: Rows of a batch that are Python objects at once.
ROWS = 500


def _columns(pairs: DataFrame, truth: str, prediction: str, case_sensitive: bool, normalize: bool) -> tuple[list[Column], bool]:
    """(columns __t and __p, whether the task is to normalise them): without case folding, which comes after it,
    normalisation is left to the task that aligns, so that no other Python worker is needed."""
    from .text import fold_case, nfc

    ready = lambda c: F.coalesce(F.col(c) if case_sensitive or not normalize else nfc(F.col(c)), F.lit(""))
    return [fold_case(ready(c), case_sensitive).alias(n) for c, n in ((truth, "__t"), (prediction, "__p"))], normalize and case_sensitive


def _texts(batch: pa.RecordBatch, name: str, normalize: bool) -> list[str]:
    texts = batch.column(name).to_pylist()
    return [unicodedata.normalize("NFC", t) for t in texts] if normalize else texts


def with_edit_counts(pairs: DataFrame, truth: str, prediction: str, case_sensitive: bool = True, normalize: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``pairs``, or the columns ``keep`` of it, with the columns of COUNTS: with_alignment and operation_counts without the
    alignments themselves."""
    kept = pairs.columns if keep is None else keep
    texts, normalise = _columns(pairs, truth, prediction, case_sensitive, normalize)
    schema = T.StructType([*[pairs.schema[c] for c in kept], *[T.StructField(c, T.IntegerType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                n = edit_counts(_texts(part, "__t", normalise), _texts(part, "__p", normalise))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(n[:, k]) for k in range(4))], names=[*kept, *COUNTS])

    return pairs.select(*kept, *texts).mapInArrow(run, schema)


def pair_counts(truths: list[str], preds: list[str]) -> dict[tuple[str, str], int]:
    """How often each (true, predicted) character stands in the alignments, gaps left out."""
    straight, rest = [], []
    for k, (a, b) in enumerate(zip(truths, preds, strict=True)):
        (straight if _straight(a, b) else rest).append(k)
    out: dict[tuple[str, str], int] = {}
    codes = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    ends = np.cumsum([len(truths[k]) for k in straight])
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHARS)) + 1).tolist(), len(straight)]
    for some in (straight[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False) if lo < hi):
        kinds, counts = np.unique(codes([truths[k] for k in some]) << 21 | codes([preds[k] for k in some]), return_counts=True)
        for x, n in zip(kinds.tolist(), counts.tolist(), strict=True):
            pair = chr(x >> 21), chr(x & (1 << 21) - 1)
            out[pair] = out.get(pair, 0) + n
    for found in edit_alignments([truths[k] for k in rest], [preds[k] for k in rest]):
        for t, p in found:
            if t is not None and p is not None:
                out[t, p] = out.get((t, p), 0) + 1
    return out


def counted_alignment(pairs: DataFrame, truth: str, prediction: str, case_sensitive: bool = True, normalize: bool = True) -> DataFrame:
    """(script, true_char, pred_char, n) of the alignments of ``pairs``, summed up within each task, so that a row for each
    cell and task leaves Python and not one for each character."""
    texts, normalise = _columns(pairs, truth, prediction, case_sensitive, normalize)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, dict[tuple[str, str], int]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                scripts, ts, ps = part.column("script").to_pylist(), _texts(part, "__t", normalise), _texts(part, "__p", normalise)
                for script in dict.fromkeys(scripts):
                    own, rows = total.setdefault(script, {}), [k for k, x in enumerate(scripts) if x == script]
                    for pair, n in pair_counts([ts[k] for k in rows], [ps[k] for k in rows]).items():
                        own[pair] = own.get(pair, 0) + n
        cells = [(script, t, p, n) for script, own in total.items() for (t, p), n in own.items()]
        for lo in range(0, len(cells), 10_000):
            columns = zip(*cells[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["script", "true_char", "pred_char", "n"])

    return pairs.select("script", *texts).mapInArrow(run, "script string, true_char string, pred_char string, n long")


def needleman_wunsch(first: Column, second: Column) -> Column:
    return _global_udf(first, second)


def operation_counts(alignment: Column) -> list[Column]:
    """matches, substitutions, insertions, deletions."""
    of = lambda f: F.size(F.filter(alignment, f))
    return [
        of(lambda x: x["t"] == x["p"]).alias("matches"), of(lambda x: x["t"] != x["p"]).alias("substitutions"),
        of(lambda x: x["t"].isNull()).alias("insertions"), of(lambda x: x["p"].isNull()).alias("deletions"),
    ]


def char_accuracy(matches: Column, subs: Column, deletions: Column) -> Column:
    """Matches over the truth's length; 0 for an empty truth."""
    n = matches + subs + deletions
    return F.when(n > 0, matches / n).otherwise(F.lit(0.0))


def char_error_rate(matches: Column, subs: Column, insertions: Column, deletions: Column) -> Column:
    """Edits over the truth's length; 1 for an empty truth."""
    n = matches + subs + deletions
    return F.when(n > 0, (subs + insertions + deletions) / n).otherwise(F.lit(1.0))


def confusion_pairs(alignment: Column) -> Column:
    """Array of (true_char, pred_char) without gaps."""
    paired = F.filter(alignment, lambda x: x["t"].isNotNull() & x["p"].isNotNull())
    return F.transform(paired, lambda x: F.struct(x["t"].alias("true_char"), x["p"].alias("pred_char")))
