"""SimHash near-duplicates: fingerprints, and their self-join by traversing a binary trie in pairs.

Equal fingerprints are merged first, so copies cost nothing further on. Two fingerprints of 64 bits
that differ in at most three bits agree on one of four blocks of 16 bits; each fingerprint goes to
the four tries named by (block, value of the block). In
a trie, node pairs are traversed together from (root, root): the bits in which the two prefixes
differ are added up and a pair is pruned as soon as they exceed the budget. A trie with more than
SPLIT fingerprints is dealt out further by the same argument on its remaining bits, and what is still too
large then by pairs of parts of it, so no task gets an unbounded trie and no link is lost.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from math import acos, pi

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col_of, forget, fresh, written
from .components import connected_components

#: Whether the pairs of positions (i, j) are links.
Check = Callable[[np.ndarray, np.ndarray], np.ndarray]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SHINGLE = 3
BUDGET = 3
BITS = 64
#: Fingerprints in one trie before it is dealt out further.
SPLIT = 50_000
#: Pairs of nodes or keys that are looked at together; bounds memory.
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; zero for a text without words."""
    words = _WORD.findall((text or "").translate(_UPPER))
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [" ".join(words)]
    else:
        grams = list(map(" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(BITS, dtype=np.int64), len(grams)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(g, 42) for g in grams[at : at + (1 << 16)]), dtype=np.uint64, count=min(n - at, 1 << 16))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprint_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    forget()
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; null texts count as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprint_udf(F.col(text_col)).alias("fp"))


# ------------------------------------------------------------------------------------- trie self-join


class _Forest:
    """Union-find over positions, so that a trie gives at most one edge for each fingerprint."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def roots(self) -> np.ndarray:
        """The root of every position; paths are shortened to it."""
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs that are connected already are passed over together."""
        if len(i) > 32:
            r = self.roots()
            pairs = np.unique(np.stack([np.minimum(r[i], r[j]), np.maximum(r[i], r[j])], axis=1), axis=0)
            i, j = pairs[pairs[:, 0] != pairs[:, 1]].T
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = self.find(x), self.find(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def link_checked(self, i: np.ndarray, j: np.ndarray, check: Check) -> None:
        """Link the pairs that ``check`` finds true. Pairs that are connected meanwhile need no check, so they are
        checked a growing number at a time."""
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)
        step = 64
        while len(pairs):
            r = self.roots()
            pairs = pairs[r[pairs[:, 0]] != r[pairs[:, 1]]]
            now, pairs = pairs[:step], pairs[step:]
            if len(now):
                ok = check(now[:, 0], now[:, 1])
                self.link(now[ok, 0], now[ok, 1])
            step *= 2


def trie_links(keys: np.ndarray, tries: np.ndarray, budget: int = BUDGET, wide: np.ndarray | None = None,
               wide_budget: np.ndarray | None = None, check: Check | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) between positions of ``keys`` that connect just what the links within each trie
    connect; a link is two keys of one trie that differ in at most ``budget`` bits and, if rows of
    further words ``wide`` are given, differ in at most ``wide_budget`` bits of these, the larger of both keys'
    budgets; if ``check`` is given, it must also hold for the pair.

    ``keys``: unsigned 64-bit, sorted within each trie; ``tries``: the trie of each, ascending.
    All tries are traversed together, level by level, on
    a stack of bounded chunks of node pairs; a node is a range of sorted keys.
    """
    n = len(keys)
    forest = _Forest(n)
    starts = np.flatnonzero(np.r_[True, tries[1:] != tries[:-1]]) if n else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts[1:], n] if n else starts
    big = ends - starts > 1
    s, e = starts[big], ends[big]
    stack = [(0, s, e, s, e, np.zeros(len(s), dtype=np.int64))] if len(s) else []
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > CHUNK:
            half = len(a0) // 2
            stack.append((level, *(x[half:] for x in (a0, a1, b0, b1, err))))
            stack.append((level, *(x[:half] for x in (a0, a1, b0, b1, err))))
            continue
        # Pairs of few keys, and of equal ones, are compared directly.
        few = ((a1 - a0) * (b1 - b0) <= 16) | (level >= BITS)
        if few.any():
            _compare(keys, forest, a0[few], a1[few], b0[few], b1[few], budget, wide, wide_budget, check)
            a0, a1, b0, b1, err = (x[~few] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        am, bm = _middle(keys, a0, a1, level), _middle(keys, b0, b1, level)
        same = (a0 == b0) & (a1 == b1)
        out = []
        for lo1, hi1, lo2, hi2, add, keep in (
            (a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same),
        ):
            ok = (lo1 < hi1) & (lo2 < hi2) & (err + add <= budget)
            ok &= ~((lo1 == lo2) & (hi1 - lo1 == 1) & (hi2 - lo2 == 1))  # a key with itself
            if keep is not None:
                ok &= keep
            out.append((lo1[ok], hi1[ok], lo2[ok], hi2[ok], err[ok] + add))
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*out, strict=True))))
    roots = forest.roots()
    child = np.flatnonzero(roots != np.arange(n))
    return child, roots[child]


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """First position in each range whose bit at ``level`` is set, by binary search."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - level)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        set_ = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)


def _compare(keys: np.ndarray, forest: _Forest, a0, a1, b0, b1, budget: int, wide: np.ndarray | None, wide_budget: np.ndarray | None, check: Check | None) -> None:
    """Link all pairs across each pair of ranges that are near enough, a bounded number at a time."""
    while (large := ((a1 - a0) * (b1 - b0) > CHUNK) & (a1 - a0 > 1)).any():
        mid = (a0[large] + a1[large]) // 2
        a0, a1, b0, b1 = (np.r_[x[~large], y, z] for x, y, z in (
            (a0, a0[large], mid), (a1, mid, a1[large]), (b0, b0[large], b0[large]), (b1, b1[large], b1[large])))
    sizes = (a1 - a0) * (b1 - b0)
    group = np.cumsum(sizes) // CHUNK
    for g in np.unique(group):
        at = group == g
        size, nb = sizes[at], (b1 - b0)[at]
        which = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        i, j = a0[at][which] + k // nb[which], b0[at][which] + k % nb[which]
        ok = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
        i, j = i[ok], j[ok]
        if wide is not None and len(i):
            ok = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= np.maximum(wide_budget[i], wide_budget[j])
            i, j = i[ok], j[ok]
        if check is None:
            forest.link(i, j)
        elif len(i):
            forest.link_checked(i, j, check)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (trie, key, fp) sorted by trie and key."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tries, fps = t["trie"].to_numpy(), t["fp"].to_numpy()
        i, j = trie_links(t["key"].to_numpy().view(np.uint64), tries)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], schema=_EDGE)

    yield from _whole_tries(batches, run)


def _whole_tries(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    """Hand on whole tries, many small ones together; of sorted rows a bounded number is held."""
    forget()
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= 4 * SPLIT:
            t = pa.Table.from_batches(held)
            tries = t["trie"].to_numpy()
            cut = int(np.flatnonzero(tries != tries[-1])[-1]) + 1 if tries[0] != tries[-1] else 0
            if cut:
                yield from run(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield from run(pa.Table.from_batches(held))


def _block(width: int, k: int, total: int):
    """Block ``k`` of the last ``total`` bits of rest, from their front."""
    return F.shiftrightunsigned("rest", total - width * (k + 1)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _without(width: int, k: int, total: int):
    """The last ``total`` bits of rest without that block."""
    after = total - width * (k + 1)
    tail = F.col("rest").bitwiseAND(F.lit((1 << after) - 1).cast("long"))
    head = F.shiftrightunsigned("rest", after + width).bitwiseAND(F.lit((1 << (width * k)) - 1).cast("long"))
    return F.shiftleft(head, after).bitwiseOR(tail)


def split_large(rows: DataFrame) -> DataFrame:
    """Rows (trie, fp, ...) with every trie of more than SPLIT members dealt out: its members fall into parts by
    a hash of fp, and each pair of parts is a trie of its own, of about SPLIT members at most. Any two members of a trie
    still meet, so no link is lost, whatever SPLIT is; a member is repeated for each part."""
    sizes = rows.groupBy("trie").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
    large = written(sizes.select("trie", F.ceil(2 * F.col("n") / SPLIT).cast("int").alias("parts")), "large")
    if large.isEmpty():
        return rows
    own = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
    paired = rows.join(large, "trie").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.withColumn("trie", F.xxhash64("trie", F.least("own", "other"), F.greatest("own", "other")))
    return rows.join(large, "trie", "left_anti").unionByName(paired.select(*rows.columns))


def fingerprint_edges(distinct: DataFrame) -> DataFrame:
    """(a, b) signed fingerprints that connect what links within the budget connect.

    ``distinct``: a row for each fingerprint, column fp. Each trie yields a spanning forest of its
    links, never all its pairs.
    """
    rows = distinct.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("trie"))
    parts, total = [], BITS
    for width in (16, 12, 9):
        blocks = F.array(*[F.struct(F.lit(k).alias("k"), _block(width, k, total).alias("value"), _without(width, k, total).alias("rest")) for k in range(4)])
        dealt = rows.select("fp", "trie", F.explode(blocks).alias("part"))
        dealt = dealt.select("fp", F.col("part.rest").alias("rest"), F.xxhash64("trie", "part.k", "part.value").alias("trie"))
        rows, total = dealt, total - width
        sizes = dealt.groupBy("trie").agg(F.count("*").alias("size"))
        large = written(sizes.where(F.col("size") > SPLIT), "large")
        if large.isEmpty():
            parts.append(dealt)
            rows = None
            break
        parts.append(dealt.join(large, "trie", "left_anti"))
        rows = written(dealt.join(large.select("trie"), "trie", "left_semi"), "dealt")
    if rows is not None:
        parts.append(split_large(rows))
    out = None
    for part in parts:
        # A collision of two tries' hashes only puts both in one trie; keys are then compared in full.
        keyed = part.select("trie", F.col("fp").alias("key"), "fp")
        keyed = keyed.repartition(F.col("trie")).withColumn("flip", F.col("key").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
        keyed = keyed.sortWithinPartitions("trie", "flip").select("trie", "key", "fp")
        found = keyed.mapInArrow(_join_tries, "a long, b long")
        out = found if out is None else out.unionByName(found)
    return out


def group_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, component): component is the smallest fingerprint that is reachable; only fingerprints
    with a link appear."""
    return _components(fingerprint_edges(fps))


def _components(edges: DataFrame) -> DataFrame:
    return connected_components(edges).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: (doc_id, fingerprint, component_id).

    fingerprint: 16 hex digits. component_id: the smallest doc_id that can be reached over links of
    at most three differing bits (null if no member has an id). Null and empty texts have fingerprint zero
    and are linked like any other; repeated rows give a row each; other columns are left out; an
    empty table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    by_fp = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    groups = group_fingerprints(by_fp.select("fp"))
    linked = by_fp.join(groups, "fp")
    # Written, so that the join with it deals out both sides and a large component can be split.
    lows = written(linked.groupBy("component").agg(F.min("low").alias("low")), "lows")
    new = linked.select("fp", "component").join(lows, "component").select("fp", F.col("low").alias("linked_low"))
    labels = written(by_fp.join(new, "fp", "left").select("fp", F.coalesce("linked_low", "low").alias("component_id")), "labels")
    return rows.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------------------------- near copies by similarity

#: The stage's near copies: word shingles, the Jaccard similarity of their sets, and how it is seen.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
WIDE_BITS, MINS = 512, 6
#: Signatures only make candidates. Share of bits in which sets of that similarity differ (the angle between them), and
#: budgets four deviations beyond it, on all bits and on the first word, which steers the traversal. Small sets have ties:
#: four shingles and the same with one more differ where two of the four bits are set and the fifth is (6/16 * 1/2).
_SHARE, _SMALL_SHARE, SMALL = acos(2 * SIMILARITY / (1 + SIMILARITY)) / pi, 3 / 16, 16


def _beyond(bits: int, share: float) -> int:
    return round(bits * share + 4 * (bits * share * (1 - share)) ** 0.5)


WIDE_BUDGET, SMALL_BUDGET, FIRST_BUDGET = _beyond(WIDE_BITS, _SHARE), _beyond(WIDE_BITS, _SMALL_SHARE), _beyond(BITS, _SMALL_SHARE)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LANES = (np.arange(1, WIDE_BITS // 64 + MINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """The set of shingles as ascending hashes of 64 bits."""
    words = _WORD.findall((text or "").translate(_UPPER))
    k = WIDE_SHINGLE
    grams = {" ".join(words)} if len(words) <= k else set(map(" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=len(grams)))


def _signature(h: np.ndarray) -> tuple[bytes, list[int]]:
    total, lanes = np.zeros(WIDE_BITS, dtype=np.int64), WIDE_BITS // 64
    for at in range(0, len(h), 255):
        bits = np.unpackbits(_mix(h[at : at + 255, None] ^ _LANES[:lanes]).view(np.uint8), axis=1, bitorder="little")
        total += bits.view(np.uint64).sum(axis=0).view(np.uint8)  # 255 rows fit in a byte for each bit
    mins = [int(_mix(h ^ c).min()) for c in _LANES[lanes:]]
    return np.packbits(2 * total > len(h), bitorder="little").tobytes(), mins


def wide_signature(text: str | None) -> tuple[bytes, list[int]]:
    """SimHash of WIDE_BITS bits over the set of shingles, and the minima of MINS hashes over it."""
    return _signature(shingle_hashes(text))


_SIGNED = T.StructType([T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("sig", T.BinaryType()), T.StructField("mins", T.ArrayType(T.LongType()))])


@F.pandas_udf(_SIGNED)
def _wide_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """fp: digest of the set of shingles; size: of the set."""
    forget()
    for texts in batches:
        rows = []
        for t in texts:
            h = shingle_hashes(t)
            sig, mins = _signature(h)
            rows.append((xxhash.xxh64_intdigest(h.tobytes()), len(h), sig, np.array(mins, dtype=np.uint64).view(np.int64)))
        out = pd.DataFrame(rows, columns=["fp", "size", "sig", "mins"])
        yield out.assign(fp=out["fp"].to_numpy(dtype=np.uint64).view(np.int64))


@F.pandas_udf(T.BinaryType())
def _set_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    forget()
    for texts in batches:
        yield pd.Series([shingle_hashes(t).tobytes() for t in texts])


def _wide_links(t: pa.Table, by: str, check: Callable[[np.ndarray], Check] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, i, j): the links of rows (by, fp, size, sig) within each value of ``by``, as positions in the order
    ``names`` of rows. ``check``: makes the check of pairs of positions in that order."""
    tries, size = t[by].to_numpy(), t["size"].to_numpy()
    words = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype="<u8").reshape(-1, WIDE_BITS // 64)
    order = np.lexsort((words[:, 0], tries))
    words, budgets = words[order], np.where(size[order] < SMALL, SMALL_BUDGET, WIDE_BUDGET)
    i, j = trie_links(np.ascontiguousarray(words[:, 0]), tries[order], FIRST_BUDGET, words, budgets, check and check(order))
    return order, i, j


_MEMBER = pa.schema([("low", pa.int64()), ("trie", pa.int64()), ("fp", pa.int64())])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (trie, fp, size, sig) those with a candidate in their trie, as (low, trie, fp): rows with the same low
    and trie are connected by candidates."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        order, i, j = _wide_links(t, "trie")
        if len(i):
            low = np.unique(j)
            at, of = order[np.r_[low, i]], order[np.r_[low, j]]
            tries, fps = t["trie"].to_numpy(), t["fp"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(fps[of]), pa.array(tries[at]), pa.array(fps[at])], schema=_MEMBER)

    yield from _whole_tries(batches, run)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of rows (trie, fp, size, sig, grams) sorted by trie, between sets whose similarity is at least SIMILARITY.

    The sets wait in an unnamed file, so only signatures and places are held."""
    with tempfile.TemporaryFile() as store:
        end = 0

        def put_away() -> Iterator[pa.RecordBatch]:
            nonlocal end
            for b in batches:
                at = []
                for x in b.column("grams"):
                    store.write(x.as_buffer())
                    at.append(end)
                    end += 8 * (len(x.as_buffer()) // 8)
                store.flush()
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("trie", "fp", "size", "sig")), pa.array(at, pa.int64())], names=["trie", "fp", "size", "sig", "at"])

        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            fps, size, at = t["fp"].to_numpy(), t["size"].to_numpy(), t["at"].to_numpy()

            def check(order: np.ndarray) -> Check:
                read = lambda k: np.frombuffer(os.pread(store.fileno(), 8 * int(size[k]), int(at[k])), dtype=np.uint64)
                return lambda i, j: np.fromiter((_similar(read(a), read(b)) for a, b in zip(order[i], order[j], strict=True)), dtype=bool, count=len(i))

            order, i, j = _wide_links(t, "trie", check)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fps[order[i]]), pa.array(fps[order[j]])], schema=_EDGE)

        yield from _whole_tries(put_away(), run)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two ascending arrays is at least SIMILARITY."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both) - 1e-9


def candidate_members(distinct: DataFrame) -> DataFrame:
    """(trie, fp) of rows (fp, size, sig, mins), one for each set: the sets that have a candidate, by the trie and
    group of candidates that they are in.

    Sets of similarity s have a given minimum in common with probability s, so near copies meet in one of the
    tries that the MINS minima name. A trie that a frequent passage makes large is dealt out by pairs of its parts, so
    candidates do not depend on SPLIT.
    """
    named = F.posexplode("mins").alias("k", "low")
    dealt = distinct.select("fp", "size", "sig", named).select(F.xxhash64("k", "low").alias("trie"), "fp", "size", "sig")
    keyed = split_large(dealt).repartition(F.col("trie")).sortWithinPartitions("trie")
    found = keyed.mapInArrow(_candidates, "low long, trie long, fp long")
    return found.select(F.xxhash64("trie", "low").alias("trie"), "fp")


def similar_edges(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of sets fp that connect what a similarity of at least SIMILARITY connects.

    ``signed``: rows (text_key, fp, size, sig, mins); ``texts``: (text_key, text). Only sets with a candidate are made
    again from their texts, and compared in full within each group of candidates.
    """
    members = written(candidate_members(signed.select("fp", "size", "sig", "mins").dropDuplicates(["fp"])), "candidates")
    if members.isEmpty():
        return signed.sparkSession.createDataFrame([], "a long, b long")
    needed = signed.join(members.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    one = texts.join(needed, "text_key").groupBy("fp").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("text").alias("text"))
    sets = written(one.select("fp", "size", "sig", _set_udf(F.col("text")).alias("grams")), "sets")
    keyed = members.join(sets, "fp").select("trie", "fp", "size", "sig", "grams").repartition(F.col("trie")).sortWithinPartitions("trie")
    return keyed.mapInArrow(_verified, "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies, the one with the smallest id
    (null ids last; ties by a hash of the text; rows that are equal in id and text once).

    Near copies are connected by links between texts whose sets of five-word shingles have a Jaccard similarity of at
    least SIMILARITY. Signatures make the candidates, and each link is checked on the sets. Rows are looked up in the
    list of the members of groups of several rows.
    """
    text_key = F.xxhash64(F.coalesce(col_of(text_col), F.lit("")))
    keys = docs.select(F.col(id_col).alias("doc_id"), text_key.alias("text_key"), _wide_udf(F.col(text_col)).alias("s"))
    signed = written(keys.select("doc_id", "text_key", "s.*"), "signatures")
    rows = signed.select("doc_id", "text_key", "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    by_fp = written(rows.groupBy("fp").agg(F.min(order).alias("best"), F.count("*").alias("n")), "distinct")
    groups = _components(similar_edges(signed, docs.select(text_key.alias("text_key"), col_of(text_col).alias("text"))))
    whole = by_fp.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Written, so that the join with it deals out both sides and a large component can be split.
    lows = written(whole.groupBy("component").agg(F.min("best").alias("best"), F.sum("n").alias("n")).where("n > 1"), "lows")
    shared = whole.select("fp", "component").join(lows.select("component", "best"), "component").select("fp", "best")
    members = rows.join(shared, "fp").select("doc_id", "text_key", (order == F.col("best")).alias("stay"))
    listed = written(members.groupBy("doc_id", "text_key").agg(F.max("stay").alias("stay"), F.count("*").alias("n")), "members")
    if listed.isEmpty():
        return docs
    i, t, stay, n = (fresh(docs, x) for x in ("id", "text_key", "stay", "n"))
    known = listed.select(F.col("doc_id").alias(i), F.col("text_key").alias(t), F.col("stay").alias(stay), F.col("n").alias(n))
    keyed = docs.withColumn(t, F.xxhash64(F.coalesce(col_of(text_col), F.lit(""))))
    own = [c if c != t else t for c in docs.columns]
    # Sorted on both sides at any size, so that the plan that is tested is the plan that runs on a large corpus.
    looked = keyed.join(known.withColumnRenamed(t, t + "r").hint("merge"), col_of(id_col).eqNullSafe(F.col(i)) & (F.col(t) == F.col(t + "r")), "left")
    kept = looked.where(F.col(stay).isNull() | F.col(stay))
    if listed.where("stay and n > 1").isEmpty():
        return kept.select(*[col_of(c) for c in own])
    once = kept.where(F.col(n).isNull() | (F.col(n) == 1))
    repeated = kept.where(F.col(n) > 1).dropDuplicates([id_col, t])
    return once.unionByName(repeated).select(*[col_of(c) for c in own])
