"""Exact deduplication through a sharded cuckoo-filter index of live contents.

A document's content is its text without ASCII white space. It is named by a key: its SHA-256, then what verifies it, a
second, independent hash (XXH64) and its length. The index is split into shards; each shard is a cuckoo filter of short
fingerprints in front of a store, in which full keys lie in the bucket that their leading bytes name. A probe that misses
the filter is new for certain; a hit is verified against the keys in its bucket, so contents that agree in the
SHA-256 alone stay apart. Deletions remove one fingerprint; an overflow doubles the filter and refills it from the
stored keys.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, col_of, forget, fresh, written


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, zero for a free slot; the alternative bucket follows from bucket and
    fingerprint."""

    SLOTS = 4
    KICKS = 200

    def __init__(self, capacity: int = 1024, table: bytes | None = None) -> None:
        n = 1 << max(2, (max(1, capacity) * 5 // (4 * self.SLOTS)).bit_length())
        self.table = array("H", bytes(2 * self.SLOTS * n) if table is None else table)
        self.n_buckets = len(self.table) // self.SLOTS
        self.count = sum(fp > 0 for fp in self.table) if table else 0
        self._turn = 0

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _at(self, key: bytes) -> tuple[int, int]:
        fp = int.from_bytes(key[8:10], "little") or 1
        return fp, int.from_bytes(key[10:18], "little") & (self.n_buckets - 1)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.n_buckets - 1)

    def _slot(self, bucket: int, fp: int) -> int:
        """The place of a fingerprint in a bucket, -1 if it is not there."""
        at = bucket * self.SLOTS
        for k in range(at, at + self.SLOTS):
            if self.table[k] == fp:
                return k
        return -1

    def __contains__(self, key: bytes) -> bool:
        fp, i = self._at(key)
        return self._slot(i, fp) >= 0 or self._slot(self._other(i, fp), fp) >= 0

    def _place(self, bucket: int, fp: int) -> bool:
        free = self._slot(bucket, 0)
        if free >= 0:
            self.table[free] = fp
            self.count += 1
        return free >= 0

    def insert(self, key: bytes) -> bool:
        """False if there was no room; one fingerprint is then missing, so the caller must rebuild."""
        fp, i = self._at(key)
        if self._place(i, fp) or self._place(self._other(i, fp), fp):
            return True
        for _ in range(self.KICKS):
            self._turn = (self._turn + 1) % self.SLOTS
            at = i * self.SLOTS + self._turn
            fp, self.table[at] = self.table[at], fp
            i = self._other(i, fp)
            if self._place(i, fp):
                return True
        return False

    def delete(self, key: bytes) -> bool:
        """Only for keys that are in: removes one copy of the fingerprint."""
        fp, i = self._at(key)
        for b in (i, self._other(i, fp)):
            at = self._slot(b, fp)
            if at >= 0:
                self.table[at] = 0
                self.count -= 1
                return True
        return False


class KeyIndex:
    """Live keys with a value each: the filter answers most misses, buckets hold the truth."""

    def __init__(self, capacity: int = 1024) -> None:
        self.filter = CuckooFilter(capacity)
        self.store: dict[bytes, dict[bytes, tuple]] = {}
        self.size = self.resizes = self.false_hits = 0

    def _keys(self) -> Iterator[bytes]:
        for bucket in self.store.values():
            yield from bucket

    def _resize(self) -> None:
        capacity = self.size
        while True:
            capacity *= 2
            self.resizes += 1
            grown = CuckooFilter(max(64, capacity))
            if all(grown.insert(k) for k in self._keys()):
                self.filter = grown
                return

    def get(self, key: bytes) -> tuple | None:
        if key not in self.filter:
            return None
        found = self.store.get(key[:3], {}).get(key)
        self.false_hits += found is None
        return found

    def put(self, key: bytes, value: tuple) -> None:
        """Insert, or replace the value of a live key."""
        bucket = self.store.setdefault(key[:3], {})
        new = key not in bucket
        bucket[key] = value
        if new:
            self.size += 1
            if not self.filter.insert(key):
                self._resize()

    def delete(self, key: bytes) -> bool:
        bucket = self.store.get(key[:3], {})
        if key not in self.filter or key not in bucket:
            return False
        del bucket[key]
        self.size -= 1
        return self.filter.delete(key)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for bucket in self.store.values():
            yield from bucket.items()


#: A row for each live key, or for each row that comes or goes. n: rows with that key; keep_*: the row that stays,
#: by most code points, then smallest id, then smallest row number.
STATE = "key binary, n long, keep_chars long, keep_id long, keep_row long"
_STATE = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("keep_chars", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64())])
_LAST = 1 << 63
#: Stands for the characters of a key whose row that stays must be found again.
STALE = -1
#: Distinct keys that a task gathers before it passes them on; bounds its memory, not the result.
GATHERED = 100_000
#: Keys of a shard, about: what a task holds at some 300 bytes each.
SHARD_KEYS = 500_000


def _rank(value: tuple) -> tuple:
    _, chars, doc_id, row = value
    return -chars, doc_id is None, doc_id if doc_id is not None else 0, _LAST if row is None else row


def _merge(old: tuple | None, new: tuple) -> tuple:
    if old is None:
        return new
    best = min(old, new, key=_rank)
    return (old[0] + new[0], *best[1:])


def _emit(items) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for key, value in items:
        rows.append((key, *value))
        if len(rows) == 20_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATE, strict=True)], schema=_STATE)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal keys within a task, before the shuffle: a hot text costs one row a task."""
    forget()
    best: dict[bytes, tuple] = {}
    for batch in batches:
        for key, *value in _rows(batch):
            best[key] = _merge(best.get(key), tuple(value))
        if len(best) >= GATHERED:
            yield from _emit(best.items())
            best = {}
    yield from _emit(best.items())


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard of the index takes its rows in: n > 0 adds n rows, n < 0 removes as many."""
    forget()
    index, removals = KeyIndex(), []
    for batch in batches:
        for key, *value in _rows(batch):
            if value[0] < 0:
                removals.append((key, value[0]))
            else:
                index.put(key, _merge(index.get(key), tuple(value)))
    for key, n in removals:
        old = index.get(key)
        if old is not None and old[0] + n <= 0:
            index.delete(key)
        elif old is not None:
            index.put(key, (old[0] + n, STALE, None, None))
    yield from _emit(index.items())


@dataclass(frozen=True)
class Index:
    """state: a row of STATE for each live key; live: one for each live (key, keep_chars, keep_id), the content that
    deletions are checked against and that the row that stays is found in."""

    state: DataFrame
    live: DataFrame


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "keep_chars", "keep_id").agg(F.sum("n").alias("n"), F.min("keep_row").alias("keep_row")).select("key", "n", "keep_chars", "keep_id", "keep_row")


def shard_count(spark, n: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_KEYS))


def update_index(rows: DataFrame, index: Index | None = None, shards: int | None = None) -> Index:
    """The index after taking in ``rows`` (columns of STATE; n = 1 for an insertion, n = -1 for a deletion of
    a row with that key, keep_chars and keep_id).

    Insertions come first. A deletion of a row that is not live does nothing; when no row of a key is left the
    key goes, else the row that stays is the best one of those left. Null keys are left out. Shards are
    hash partitions of the key; ``shards``: their number, by default after the number of rows.
    """
    rows = rows.select("key", "n", "keep_chars", "keep_id", "keep_row").where("key is not null")
    come, go = rows.where("n >= 0"), rows.where("n < 0")
    spark = rows.sparkSession
    shards = shards or shard_count(spark, rows.count() + (index.state.count() if index else 0))
    todo = come.mapInArrow(_gather, STATE)
    if index is None:
        state = todo.repartition(shards, F.col("key")).mapInArrow(_index, STATE)
        live = _summed(come)
        if go.isEmpty():
            return Index(state, live)
        index = Index(written(state, "state"), written(live, "live"))
        todo, come = come.limit(0), come.limit(0)
    have = _summed(index.live.unionByName(come))
    same = F.col("keep_id").eqNullSafe(F.col("go_id")) & (F.col("key") == F.col("go_key")) & (F.col("keep_chars") == F.col("go_chars"))
    gone = go.groupBy(F.col("key").alias("go_key"), F.col("keep_chars").alias("go_chars"), F.col("keep_id").alias("go_id")).agg((-F.sum("n")).alias("gone"))
    left = written(have.join(gone, same, "left").select("key", F.least(F.coalesce("gone", F.lit(0)), F.col("n")).alias("gone"), "n", "keep_chars", "keep_id", "keep_row"), "live")
    removed = left.groupBy("key").agg((-F.sum("gone")).alias("n")).where("n < 0")
    none = F.lit(None).cast("long")
    todo = todo.unionByName(index.state.select(*rows.columns)).unionByName(removed.select("key", "n", none.alias("keep_chars"), none.alias("keep_id"), none.alias("keep_row")))
    state = written(todo.repartition(shards, F.col("key")).mapInArrow(_index, STATE), "state")
    live = left.where("gone < n").withColumn("n", F.col("n") - F.col("gone")).drop("gone")
    order = F.struct((-F.col("keep_chars")).alias("c"), F.col("keep_id").isNull().alias("none"), "keep_id", "keep_chars", "keep_row")
    stale = state.where(F.col("keep_chars") == STALE)
    again = live.join(stale.select("key"), "key").groupBy("key").agg(F.sum("n").alias("n"), F.min(order).alias("best")).select("key", "n", "best.keep_chars", "best.keep_id", "best.keep_row")
    return Index(state.where(F.col("keep_chars") != STALE).unionByName(again), live)


FILTERS = "shard int, filter binary"


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for shard, key in _rows(batch):
            held.setdefault(shard, []).append(key)
    for shard, keys in held.items():
        made, size = CuckooFilter(len(keys)), len(keys)
        while not all(made.insert(k) for k in keys):
            size *= 2
            made = CuckooFilter(size)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made.to_bytes()], pa.binary())], names=["shard", "filter"])


def filters(state: DataFrame, shards: int) -> DataFrame:
    """(shard, filter): the filters of an index, two to five bytes a key, to be kept beside it."""
    rows = state.select(_shard(shards).alias("shard"), "key")
    return rows.repartition(shards, F.col("shard")).mapInArrow(_filters, FILTERS)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, filter, key) with a shard's filter before its keys."""
    forget()
    now, table = None, None
    for batch in batches:
        out = []
        for shard, blob, key in _rows(batch):
            if blob is not None:
                now, table = shard, CuckooFilter(table=blob)
            elif now == shard and key in table:
                out.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["key"])


def find_live(keys: DataFrame, state: DataFrame, kept_filters: DataFrame, shards: int) -> DataFrame:
    """The rows of ``state`` for those ``keys`` that are live. Keys that miss the filters are new and are not looked up;
    hits are verified against the stored keys. Repeated and null keys count once and not at all; an empty table finds nothing."""
    asked = keys.select("key").where("key is not null").distinct().select(_shard(shards).alias("shard"), F.lit(None).cast("binary").alias("filter"), "key")
    both = kept_filters.select("shard", "filter", F.lit(None).cast("binary").alias("key")).unionByName(asked)
    probed = both.repartition(shards, F.col("shard")).sortWithinPartitions("shard", F.col("filter").isNull()).mapInArrow(_hits, "key binary")
    return state.join(probed, "key")


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+", "")


def content_key(text: Column) -> Column:
    """The key of a text's content: 32 bytes of SHA-256, eight of XXH64 and eight of length; never null."""
    content = normalised(text)
    number = lambda n: F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(F.sha2(content.cast("binary"), 256), number(F.xxhash64(content)), number(F.char_length(content).cast("long"))))


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, key, chars) of every row; JVM-side only."""
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), content_key(F.col(text_col)).alias("key"),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("chars"),
    )


def _as_state(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.lit(1).cast("long").alias("n"), F.col("chars").alias("keep_chars"),
                       F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: (doc_id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the most code points stays, then the smallest id (null ids last);
    repeated rows (equal id and text) keep exactly one of them. Null texts count as empty, and all
    empty texts are one group. Other columns are left out; an empty table gives an empty result.
    Keys are written to the shared folder once; texts are not shuffled.
    """
    rows = written(keys_of(docs, id_col, text_col), "keys")
    state = written(update_index(_as_state(rows)).state, "index")
    joined = rows.join(state, "key")
    return joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row_id") == F.col("keep_row")).alias("kept"),
                         F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were, whatever their names.

    Without duplicates in the index the rows pass as they are; otherwise they are looked up by key in
    the list of groups, a join that adaptive execution splits where one text is very frequent.
    """
    rows = written(keys_of(docs, id_col, text_col), "keys")
    groups = written(update_index(_as_state(rows)).state.where("n > 1"), "groups")
    if groups.isEmpty():
        return docs
    key, chars, keep, at = (fresh(docs, x) for x in ("key", "chars", "keep_id", "keep_chars"))
    tied = fresh(docs, "tied")
    # Rows that tie with the one that stays in all that can be compared.
    ties = rows.join(groups, "key").where("doc_id <=> keep_id and chars = keep_chars").groupBy("key").agg(F.count("*").alias("tied"))
    known = written(groups.join(ties, "key").select(
        F.col("key").alias(key), F.col("keep_id").alias(keep), F.col("keep_chars").alias(at), F.col("tied").alias(tied)), "known")
    keyed = docs.withColumn(key, content_key(F.col(text_col)))
    keyed = keyed.withColumn(chars, F.coalesce(F.char_length(col_of(text_col)), F.lit(0)).cast("long"))
    # Sorted on both sides at any size, so that the plan that is tested is the plan that runs on a large corpus.
    looked = keyed.join(known.hint("merge"), key, "left")
    stays = looked.where(F.col(tied).isNull() | (col_of(id_col).cast("long").eqNullSafe(F.col(keep)) & (F.col(chars) == F.col(at))))
    if known.where(F.col(tied) > 1).isEmpty():
        return stays.select(*[col_of(c) for c in docs.columns])
    once = stays.where(F.col(tied).isNull() | (F.col(tied) == 1))
    repeated = stays.where(F.col(tied) > 1).dropDuplicates([key])
    return once.unionByName(repeated).select(*[col_of(c) for c in docs.columns])
