"""Token files of independent zstandard frames, in the public seekable format.

A file is a frame for each document (its ids, little-endian, with a content checksum), then a
skippable frame with the directory of documents, then the seek table: a skippable frame with each
frame's compressed and decompressed size and the low 32 bits of the XXH64 of its content. A reader
takes the tail, then only the frames of the documents it wants. Any zstandard tool can decompress a file.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, work_path, written
from .tokenization import encoder

END_ID = 1
#: Magic numbers of the seekable format.
SEEK_FRAME, SEEK_FOOTER, DIRECTORY_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: Documents in a file, about; files follow the input, not the cluster.
FILE_DOCS = 1 << 12
#: Files at most, as their list is read by the driver; beyond it files grow. And ids that are sampled for each.
MOST_FILES, SAMPLED = 100_000, 16


def make_frame(ids: np.ndarray, width: int) -> tuple[bytes, int]:
    """A frame and the checksum of its content."""
    raw = ids.astype("<u2" if width == 2 else "<u4").tobytes()
    return _compressor().compress(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)


class FrameWriter:
    """Appends frames to an open file and closes it with directory and seek table."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.docs: list[int | None] = []
        self.sizes: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, frame: bytes, n_ids: int, checksum: int) -> None:
        self.out.write(frame)
        self.docs.append(doc_id)
        self.sizes.append((len(frame), n_ids * self.width, checksum))

    def close(self) -> None:
        directory = zstandard.compress(json.dumps({"width": self.width, "doc_ids": self.docs}).encode())
        self.out.write(struct.pack("<II", DIRECTORY_FRAME, len(directory)) + directory)
        # The directory is a frame of the file too; its entry keeps offsets right for other readers.
        table = [*self.sizes, (8 + len(directory), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *x) for x in table) + struct.pack("<IBI", len(table), 0x80, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(body)) + body)


class FrameReader:
    """Random access: reads the tail once, then single frames."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER or flags != 0x80:
            raise ValueError("not a seekable file with checksums")
        table = self._at(size - 9 - 12 * n, 12 * n)
        if struct.unpack("<II", self._at(size - 17 - 12 * n, 8)) != (SEEK_FRAME, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.entries = np.frombuffer(table, dtype="<u4").reshape(-1, 3)
        self.offsets = np.r_[0, np.cumsum(self.entries[:, 0], dtype=np.int64)]
        head = self._at(int(self.offsets[n - 1]), int(self.entries[n - 1, 0]))
        meta = json.loads(zstandard.decompress(head[8:]))
        self.width, self.doc_ids = meta["width"], meta["doc_ids"]

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document; a wrong checksum raises."""
        size, raw_size, checksum = self.entries[k].tolist()
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), size), max_output_size=max(raw_size, 1))
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, dtype="<u2" if self.width == 2 else "<u4").astype("<u4")


def open_store(uri: str):
    """(filesystem, path) of a uri; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --------------------------------------------------------------------------------------------- writing

_FRAME = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_ids", pa.int64()), ("checksum", pa.int64()), ("frame", pa.binary())])
_FRAME_SQL = "part int, doc_id long, tie long, n_ids long, checksum long, frame binary"
_FILE = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_FILE_SQL = "part int, path string, n_docs long, n_ids long, low long, high long"


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes of an id in the files: two if all ids of the vocabulary fit, else four."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def bounds(docs: DataFrame, id_col: str, n: int, n_docs: int) -> np.ndarray:
    """n - 1 ids at most that split the documents about evenly, from a sample of SAMPLED ids for each file; reads the id
    column only. They decide which documents share a file, nothing else; an id with the rows of several files repeats."""
    share = min(1.0, SAMPLED * n / max(n_docs, 1))
    ids = docs.select(F.col(id_col).cast("long").alias("x")).where("x is not null")
    found = np.sort((ids if share == 1.0 else ids.sample(share, 1)).toArrow()["x"].to_numpy())
    return found[np.arange(1, n) * len(found) // n] if n > 1 and len(found) else np.zeros(0, dtype=np.int64)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, out: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, files: int | None = None,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files; returns the written manifest
    (part, path, n_docs, n_ids, low, high: the smallest and largest doc_id, null if the file has none). Files in order of part, and documents within them, ascend by doc_id.

    ``files``: number of files; by default follows the number of documents. Null ids come first, and
    documents of one id are ordered by a hash of their text; an id that has the rows of several files
    is spread over them in that order. Null texts are the end id alone. Texts are encoded where they
    are read; only compressed frames are shuffled. Other columns are left out; an empty table gives
    an empty manifest. A file is written under a name of its attempt and then renamed, so retried
    tasks leave whole files only.
    """
    spark = docs.sparkSession
    out = out or work_path(spark, "tokens")
    n_docs = docs.count()
    if files is None:
        files = max(1, min(MOST_FILES, -(-n_docs // FILE_DOCS)))
    cuts = bounds(docs, id_col, int(files), n_docs)
    width = id_width(tokenizer_path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                doc_ids, ties = part.column(0).to_pylist(), part.column(1).to_pylist()
                frames, sizes, sums, where = [], [], [], []
                for doc_id, tie, ids in zip(doc_ids, ties, enc.encode(part.column(2).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    frame, checksum = make_frame(ids, width)
                    frames.append(frame)
                    sizes.append(len(ids))
                    sums.append(checksum)
                    if doc_id is None:
                        where.append(0)
                    else:
                        a, b = np.searchsorted(cuts, doc_id, "left"), np.searchsorted(cuts, doc_id, "right")
                        where.append(int(a + (int(b - a + 1) * (tie + (1 << 63)) >> 64)))
                cols = (where, doc_ids, ties, sizes, sums, frames)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FRAME, strict=True)], schema=_FRAME)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()  # a worker that has encoded before needs its memo no more
        context = TaskContext.get()
        fs, folder = open_store(out)
        fs.create_dir(folder, recursive=True)
        now, done = None, []

        def finish() -> None:
            part, writer, stream, temp, n_ids = now
            writer.close()
            stream.close()
            fs.move(temp, f"{folder}/part-{part:06d}.tokens")
            # Documents ascend and null ids come first.
            last = writer.docs[-1]
            done.append((part, f"{out}/part-{part:06d}.tokens", len(writer.docs), n_ids, next((d for d in writer.docs if d is not None), None), last))

        for batch in batches:
            for part, doc_id, _, n_ids, checksum, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != part:
                    if now:
                        finish()
                    temp = f"{folder}/.part-{part:06d}-{context.taskAttemptId()}"
                    stream = fs.open_output_stream(temp)
                    now = [part, FrameWriter(stream, width), stream, temp, 0]
                now[1].add(doc_id, frame, n_ids, checksum)
                now[4] += n_ids
        if now:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _FILE, strict=True)], schema=_FILE)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(text_col).alias("text"))
    frames = rows.mapInArrow(encode, _FRAME_SQL)
    dealt = frames.repartition(int(files), F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    return written(dealt.mapInArrow(store, _FILE_SQL), "manifest")


# --------------------------------------------------------------------------------------------- reading

_DOC = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_tokens(manifest: DataFrame, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids) of the documents in the files; with ``doc_ids`` only the files that may have
    them are opened, and only their frames are decompressed. start counts the ids of all documents before it in all
    files.

    The offsets of files are summed up from the manifest, which has a row for each file.
    """
    spark: SparkSession = manifest.sparkSession
    wanted = None if doc_ids is None else frozenset(doc_ids)
    # A row for each file: bounded by the number of files, which are of a fixed size.
    files = sorted(tuple(r) for r in manifest.select("part", "path", "n_ids", "low", "high").collect())
    asked = None if wanted is None else sorted(d for d in wanted if d is not None)
    base, rows = 0, []
    for part, path, n_ids, low, high in files:
        near = asked is None or None in wanted or high is not None and bisect_left(asked, low) < bisect_right(asked, high)
        if near:
            rows.append((part, path, base))
        base += n_ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part, path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_store(path)
                with fs.open_input_file(at) as source:
                    reader, held, size = FrameReader(source), [], 0
                    for k, doc_id in enumerate(reader.doc_ids):
                        n = int(reader.entries[k, 1]) // reader.width
                        if wanted is None or doc_id in wanted:
                            ids = reader.ids(k).tobytes()
                            held.append((part, doc_id, start, n, ids))
                            size += len(ids)
                            if size > 4 << 20:
                                yield _docs(held)
                                held, size = [], 0
                        start += n
                    if held:
                        yield _docs(held)

    listed = spark.createDataFrame(rows, "part int, path string, start long")
    return listed.repartition(max(1, len(rows)), "part").mapInArrow(load, "part int, doc_id long, start long, n_tokens long, ids binary")


def _docs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DOC, strict=True)], schema=_DOC)
