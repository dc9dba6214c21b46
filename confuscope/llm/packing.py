"""Cost-balanced packing of documents into training sequences of bounded length.

The cost of a piece of L tokens is estimated as ``linear * L + quadratic * L * L`` (projections, and
attention within the piece). Documents are taken in descending order and each goes to the
sequence of the lowest cost that has room for it. What no sequence has room for is cut along the
free room, so a pool of documents fills its sequences but for the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokenization import encoder

CAPACITY = 2048
END_ID = 1
#: Sequences that are filled at once in a task; bounds memory and leaves one part-filled sequence at most.
POOL = 512
#: Cost of a token, and of a pair of tokens; a width of 4096 makes them equal at 24,576 tokens.
LINEAR, QUADRATIC = 1.0, 1.0 / 24_576


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one pool of documents.

    Every token lies in one piece; sequences are filled without gaps and there are
    ceil(tokens / capacity) of them. Equal lengths keep their order, equal costs take the first sequence.
    """
    total = int(lengths.sum())
    n = -(-total // capacity)
    used, cost = np.zeros(n, dtype=np.int64), np.zeros(n)
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(doc: int, start: int, length: int, seq: int) -> None:
        pieces.append((doc, start, length, seq, int(used[seq])))
        used[seq] += length
        cost[seq] += linear * length + quadratic * length * length

    full = 0  # whole sequences of long documents
    rests = []
    for doc, length in enumerate(lengths.tolist()):
        start = 0
        while length - start >= capacity:
            put(doc, start, capacity, full)
            full += 1
            start += capacity
        if length > start:
            rests.append((start - length, doc, start))
    # The last sequence holds what is left over, so the others fill up.
    room = np.full(n, capacity)
    room[n - 1 :] = total - (n - 1) * capacity if n else 0
    for negative, doc, start in sorted(rests):
        length = -negative
        while length:
            free = room - used
            fits = free >= length
            if fits.any():
                take, seq = length, int(np.argmin(np.where(fits, cost, np.inf)))
            else:
                seq = int(np.argmin(np.where(free > 0, cost, np.inf)))
                take = int(free[seq])
            put(doc, start, take, seq)
            start += take
            length -= take
    return pieces


OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                  ("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())])


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, pool: int = POOL, linear: float = LINEAR, quadratic: float = QUADRATIC,
) -> DataFrame:
    """A row for each piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, cost).

    ids: little-endian unsigned 32-bit. Each task packs its own documents in pools of ``pool``
    sequences, so nothing is shuffled and no source or group can make a task larger than its input
    split; pools, not documents, decide which documents share a sequence. Null and empty texts are
    the end token alone; repeated rows and null ids are packed like any other row; documents of any
    length are cut at the capacity; other columns are left out; an empty table gives no pieces.
    sequence_id is unique: the partition's number times 2 ** 33 plus a running number.
    """
    if capacity < 1 or pool < 2:
        raise ValueError("capacity and pool are too small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 33
        enc = encoder(tokenizer_path)
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            lengths = np.array([len(x) for _, x in held], dtype=np.int64)
            pieces = assign(lengths, capacity, linear, quadratic)
            for at in range(0, len(pieces), 2_000):
                some = pieces[at : at + 2_000]
                cols = [
                    [held[d][0] for d, *_ in some], [p[1] for p in some], [p[2] for p in some],
                    [held[d][1][s : s + n].tobytes() for d, s, n, *_ in some], [len(held[p[0]][1]) for p in some],
                    [next_id + p[3] for p in some], [p[4] for p in some], [linear * p[2] + quadratic * p[2] * p[2] for p in some],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
            next_id += -(-int(lengths.sum()) // capacity)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                    # A very long document leaves in whole pools first.
                    held.append((doc_id, ids))
                    size += len(ids)
                    if size >= pool * capacity:
                        yield from flush()
                        held.clear()
                        size = 0
        if held:
            yield from flush()

    rows = docs.select(F.col(id_col).cast(T.LongType()).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, OUT)
