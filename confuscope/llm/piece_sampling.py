"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and their decoding.

The lattice of a text has an arc for each vocabulary piece that fits between two of its characters.
Forward filtering sums the weights of all paths into every node; backward sampling draws arcs
from the end with the exact posterior. No piece spans the start of a word, so the lattice is a chain
of words' lattices: each distinct word is filtered once and all its occurrences are drawn from it. A
draw depends on the seed, the row's key and the character position only, so a row is always
segmented alike, wherever and in whatever batch it is processed.

The vocabulary's model ranks pieces by merge order and has no probabilities, so a piece of rank r
weighs 1 / (r + 2), the usual law of word frequencies, to the power ``alpha``. Characters
that no piece holds become byte pieces. Decoding gives back the text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget
from .tokenization import Numbers

SEED = 7
ALPHA = 0.5
SPACE = "▁"
#: A literal U+2581 of the text, during encoding: a lone surrogate, which no valid text holds.
LITERAL = "\udc81"
#: Words whose lattices a worker keeps, and the length from which their characters are counted too: with 16
#: for each place it starts afresh as well. Bounds memory, not results.
KEPT, LONGEST = 450_000, 48
#: Characters encoded at once, and rows of a batch that are turned into Python objects at once.
GROUP, ROWS = 1_000_000, 500

_WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_B3 = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B2
    x = (x ^ (x >> np.uint64(27))) * _B3
    return x ^ (x >> np.uint64(31))


class PieceModel:
    """The vocabulary as hash tables of pieces and of their prefixes, by length."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k) for k in range(self.size)]
        self.bytes_at = np.full(256, -1, dtype=np.int64)
        self.raw: list[bytes] = []
        usable: dict[str, int] = {}
        for k, p in enumerate(self.pieces):
            if sp.is_byte(k):
                self.bytes_at[int(p[3:5], 16)] = k
                self.raw.append(bytes([int(p[3:5], 16)]))
            else:
                self.raw.append(p.replace(SPACE, " ").encode())
                if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                    usable.setdefault(p, k)
        if (self.bytes_at < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in usable):
            raise ValueError("pieces span the start of a word")
        self.weight = np.zeros(self.size)
        first = min(usable.values())
        for k in usable.values():
            self.weight[k] = -alpha * np.log(k - first + 2)
        self.unknown = -alpha * np.log(self.size + 2) * 2
        by_len: dict[int, dict[int, int]] = {}
        self.longest = max(map(len, usable))
        for p, k in usable.items():
            h = 0
            for i, c in enumerate(p):
                h = (h * int(_B1) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                at = by_len.setdefault(i + 1, {})
                at.setdefault(h, -1)
            by_len[len(p)][h] = k
        self.tables = {}
        for n, at in by_len.items():
            h = np.array(sorted(at), dtype=np.uint64)
            self.tables[n] = h, np.array([at[int(x)] for x in h], dtype=np.int64)

    def arcs(self, codes: np.ndarray, limit: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(starts, length, pieces) by length of all pieces in ``codes``, those of one character first; limit:
        the end of each position's word. A character that is no piece gets a code of its own."""
        pos, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        out = []
        for n in range(1, self.longest + 1):
            ok = pos + n <= limit[pos]
            pos, h = pos[ok], h[ok]
            if not len(pos):
                break
            h = h * _B1 + codes[pos + n - 1] + np.uint64(1)
            table, ids = self.tables[n]
            at = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[at] == h
            pos, h, found = pos[hit], h[hit], ids[at[hit]]
            real = found >= 0
            if n == 1:
                every = self.size + codes.astype(np.int64)
                every[pos[real]] = found[real]
                out.append((np.arange(len(codes)), 1, every))
            else:
                out.append((pos[real], n, found[real]))
        return out


@lru_cache(maxsize=2)
def piece_model(path: str, alpha: float = ALPHA) -> PieceModel:
    return PieceModel(path, alpha)


class _Column:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.data, self.n = np.zeros(1 << 10, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            grown = np.zeros(max(end, len(self.data) * 3 // 2), dtype=self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : end] = values
        self.n = end


class Lattices:
    """Filtered lattices of words. Nodes are numbered through; node ``base[w] + t`` is the place
    after t characters of word w. Arcs into a node lie together, with cumulative probabilities."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index, self.long = Numbers(), 0
        self.base, self.length, self.ptr = _Column(np.int64), _Column(np.int64), _Column(np.int64)
        self.ptr.extend(np.zeros(1))
        self.cum, self.back, self.piece = _Column(np.float32), _Column(np.uint8), _Column(np.int32)

    def add(self, words: list[str]) -> None:
        """Forward filtering of new words, all at once: by the number of characters before a node."""
        model = self.model
        lens = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        first = np.cumsum(lens) - lens
        word_of = np.repeat(np.arange(len(words)), lens)
        groups = model.arcs(codes, (first + lens)[word_of])
        # Node of a place: characters before it, plus one for each word before. Of one length, a node has
        # one arc at most, so arcs are dealt to their places length by length.
        ends = [start + word_of[start] + n for start, n, _ in groups]
        nodes = len(codes) + len(words)
        counts = np.zeros(nodes, dtype=np.int64)
        for target in ends:
            counts[target] += 1
        ptr = np.r_[0, np.cumsum(counts)]
        n_arcs = int(ptr[-1])
        length, piece, weight = np.empty(n_arcs, dtype=np.uint8), np.empty(n_arcs, dtype=np.int64), np.empty(n_arcs)
        filled = np.zeros(nodes, dtype=np.int64)
        for (_, n, found), target in zip(groups, ends, strict=True):
            slot = ptr[target] + filled[target]
            filled[target] += 1
            length[slot], piece[slot] = n, found
            weight[slot] = np.where(found < model.size, model.weight[np.minimum(found, model.size - 1)], model.unknown)
        total = np.full(nodes, -np.inf)
        total[first + np.arange(len(words))] = 0.0
        depth = np.arange(nodes) - np.repeat(first + np.arange(len(words)), lens + 1)
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(1, int(lens.max(initial=0)) + 2))
        cum = np.empty(n_arcs, dtype=np.float32)
        for t in range(1, int(lens.max(initial=0)) + 1):
            at = by_depth[edges[t - 1] : edges[t]]
            c = counts[at]
            offs = np.cumsum(c) - c
            arcs = np.arange(int(c.sum())) - np.repeat(offs - ptr[at], c)
            score = total[np.repeat(at, c) - length[arcs]] + weight[arcs]
            total[at] = np.logaddexp.reduceat(score, offs)
            # Shares of the arcs, added up arc by arc so that they do not depend on the words around.
            share = np.exp(score - np.repeat(total[at], c))
            run = np.zeros(len(at))
            for k in range(int(c.max())):
                some = np.flatnonzero(c > k)
                run[some] += share[offs[some] + k]
                cum[arcs[offs[some] + k]] = run[some]
            cum[arcs[offs + c - 1]] = 2.0  # the last arc takes what rounding leaves
        self.long += int(lens[lens > LONGEST].sum())
        self.base.extend(first + np.arange(len(words)) + self.ptr.n - 1)
        self.length.extend(lens)
        self.ptr.extend(ptr[1:] + self.ptr.data[self.ptr.n - 1])
        self.cum.extend(cum)
        self.back.extend(length)
        self.piece.extend(piece)

    def sample(self, word: np.ndarray, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of all occurrences: (pieces in order, number for each occurrence).

        word: the word of each occurrence; place: its first character in the row; key: of the row.
        """
        ptr, cum, piece, back = self.ptr.data, self.cum.data, self.piece.data, self.back.data
        left = self.length.data[word]
        node = self.base.data[word] + left
        live = np.flatnonzero(left > 0)
        steps, number = [], np.zeros(len(word), dtype=np.int64)
        while len(live):
            at, end = node[live], (place[live] + left[live]).astype(np.uint64)
            arc, last = ptr[at], ptr[at + 1] - 1
            many = np.flatnonzero(last > arc)
            u = ((_mix(key[live[many]] + end[many] * _B1) >> np.uint64(40)) * 2.0**-24).astype(np.float32)
            chosen = arc[many]
            going = np.flatnonzero(u >= cum[chosen])
            while len(going):
                chosen[going] += 1
                going = going[u[going] >= cum[chosen[going]]]
            arc[many] = chosen
            steps.append((live, piece[arc], number[live]))
            number[live] += 1
            step = back[arc]
            node[live] -= step
            left[live] -= step
            live = live[left[live] > 0]
        offs = np.cumsum(number) - number
        out = np.zeros(int(number.sum()), dtype=np.int64)
        for which, found, k in steps:
            out[offs[which] + number[which] - 1 - k] = found
        return out, number


def row_keys(doc_ids: list[int | None], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"null" if d is None else str(d).encode(), seed & 0xFFFFFFFFFFFFFFFF) for d in doc_ids], dtype=np.uint64)


def encode_rows(lattices: Lattices, doc_ids: list[int | None], texts: list[str | None], seed: int) -> list[np.ndarray]:
    """Sampled pieces of each text; null and empty texts have none."""
    model, keys = lattices.model, row_keys(doc_ids, seed)
    cut = [_WORD.findall(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
    flat = [w for words in cut for w in words]
    if not flat:
        return [np.zeros(0, dtype="<i4") for _ in texts]
    if len(lattices.index) > KEPT or lattices.long > 16 * KEPT:
        lattices.clear()
    known = len(lattices.index)
    word = np.fromiter(map(lattices.index.__getitem__, flat), dtype=np.int64, count=len(flat))
    if len(lattices.index) > known:
        lattices.add(list(islice(reversed(lattices.index), len(lattices.index) - known))[::-1])
    counts = np.array([len(w) for w in cut])
    row = np.repeat(np.arange(len(cut)), counts)
    lens = lattices.length.data[word]
    run = np.cumsum(lens) - lens
    starts = np.cumsum(counts) - counts
    place = run - run[np.minimum(starts, len(run) - 1)][row]
    pieces, number = lattices.sample(word, place, keys[row])
    pieces, widths = _with_bytes(pieces, model)
    of_occurrence = np.repeat(np.arange(len(word)), number)
    of_row = np.bincount(row[of_occurrence], weights=widths, minlength=len(cut)).astype(np.int64)
    return np.split(pieces.astype("<i4"), np.cumsum(of_row)[:-1])


def _with_bytes(pieces: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Codes of characters beyond the vocabulary become their bytes' pieces; and the number of pieces that
    each one becomes."""
    widths = np.ones(len(pieces), dtype=np.int64)
    at = np.flatnonzero(pieces >= model.size)
    if not len(at):
        return pieces, widths
    codes, which = np.unique(pieces[at] - model.size, return_inverse=True)
    raw = [(SPACE if chr(c) == LITERAL else chr(c)).encode() for c in codes.tolist()]
    width = np.array([len(r) for r in raw])
    table = np.array([model.bytes_at[list(r.ljust(4, b"\0"))] for r in raw])
    widths[at] = width[which]
    out, first = np.repeat(pieces, widths), np.cumsum(widths) - widths
    for k in range(4):
        some = width[which] > k
        out[first[at[some]] + k] = table[which[some], k]
    return out, widths


def decode_ids(model: PieceModel, ids: np.ndarray) -> str:
    """The text; control ids count as nothing."""
    raw = model.raw
    return b"".join([raw[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


_PIECES = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])


def _groups(batch: pa.RecordBatch, chars: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for lo in range(0, batch.num_rows, ROWS):
        part = batch.slice(lo, ROWS)
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text or "")
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def sample_pieces(
    docs: DataFrame, model_path: str, seed: int = SEED, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, ids) of every row; ids are little-endian 32-bit integers.

    Null and empty texts have no pieces; repeated rows and null ids are segmented alike for alike
    texts; texts are read whole, in groups of bounded size; other columns are left out; an empty table gives
    an empty result. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        lattices = Lattices(piece_model(model_path, alpha))
        for batch in batches:
            for ids, texts in _groups(batch, GROUP):
                found = encode_rows(lattices, ids, texts, seed)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], schema=_PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text) of the output of sample_pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = [None if x is None else decode_ids(model, np.frombuffer(x, dtype="<i4")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], schema=_TEXTS)

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
