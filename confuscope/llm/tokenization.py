"""Token ids by the tokenizers library, with a memo for chunks of text.

A text is cut only where its tokenizer is bound to cut as well, so the ids of the chunks, each encoded
by the library, join to the ids of the text. Chunks recur, so most are looked up; new ones are encoded
many at a time, parted by a character that has a token of its own. Where the tokenizer lower-cases,
chunks that differ in case or in the punctuation behind them share the word they hold.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, islice
from string import punctuation

import numpy as np

from .common import remembers

#: Chunks that a worker remembers; when full it starts afresh. Bounds memory (about 200 bytes each), not results.
MEMO = 1_300_000
#: The characters of longer chunks are counted; with 16 for each place in the memo it counts as full too.
LONGEST = 64
#: Chunks encoded as one string.
BLOCK = 20

#: White space in a wide sense, the safe side for telling where a tokenizer is bound to cut.
_WIDE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | frozenset("\u180e\u200b\ufeff")
#: Stands before the first chunk of a text: a lone surrogate, which no valid text holds.
_FIRST = "\udfff"
_WIDE_OR_NONE = _WIDE | {""}
#: Lower-case letters below U+0100: one piece to a tokenizer that parts letters from the rest, and normal already.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_EVEN = re.compile(r"(?<![\s\u180e\u200b\ufeff]) (?![\s\u180e\u200b\ufeff])")


class Numbers(dict):
    """Numbers chunks as they are first looked up."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def _latin(text: str) -> bool:
    """Whether all characters lie below U+0100. There lower case is a matter of each character alone, and nothing composes."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Rules (normalizer, pre-tokenizer) under which a word of letters is one piece, whatever its case and the ASCII punctuation behind it.
_LOWERS = (
    r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])',
    r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), """
    "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])",
)


class ChunkEncoder:
    """Encodes by chunks; how texts may be cut follows from the tokenizer's own rules.

    "glue": before a single space between other characters (byte-level vocabularies, in which a space
    belongs to the next token); "drop": at any space or line feed (vocabularies that drop white space);
    "whole": not at all.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mode = self._mode()
        #: A character that always is a token of its own between chunks, and its id.
        self.part = {"glue": "\n", "drop": "|"}.get(self.mode, "")
        self.part_id = self.tokenizer.encode(self.part, add_special_tokens=False).ids[0] if self.part else -1
        #: The same model behind a plain cut at spaces, for words of letters alone; none if the rules do not allow it.
        self.plain, self.ends_word = self._plain()
        self._forget()

    def _mode(self) -> str:
        pre = str(self.tokenizer.pre_tokenizer)
        if self.tokenizer.normalizer is None and pre == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)":
            return "glue"
        if "behavior=Removed" in pre and r"[^\s\p{L}\p{N}]+" in pre and "invert=True" in pre and "Metaspace" not in pre:
            return "drop"
        return "whole"

    def _plain(self):
        """(tokenizer for lower-case words, whether an id ends a word), or (None, None)."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix or (str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)) != _LOWERS:
            return None, None
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return plain, ends

    def _forget(self) -> None:
        self.numbers, self.long = Numbers(), 0
        self.flat, self.used = np.zeros(1 << 12, dtype="<u4"), 0
        self.start, self.length = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int32)

    def _cut(self, text: str) -> list[str]:
        """Chunks without the space before them; the first one in "glue" mode has none and says so."""
        if self.mode == "whole":
            return [text]
        if self.plain and _latin(text):
            text = text.lower()
        return (text.replace("\n", " ") if self.mode == "drop" else _FIRST + text).split(" ")

    def _as_text(self, chunk: str) -> str:
        if self.mode != "glue":
            return chunk
        return chunk[1:] if chunk[:1] == _FIRST else " " + chunk

    def _ids(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _tails(self, first: int, chunks: list[str]) -> tuple[list[str | None], list[tuple[int, int, int]]]:
        """Chunks to encode, and (number, number of the word, number of what is behind it) of those that are joined from two;
        in the list these are None, and words and tails that are not known yet follow at its end."""
        numbers, joined, known = self.numbers, [], len(self.numbers)
        out: list[str | None] = list(chunks)
        for k, c in enumerate(chunks):
            word = c.rstrip(punctuation)
            if word and word != c and len(c) <= LONGEST and word[-1] < "\u0100" and word[-1].isalnum():
                joined.append((first + k, numbers[word], numbers[c[len(word) :]]))
                out[k] = None
        return out + list(islice(reversed(numbers), len(numbers) - known))[::-1], joined

    def _store(self, first: int, chunks: list[str]) -> None:
        """Encode the chunks numbered from ``first`` on. One that the tokenizer need not cut off from its
        neighbours ("glue" mode, white space at an end) gets the length -1."""
        chunks, joined = self._tails(first, chunks) if self.plain else (chunks, [])
        n = first + len(chunks)
        if n > len(self.start):
            self.start = np.resize(self.start, max(n, 2 * len(self.start)))
            self.length = np.resize(self.length, len(self.start))
        self.length[first:n] = -1
        part, glue, wide = self.part, self.mode == "glue", _WIDE
        easy, numbers, alone, words, of_words = [], [], [], [], []
        for k, c in enumerate(chunks, first):
            if c is None:
                pass
            elif self.plain and len(c) <= LONGEST and _LETTERS(c):
                words.append(c)
                of_words.append(k)
            elif not c:
                if not glue:
                    alone.append((k, c))
            elif glue and (c[0] in wide or c[-1] in wide or c[0] == _FIRST and c[1:2] in _WIDE_OR_NONE):
                pass
            elif part and part not in c and len(c) <= LONGEST and c[0] != _FIRST:
                easy.append(c)
                numbers.append(k)
            else:
                alone.append((k, self._as_text(c)))
        lead, between = (" ", "\n ") if glue else ("", " | ")
        for at in range(0, len(easy), 20_000):
            some = easy[at : at + 20_000]
            texts = [lead + between.join(some[i : i + BLOCK]) for i in range(0, len(some), BLOCK)]
            ids: list[int] = []
            for found in self._ids(texts):
                ids += found
                ids.append(self.part_id)
            all_ids = np.array(ids, dtype="<u4")
            ends = np.flatnonzero(all_ids == self.part_id)
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not part chunks as expected")
            lengths = np.diff(ends, prepend=-1) - 1
            self._keep(np.array(numbers[at : at + 20_000]), lengths, all_ids[all_ids != self.part_id])
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            found = self._ids([" ".join(some[i : i + BLOCK]) for i in range(0, len(some), BLOCK)], self.plain)
            all_ids = np.fromiter(chain.from_iterable(found), dtype="<u4")
            ends = np.flatnonzero(self.ends_word[all_ids])
            if len(ends) != len(some) or ends[-1] != len(all_ids) - 1:
                raise ValueError("the tokenizer does not end words as expected")
            self._keep(np.array(of_words[at : at + 20_000]), np.diff(ends, prepend=-1), all_ids)
        if alone:
            found = self._ids([t for _, t in alone])
            self._keep(np.array([k for k, _ in alone]), np.array([len(x) for x in found]), np.array([i for x in found for i in x], dtype="<u4"))
        if joined:
            both = np.array(joined)
            lengths = self.length[both[:, 1:]].astype(np.int64)
            ends, flat = np.cumsum(lengths), lengths.ravel()
            where = np.arange(int(ends[-1])) + np.repeat(self.start[both[:, 1:].ravel()] - (ends - flat), flat)
            self._keep(both[:, 0], lengths.sum(axis=1), self.flat[where])

    def _keep(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.used + len(ids), 2 * len(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used += len(ids)

    def _uneven(self, text: str) -> np.ndarray:
        """Ids of a text with spaces beside other white space or at its ends."""
        first, *rest = _EVEN.split(text)
        return np.array([i for x in self._ids([first, *[" " + c for c in rest]]) for i in x], dtype="<u4")

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; null counts as empty."""
        texts = list(texts)
        if len(self.numbers) > MEMO or self.long > 16 * MEMO:
            self._forget()
        numbers, first = self.numbers, len(self.numbers)
        cut = [self._cut(t) if t else [] for t in texts]
        counts = np.array([len(c) for c in cut], dtype=np.int64)
        index = np.fromiter(map(numbers.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(counts.sum()))
        if len(numbers) > first:
            new = list(islice(reversed(numbers), len(numbers) - first))[::-1]
            self._store(first, new)
            self.long += sum(len(c) for c in new if len(c) > LONGEST)
        lengths = self.length[index]
        bad = lengths < 0
        lengths = np.where(bad, 0, lengths).astype(np.int64)
        ends = np.cumsum(lengths)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[index] - (ends - lengths), lengths)
        ids = self.flat[where]
        edge = np.cumsum(counts)
        stops = np.r_[0, ends][edge] if len(edge) else edge
        out = np.split(ids, stops[:-1]) if len(stops) else []
        if bad.any():
            of_text = np.repeat(np.arange(len(cut)), counts)
            for k in np.unique(of_text[bad]):
                out[k] = self._uneven(texts[k])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker and vocabulary."""
    return ChunkEncoder(path)


remembers(encoder.cache_clear)
