from collections import defaultdict

import numpy as np
import pytest

from confuscope.llm.packing import assign, pack_documents
from confuscope.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_assign_covers_every_token_once(capacity):
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 80):
        lengths = rng.integers(1, 150, n)
        pieces = assign(lengths, capacity)
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for doc, start, length, seq, offset in pieces:
            assert length > 0
            by_doc[doc].append((start, length))
            by_seq[seq].append((offset, length))
        for doc, total in enumerate(lengths):
            at = 0
            for start, length in sorted(by_doc[doc]):
                assert start == at
                at += length
            assert at == total
        sizes = []
        for parts in by_seq.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            sizes.append(at)
        assert max(sizes, default=0) <= capacity
        assert len(sizes) == -(-int(lengths.sum()) // capacity)


def test_descending_to_the_lowest_cost():
    of = {p[0]: p[3] for p in assign(np.array([40, 50, 60, 50]), 100)}
    assert of[2] != of[1] == of[3] and of[0] == of[2]  # 60 | 50; 50 beside 50; 40 where there is room


def test_pack(spark, docs, docs_rows, empty_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    rows = pack_documents(docs, PATH, pool=4).collect()
    whole = sorted((str(d), [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in docs_rows)
    docs_of, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs_of[r["doc_id"], r["sequence_id"] >> 33].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= 2048
    assert sum(r["length"] for r in rows) == sum(len(i) for _, i in whole)
    assert sum(r["start"] == 0 for r in rows) == len(docs_rows)
    single = [d for d, _ in docs_rows if sum(x == d for x, _ in docs_rows) == 1]
    for d in single:
        parts = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        ids = [i for r in parts for i in np.frombuffer(r["ids"], dtype="<u4").tolist()]
        assert ids == next(i for k, i in whole if k == str(d))
        assert all(r["doc_tokens"] == len(ids) for r in parts)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(empty_docs, PATH).count() == 0
