import io
import zlib

import numpy as np
import pytest
import zstandard

from confuscope.llm import token_store as ts
from confuscope.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def small_file():
    out = io.BytesIO()
    w = ts.FrameWriter(out, 2)
    lists = [np.arange(5, dtype="<u4"), np.array([1], dtype="<u4"), np.arange(3000, dtype="<u4")]
    for k, ids in enumerate(lists):
        frame, checksum = ts.make_frame(ids, 2)
        w.add(k, frame, len(ids), checksum)
    w.close()
    return out.getvalue(), lists


def test_seekable_file():
    data, lists = small_file()
    r = ts.FrameReader(Source(data))
    for k, ids in enumerate(lists):
        assert r.ids(k).tolist() == ids.tolist()
    assert r.doc_ids == [0, 1, 2]
    # A plain decompressor reads the whole stream; skippable frames count as nothing.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole, dtype="<u2").tolist() == [i for ids in lists for i in ids.tolist()]


def test_damage_is_seen():
    data, _ = small_file()
    r = ts.FrameReader(Source(data))
    hurt = bytearray(data)
    hurt[int(r.offsets[2]) + 40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        ts.FrameReader(Source(bytes(hurt))).ids(2)
    with pytest.raises(ValueError):
        ts.FrameReader(Source(data[:-1] + b"x"))


@pytest.mark.parametrize("files", [None, 5])
def test_round_trip(spark, docs, docs_rows, empty_docs, files):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    manifest = ts.write_tokens(docs, PATH, files=files)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids"]) for r in ts.read_tokens(manifest).collect())
    want = sorted((str(d), [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in docs_rows)
    assert sorted((str(d), np.frombuffer(i, dtype="<u4").tolist()) for _, d, _, i in got) == want
    at = 0
    for start, _, n, ids in got:
        assert start == at and len(ids) == 4 * n
        at += n
    order = [d for _, d, _, _ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    some = ts.read_tokens(manifest, [3, 210]).collect()
    assert {r["doc_id"] for r in some} == {3, 210} and len(some) == 4
    assert all(zlib.crc32(r["ids"]) for r in some)
    assert len(ts.read_tokens(manifest, [None, 223]).collect()) == 3 and ts.read_tokens(manifest, []).count() == ts.read_tokens(manifest, [999]).count() == 0
    assert ts.read_tokens(ts.write_tokens(empty_docs, PATH)).count() == 0


def test_one_id_over_many_files(spark):
    rows = [(7, f"text {k}") for k in range(200)] + [(1, "a"), (9, "b")]
    manifest = ts.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, files=6)
    assert manifest.count() > 2
    got = sorted((r["start"], r["doc_id"]) for r in ts.read_tokens(manifest).collect())
    assert [d for _, d in got] == [1] + [7] * 200 + [9]


def test_a_lookup_opens_the_files_that_may_have_it(spark):
    rows = [(k, f"text {k}") for k in range(400)]
    manifest = ts.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, files=8)
    assert manifest.count() == 8 and max(r["n_docs"] for r in manifest.collect()) <= 100
    found = ts.read_tokens(manifest, [5, 390])
    assert sorted(r["doc_id"] for r in found.collect()) == [5, 390] and found.rdd.getNumPartitions() == 2
    (low, high), = {(r["low"], r["high"]) for r in manifest.collect() if r["part"] == 0}
    assert low == 0 and 20 < high < 100
