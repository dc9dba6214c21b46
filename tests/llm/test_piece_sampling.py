import math
import re
from collections import Counter
from math import exp, log

import numpy as np
import xxhash

from confuscope.llm import piece_sampling as ps
from confuscope.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def paths(model, word):
    """All segmentations of a word with their weights, by brute force."""
    ids = {p: k for k, p in enumerate(model.pieces) if model.weight[k] != 0}
    out = []

    def go(at, got, w):
        if at == len(word):
            out.append((tuple(got), w))
        for end in range(at + 1, len(word) + 1):
            k = ids.get(word[at:end])
            if k is not None:
                go(end, [*got, k], w + model.weight[k])

    go(0, [], 0.0)
    total = sum(exp(w) for _, w in out)
    return {p: exp(w) / total for p, w in out}


def test_distribution_is_the_posterior():
    model = ps.piece_model(PATH)
    word = "▁there"
    want = paths(model, word)
    lat = ps.Lattices(model)
    n = 40_000
    got = Counter(tuple(x.tolist()) for x in ps.encode_rows(lat, list(range(n)), ["there"] * n, 3))
    assert set(got) <= set(want) and len(want) > 5
    for p, share in want.items():
        assert abs(got[p] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-4


def test_filter_total():
    model = ps.piece_model(PATH)
    assert abs(sum(paths(model, "▁wharf").values()) - 1) < 1e-9
    assert log(2) > 0


def test_lossless_and_reproducible(spark, docs, docs_rows, empty_docs):
    rows = ps.decode_pieces(ps.sample_pieces(docs, PATH), PATH).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(str((d, t or "")) for d, t in docs_rows)
    ids = {(r["doc_id"], r["text"]): bytes(r["ids"]) for r in rows}
    again = ps.sample_pieces(docs.repartition(2), PATH).collect()
    assert sorted((str(d), i) for (d, _), i in ids.items()) == sorted({(str(r["doc_id"]), bytes(r["ids"])) for r in again})
    other = {(r["doc_id"]): bytes(r["ids"]) for r in ps.sample_pieces(docs, PATH, seed=8).collect()}
    assert other[210] != ids[210, dict((d, t) for d, t in docs_rows)[210]]
    assert ps.sample_pieces(empty_docs, PATH).count() == 0


def test_memory_bound_changes_nothing(monkeypatch):
    model = ps.piece_model(PATH)
    texts = ["the shore and the wharf", "bleren " + "q" * 80, "日本 \U0001f600▁", "the"] * 3
    want = [x.tolist() for x in ps.encode_rows(ps.Lattices(model), list(range(12)), texts, 1)]
    monkeypatch.setattr(ps, "KEPT", 3)
    lat = ps.Lattices(model)
    got = [ps.encode_rows(lat, [k], [t], 1)[0].tolist() for k, t in enumerate(texts)]
    assert got == want
    assert [ps.decode_ids(model, np.array(x)) for x in got] == texts


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_sample(model, vocabulary, doc_id, text, seed):
    """One text in plain Python: every word's lattice filtered forward and sampled backward, node by node."""
    key = xxhash.xxh64_intdigest(b"null" if doc_id is None else str(doc_id).encode(), seed)
    out, at = [], 0
    text = text.replace("▁", "\udc81").replace(" ", "▁")
    for word in re.findall("▁+[^▁\n]*|[^▁\n]+|\n", "▁" + text) if text else []:
        total, arcs = [0.0], [[]]
        for end in range(1, len(word) + 1):
            into = []
            for n in range(1, min(end, model.longest) + 1):
                piece = vocabulary.get(word[end - n : end])
                if piece is not None or n == 1:
                    into.append((n, piece, total[end - n] + (model.unknown if piece is None else model.weight[piece])))
            top = max(w for *_, w in into)
            total.append(top + math.log(sum(math.exp(w - top) for *_, w in into)))
            arcs.append(into)
        end, ids = len(word), []
        while end:
            u, run = (plain_mix((key + (at + end) * 0x9E3779B97F4A7C15) % 2**64) >> 40) / 2**24, 0.0
            for n, piece, w in arcs[end]:
                run += math.exp(w - total[end])
                if u < run:
                    break
            char = word[end - 1 : end]
            raw = ("▁" if char == "\udc81" else char).encode()
            ids = ([piece] if piece is not None else [int(model.bytes_at[b]) for b in raw]) + ids
            end -= n
        out += ids
        at += len(word)
    return out


def test_rows_match_brute_force(spark, docs_rows):
    model = ps.piece_model(PATH)
    vocabulary = {p: k for k, p in reversed(list(enumerate(model.pieces))) if model.weight[k] < 0}
    rows = [(d, t) for d, t in docs_rows if len(t or "") < 6_000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], dtype="<i4").tolist()) for r in ps.sample_pieces(df, PATH).collect())
    assert got == sorted((str(d), plain_sample(model, vocabulary, d, t or "", ps.SEED)) for d, t in rows)
