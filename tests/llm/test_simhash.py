import random
import re

import numpy as np
import pytest
import xxhash

from confuscope.llm import simhash as s
from .test_components import brute as components


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def links(fps):
    fps = sorted(set(fps))
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3]


def test_near_duplicates(spark, docs, docs_rows, empty_docs):
    fps = [brute_fp(t) for _, t in docs_rows]
    comp = components(links(fps))
    low = {}
    for (d, _), f in zip(docs_rows, fps, strict=True):
        if d is not None:
            low[comp.get(f, f)] = min(d, low.get(comp.get(f, f), d))
    want = sorted((str(d), f"{f:016x}", str(low.get(comp.get(f, f)))) for (d, _), f in zip(docs_rows, fps, strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in s.near_duplicates(docs).collect())
    assert got == want
    assert s.near_duplicates(empty_docs).count() == 0


def bits_apart(x, y):
    return bin(int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).count("1")


def wide_components(texts):
    """Components of texts by all pairs; keys are the distinct signatures."""
    sigs = {t: s.wide_signature(t) for t in set(texts)}
    edges, items = [], sorted(set((x, tuple(m)) for x, m in sigs.values()))
    for i, (x, m) in enumerate(items):
        for y, n in items[i + 1 :]:
            if bits_apart(x, y) <= s.WIDE_BUDGET and bits_apart(x[:8], y[:8]) <= s.FIRST_BUDGET and any(p == q for p, q in zip(m, n, strict=True)):
                edges.append((x, y))
    comp = components(edges)
    return {t: comp.get(x, x) for t, (x, _) in sigs.items()}


def brute_wide(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def test_wide_signature_is_a_simhash_of_the_set(docs_rows):
    for _, text in docs_rows[:30]:
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in brute_wide(text)]
        sig, mins = s.wide_signature(text)
        for lane in range(s.WIDE_BITS // 64):
            words = [int(s._mix(np.uint64(h) ^ s._LANES[lane])) for h in hashes]
            want = sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in words) > len(words))
            assert int.from_bytes(sig[8 * lane : 8 * lane + 8], "little") == want
        assert mins == [min(int(s._mix(np.uint64(h) ^ c)) for h in hashes) for c in s._LANES[s.WIDE_BITS // 64 :]]


def edited(rng, words, share):
    return [w if rng.random() >= share else f"new{rng.randrange(10**6)}" for w in words]


def test_near_copies_are_those_of_the_stated_similarity():
    rng = random.Random(8)
    caught = {True: [], False: []}
    for _ in range(150):
        a = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(120, 500))]
        b = edited(rng, a, rng.choice([0.01, 0.015, 0.12]))
        x, y = brute_wide(" ".join(a)), brute_wide(" ".join(b))
        similarity = len(x & y) / len(x | y)
        linked = len(set(wide_components([" ".join(a), " ".join(b)]).values())) == 1
        if similarity >= 0.85 or similarity <= 0.55:
            caught[similarity >= 0.85].append(linked)
    assert len(caught[True]) > 50 and sum(caught[True]) >= 0.99 * len(caught[True])
    assert len(caught[False]) > 30 and not any(caught[False])


@pytest.mark.parametrize("split", [None, 3])
def test_drop(spark, docs, docs_rows, empty_docs, monkeypatch, split):
    if split:
        monkeypatch.setattr(s, "SPLIT", split)
    of = wide_components([t for _, t in docs_rows])
    out = s.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(rows) == len({of[t] for _, t in rows}) == len(set(of.values()))
    for d, t in rows:
        ids = [k for k, x in docs_rows if of[x] == of[t] and k is not None]
        assert d == (min(ids) if ids else None)
    assert s.drop_near_duplicates(empty_docs).count() == 0


def near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


def fingerprints(rng, n=400):
    centres = [rng.getrandbits(64) for _ in range(20)]
    return sorted({near(rng, rng.choice(centres), rng.randrange(6)) for _ in range(n)} | {0, (1 << 64) - 1, 1, 7, 15})


def test_trie_links_match_all_pairs():
    rng = random.Random(3)
    for n in (0, 1, 2, 50, 400):
        fps = fingerprints(rng, n)
        i, j = s.trie_links(np.array(fps, dtype=np.uint64), np.zeros(len(fps), dtype=np.int64))
        got = components([(fps[a], fps[b]) for a, b in zip(i, j, strict=True)])
        assert got == components(links(fps))
        assert len(i) < max(1, len(fps))


def test_large_tries_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(s, "SPLIT", 5)
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({near(rng, base, rng.randrange(1, 5)) for _ in range(60)} | set(fingerprints(rng, 60)))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    got = s.group_fingerprints(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    got = {r["fp"]: r["component"] for r in got.collect()}
    assert got == components([(signed(a), signed(b)) for a, b in links(fps)])


def test_links_are_those_of_exact_similarity(spark):
    """Pairs between 0.7 and 0.9, one word appended to short texts among them, against all pairs by brute force."""
    rng = random.Random(12)
    rows = []
    for k in range(120):
        n = rng.randrange(60, 260)
        a = [f"p{k}w{m}" for m in range(n)]
        b = list(a)
        for at in rng.sample(range(n), max(1, round(n * rng.uniform(0.02, 0.075)))):
            b[at] = f"new{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    for k in range(120, 240):
        a = [f"p{k}w{m}" for m in range(rng.randrange(7, 15))]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join([*a, "more"]))]
    rows += [(500, None), (501, "")]
    want, seen = {0}, []
    for (i, a), (_, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = brute_wide(a), brute_wide(b)
        seen.append(len(x & y) / len(x | y))
        want |= {i} if seen[-1] >= 0.8 else {i, i + 1}
    assert sum(0.7 <= x < 0.8 for x in seen) > 20 and sum(0.8 <= x < 0.9 for x in seen) > 60
    got = {r["doc_id"] for r in s.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_split_does_not_change_candidates(spark, monkeypatch):
    """Sets that share one minimum only, and a trie much larger than SPLIT."""
    rng = random.Random(21)
    sig = bytes(64)
    rows = [(k, 300, sig, [7, *(rng.getrandbits(60) for _ in range(s.MINS - 1))]) for k in range(40)]
    rows += [(100 + k, 300, sig, [rng.getrandbits(60) for _ in range(s.MINS)]) for k in range(5)]
    far = bytes([255]) * 64
    rows += [(200, 300, far, rows[0][3]), (201, 300, far, [1, 2, 3, rows[1][3][3], 5, 6])]
    df = spark.createDataFrame(rows, "fp long, size int, sig binary, mins array<long>")

    def groups():
        by = {}
        for r in s.candidate_members(df).collect():
            by.setdefault(r["trie"], []).append(r["fp"])
        return components([(g[0], x) for g in by.values() for x in g[1:]])

    whole = groups()
    assert set(whole) == set(range(40)) and set(whole.values()) == {0}
    monkeypatch.setattr(s, "SPLIT", 3)
    assert groups() == whole
    monkeypatch.setattr(s, "SPLIT", 1)
    assert groups() == whole


def test_last_tries_are_bounded(spark, monkeypatch):
    """Fingerprints that agree on every block but their last bits stay together through all levels."""
    monkeypatch.setattr(s, "SPLIT", 4)
    fps = list(range(64))
    rows = spark.createDataFrame([(1, f) for f in fps] + [(2, 7)], "trie long, fp long")
    out = s.split_large(rows).collect()
    size = {}
    for r in out:
        size.setdefault(r["trie"], set()).add(r["fp"])
    assert max(map(len, size.values())) <= 14 and {7} in size.values()
    met = {(a, b) for m in size.values() for a in m for b in m if a < b}
    assert met == {(a, b) for a in fps for b in fps if a < b}
