import random
import re
from hashlib import sha256

from confuscope.llm import exact_dedup as x


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_rows(spark, docs, docs_rows, empty_docs):
    want = brute(docs_rows)
    got = x.exact_duplicates(docs).collect()
    assert len(got) == len(docs_rows)
    by_hash = {sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    kept = {}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_hash[r["text_sha256"]]
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + 1
    assert kept == dict.fromkeys(by_hash, 1)
    assert x.exact_duplicates(empty_docs).count() == 0


def test_drop(spark, docs, docs_rows, empty_docs):
    out = x.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(v[0]) for v in brute(docs_rows).values())
    assert x.drop_exact_duplicates(empty_docs).count() == 0
    alone = docs.where("doc_id between 40 and 50")
    assert x.drop_exact_duplicates(alone).count() == 11


def test_filter_with_deletions_and_overflow():
    rng = random.Random(2)
    index, live = x.KeyIndex(8), {}
    for step in range(6_000):
        d = sha256(str(rng.randrange(2_500)).encode()).digest()
        if rng.random() < 0.35:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            index.put(d, (step,))
            live[d] = (step,)
    assert index.resizes > 0 and index.size == len(live)
    assert dict(index.items()) == live
    assert all(index.get(d) == v for d, v in live.items())
    assert index.filter.count == len(live)
    again = x.CuckooFilter(table=index.filter.to_bytes())
    assert all(d in again for d in live) and again.count == len(live)


def test_hits_are_verified_beyond_the_filter_and_the_digest():
    """Keys of equal SHA-256 (and so of one fingerprint and bucket) whose second hash or length differs."""
    d = sha256(b"x").digest()
    index = x.KeyIndex()
    index.put(d + b"a" * 16, (1,))
    assert index.get(d + b"b" * 16) is None and index.false_hits == 1
    index.put(d + b"b" * 16, (2,))
    assert index.size == 2 and index.get(d + b"a" * 16) == (1,)
    assert index.delete(d + b"a" * 16) and index.get(d + b"b" * 16) == (2,)


def row(k, n, chars=10, doc_id=0):
    return sha256(str(k).encode()).digest() + bytes(16), n, chars, doc_id or k, doc_id or k


def state_of(index):
    return sorted((r["keep_id"], r["n"]) for r in index.state.collect())


def test_index_updates(spark):
    frame = lambda rows: spark.createDataFrame(rows, x.STATE)
    index = x.update_index(frame([row(1, 1), row(2, 1), row(2, 1), row(3, 1), (None, 1, 1, 1, 1)]))
    assert state_of(index) == [(1, 1), (2, 2), (3, 1)]
    index = x.update_index(frame([row(1, -1), row(2, -1), row(9, -1), row(4, 1)]), index)
    assert state_of(index) == [(2, 1), (3, 1), (4, 1)]
    index = x.update_index(frame([row(2, -1), row(2, -1), row(3, -1), row(3, 1, doc_id=30)]), index)
    assert state_of(index) == [(4, 1), (30, 1)]
    assert state_of(x.update_index(frame([]))) == []


def test_the_row_that_stays_may_go(spark):
    frame = lambda rows: spark.createDataFrame(rows, x.STATE)
    index = x.update_index(frame([row(1, 1, doc_id=k) for k in (7, 6, 5)] + [row(1, 1, chars=9, doc_id=2), row(2, 1)]))
    assert state_of(index) == [(2, 1), (5, 4)]
    index = x.update_index(frame([row(1, -1, doc_id=5)]), index)
    assert state_of(index) == [(2, 1), (6, 3)]
    index = x.update_index(frame([row(1, -1, doc_id=6), row(1, -1, doc_id=5), row(1, -1, doc_id=7), row(1, 1, chars=8, doc_id=1)]), index)
    assert state_of(index) == [(2, 1), (2, 2)]
    # Deletions with insertions in a first batch.
    assert state_of(x.update_index(frame([row(1, 1, doc_id=5), row(1, 1, doc_id=6), row(1, -1, doc_id=5), row(3, -1)]))) == [(6, 1)]


def test_random_updates_match_brute_force(spark):
    rng, live, index = random.Random(6), [], None
    for _ in range(4):
        batch = [row(rng.randrange(30), 1, chars=rng.randrange(8, 11), doc_id=rng.randrange(1, 20)) for _ in range(60)]
        gone = [(k, -1, *rest) for k, _, *rest in rng.sample(batch + live, 40) if rng.random() < 0.9]
        live += batch
        for k, _, chars, d, _ in gone:
            for at, r in enumerate(live):
                if (r[0], r[2], r[3]) == (k, chars, d):
                    del live[at]
                    break
        index = x.update_index(spark.createDataFrame(batch + gone, x.STATE), index, shards=3)
        index = x.Index(x.written(index.state, "t"), x.written(index.live, "t"))
        groups = {}
        for r in live:
            groups.setdefault(r[0], []).append((-r[2], r[3]))
        want = sorted((k, len(v), -min(v)[0], min(v)[1]) for k, v in groups.items())
        assert sorted((bytes(r["key"]), r["n"], r["keep_chars"], r["keep_id"]) for r in index.state.collect()) == want


def test_probe(spark):
    index = x.update_index(spark.createDataFrame([row(k, 1) for k in range(200)], x.STATE))
    state, kept = x.written(index.state, "t"), x.written(x.filters(index.state, 3), "t")
    assert kept.count() == 3 and state.count() == 200
    keys = spark.createDataFrame([(row(k, 1)[0],) for k in (5, 5, 199, 200, 500)] + [(None,), (row(7, 1)[0][:32] + b"z" * 16,)], "key binary")
    assert sorted(r["keep_id"] for r in x.find_live(keys, state, kept, 3).collect()) == [5, 199]
    assert x.find_live(keys.limit(0), state, kept, 3).count() == 0


def test_shards_follow_the_keys(spark):
    assert x.shard_count(spark, 10) == 4 and x.shard_count(spark, 40_000_000) == 80
