from collections import Counter

import pyarrow.parquet as pq
import xxhash

from confuscope.llm import sharding
from confuscope.llm.sharding import shuffle_to_shards


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_seed_alone_decides(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 9)
    monkeypatch.setattr(sharding, "GROUP", 4)
    place = lambda: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in shuffle_to_shards(docs.select("doc_id", "text")).collect())
    want = place()
    for parts, adaptive in ((2, "true"), (7, "false"), (13, "true")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        docs = docs.repartition(parts)
        try:
            assert place() == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def spark_hash(*values):
    """Spark's xxhash64 over longs, ints and strings: each value's hash seeds the next."""
    h = 42
    for kind, v in values:
        if v is not None:
            raw = v.encode() if kind == "s" else (v & (1 << (64 if kind == "l" else 32)) - 1).to_bytes(8 if kind == "l" else 4, "little")
            h = xxhash.xxh64_intdigest(raw, h)
    return signed(h)


def test_same_as_brute_force(spark, docs_rows, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 9)
    seen, records = {}, []
    seed = sharding.SEED
    for d, t in docs_rows:
        copy = seen[d, t] = seen.get((d, t), -1) + 1
        records.append((spark_hash(("i", seed), ("l", d), ("s", t)), copy, d, t))
    n_bytes = sum(len((t or "").encode()) + 16 if t is not None else 0 for _, _, _, t in records)
    count = max(1, -(-n_bytes // 4_000), -(-len(records) // 9))
    buckets = {}
    for r in records:
        buckets.setdefault(spark_hash(("l", r[0]), ("i", r[1])) % count, []).append(r)
    order = []
    for b in sorted(buckets):
        a = sorted(buckets[b], key=lambda r: r[:2])
        for i in range(len(a) - 1, 0, -1):
            j = spark_hash(("i", seed), ("l", b), ("i", i)) % (i + 1)
            a[i], a[j] = a[j], a[i]
        order += a
    df = spark.createDataFrame(docs_rows, "doc_id long, text string")
    got = {(r["slot"] * 8 + r["shard"]): (r["doc_id"], r["text"]) for r in shuffle_to_shards(df, bucket_bytes=4_000).collect()}
    assert [got[k] for k in range(len(order))] == [(d, t) for _, _, d, t in order]


def test_shards(spark, docs, docs_rows, empty_docs):
    rows = shuffle_to_shards(docs, bucket_bytes=2_000).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(str, docs_rows))
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["shard"])) if r["doc_id"] is not None]
    assert order != sorted(order)
    assert shuffle_to_shards(empty_docs).count() == 0


def test_seed(spark, docs):
    place = lambda **kw: sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in shuffle_to_shards(docs, **kw).collect())
    assert place() == place()
    assert place(seed=1) != place(seed=2)


def test_fewer_rows_than_shards(spark, docs):
    rows = shuffle_to_shards(docs.where("doc_id in (1, 2)")).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (1, 0)]


def test_many_equal_rows_scatter(spark):
    df = spark.createDataFrame([(1, "same text")] * 3000 + [(k, f"text {k}") for k in range(1000)] + [(None, None)] * 50, "doc_id long, text string")
    rows = shuffle_to_shards(df, bucket_bytes=4_000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(tuple(r) for r in df.collect())
    first = [r["doc_id"] == 1 and r["text"] == "same text" for r in sorted(rows, key=lambda r: (r["slot"], r["shard"]))][:1000]
    assert 0.6 < sum(first) / 1000 < 0.85


def test_tasks_follow_the_bytes(spark, tmp_path, monkeypatch):
    """Whatever the session's partitions, each task gathers TASK_BYTES or so, sorts them and writes a file for every shard."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 9)
    df = spark.createDataFrame([(k, f"text {k} " * 20) for k in range(2000)], "doc_id long, text string")

    def files(out):
        rows = shuffle_to_shards(df, out=f"file://{out}").collect()
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(tuple(r) for r in df.collect())
        slots = [[pq.read_table(f)["slot"].to_pylist() for f in (out / f"shard={k}").glob("*.parquet")] for k in range(8)]
        assert all(s == sorted(s) for of_shard in slots for s in of_shard)
        return max(map(len, slots))

    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert files(tmp_path / "few") <= spark.sparkContext.defaultParallelism
        monkeypatch.setattr(sharding, "TASK_BYTES", 30_000)
        assert spark.sparkContext.defaultParallelism < files(tmp_path / "more") <= 14
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
