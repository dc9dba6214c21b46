import re

import corpus_pipeline as cp
from confuscope.llm import quality_rules as q
from confuscope.llm.queries import ORACLE_SQL, QUERIES

from .test_exact_dedup import brute as exact
from .test_simhash import wide_components


def test_names():
    assert {int(m[1]) for k in QUERIES if (m := re.match(r"op(\d+)_", k))} == set(range(1, 11))
    assert set(ORACLE_SQL) < set(QUERIES) and 4 <= len(cp.STAGES) <= 5


def test_stages_match_brute_force(spark, docs, docs_rows, tmp_path, empty_docs):
    d = f"{tmp_path}/sf"
    docs.write.parquet(f"{d}/documents.parquet")
    rows = []
    for i, t in docs_rows:
        n, chars, symbols, lines, dup, rep = q.measure(t)
        if not (n < 10 or 100 * rep > 20 * n or symbols > n or not 2 * n <= chars <= 12 * n or 2 * dup > lines):
            rows.append((i, t))
    groups = exact(rows)
    rows = [r for r in dict.fromkeys(rows) if groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])][0] == r[0]]
    of, best = wide_components([t for _, t in rows]), {}
    for i, t in rows:
        key = (i is None, i or 0)
        best[of[t]] = min(best.get(of[t], key), key)
    want = sorted(str(None if none else i) for none, i in best.values())
    now = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        now = stage(spark, now, d)
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted(str(r["doc_id"]) for r in now.collect()) == want
    packed = cp.run(spark, d).collect()
    assert sorted({str(r["doc_id"]) for r in packed}) == sorted(set(want))


def test_empty(spark, empty_docs, tmp_path):
    d = f"{tmp_path}/sf"
    empty_docs.write.parquet(f"{d}/documents.parquet")
    assert cp.run(spark, d).count() == 0
