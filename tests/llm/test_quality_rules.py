import re
from collections import Counter

from confuscope.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures(docs_rows):
    texts = [t for _, t in docs_rows] + ["a b c d e a b c d e f a b c d e", "x x x x x x", "l\nl\n \nl m\nl", "# $ <b>"]
    for t in texts:
        assert q.measure(t) == brute(t)


def test_ledger_and_policies(spark, docs, docs_rows, empty_docs):
    ledger = q.build_ledger(docs)
    assert ledger.count() == len(docs_rows)
    by_id = {r["doc_id"]: r for r in ledger.collect()}
    assert by_id[200]["failed"] & q.BITS["few_words"] and by_id[200]["n_words"] == 0
    kept = q.filter_documents(docs, q.BASE)
    assert kept.columns == docs.columns
    want = sorted(str(d) for d, t in docs_rows if (m := brute(t))[0] >= 10 and 100 * m[5] <= 20 * m[0])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert q.build_ledger(empty_docs).count() == q.filter_documents(empty_docs).count() == 0


def test_ablations(spark, docs):
    ledger = q.build_ledger(docs).cache()
    masks = [r["failed"] for r in ledger.collect()]
    got = {(r["policy"], r["rule"]): r for r in q.ablations(spark, ledger, [q.BASE, q.STANDARD]).collect()}
    for p in (q.BASE, q.STANDARD):
        for rule in p.rules:
            bit, r = q.BITS[rule], got[p.name, rule]
            failed = [m & p.mask for m in masks]
            assert r["kept"] == failed.count(0)
            assert r["failed_by_rule"] == sum(bool(m & bit) for m in failed)
            assert r["failed_by_rule_alone"] == failed.count(bit)
            assert r["kept_without_rule"] == failed.count(0) + failed.count(bit)
    assert q.ablations(spark, ledger.where("1 = 0"), [q.BASE]).count() == len(q.BASE.rules)
