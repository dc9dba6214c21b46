import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from confuscope.functions import align as L
from confuscope.functions import text as X
from confuscope.operators import texts as O
from confuscope.plans import queries as Q
from confuscope.sources.config import get_charset


def brute_edit(a, b):
    """Textbook table and the defined order of choices on the way back."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = d[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(d[i - 1][j - 1], d[i][j - 1], d[i - 1][j])
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif j and d[i][j] == d[i][j - 1] + 1:
            j -= 1
            out.append((None, b[j]))
        else:
            i -= 1
            out.append((a[i], None))
    return d[-1][-1], out[::-1]


def samples(n=120):
    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(k)))
    return [(word(14), word(14)) for _ in range(n)] + [("", ""), ("", "ab"), ("ab", ""), ("kitten", "sitting"), ("a" * 60, "a" * 55 + "b")]


def test_edit_alignment(monkeypatch):
    monkeypatch.setattr(L, "CELLS", 3_000)
    a, b = zip(*samples(), strict=True)
    for x, y, got in zip(a, b, L.edit_alignments(list(a), list(b)), strict=True):
        cost, want = brute_edit(x, y)
        assert got == want and sum(t != p for t, p in got) == cost


def test_global_alignment():
    a, b = zip(*samples(), strict=True)
    for x, y, (p, q) in zip(a, b, L.global_alignments(list(a), list(b)), strict=True):
        assert len(p) == len(q) and p.replace("-", "") == x and q.replace("-", "") == y
        score = sum(2 if c == e else -1 for c, e in zip(p, q, strict=True))
        best = {}
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                best[i, j] = max([-i - j] if not i * j else [best[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1), best[i - 1, j] - 1, best[i, j - 1] - 1])
        assert score == best[len(x), len(y)]
    assert L.global_alignments(["GATTACA"], ["GCATGCU"])[0] == L.global_alignments(["GATTACA"], ["GCATGCU"])[0]


def test_matching(spark):
    rows = [("s", "1", "kitten", "sitting"), ("s", "2", "", "ab"), ("s", "3", "Ab", "aB"), ("s", "4", None, None), ("s", "5", "é", "é")]
    df = spark.createDataFrame(rows, "script string, filename string, truth string, prediction string")
    r = {x["filename"]: x for x in O.match_texts(df).collect()}
    assert (r["1"]["matches"], r["1"]["substitutions"], r["1"]["insertions"], r["1"]["deletions"]) == (4, 2, 1, 0)
    assert r["1"]["char_accuracy"] == pytest.approx(4 / 6) and r["1"]["cer"] == pytest.approx(0.5)
    assert (r["2"]["char_accuracy"], r["2"]["cer"], r["2"]["insertions"]) == (0, 1, 2)
    assert r["4"]["alignment"] == [] and r["5"]["matches"] == 1
    folded = {x["filename"]: x for x in O.match_texts(df, case_sensitive=False).collect()}
    assert r["3"]["matches"] == 0 and folded["3"]["matches"] == 2
    pairs = O.label_pairs(O.match_texts(df.where("filename = '1'")))
    assert [(x["true_char"], x["pred_char"]) for x in pairs.collect()] == [("k", "s"), ("i", "i"), ("t", "t"), ("t", "t"), ("e", "i"), ("n", "n")]


def brute_clean(text, charset):
    import re

    t = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    t = re.sub("\n{3,}", "\n\n", re.sub(" +", " ", t))
    if charset:
        t = "".join(c if c in charset or c == "\n" else " " if c.isspace() else "" for c in t)
    return re.sub(" +", " ", t).strip()


def test_cleaning(spark):
    texts = ["a\r\nb\rc\td", "  x   y \n\n\n\n z  ", "é café №5 a b", "", "[a]-{b}^\\&~|", "привет, мир!\x0b ok", "\n \n"]
    for script in ("latin", "cyrillic", "none"):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.clean_text(F.col("t"), get_charset(script)).alias("c"))
        assert [r["c"] for r in df.collect()] == [brute_clean(t, get_charset(script)) for t in texts]


def brute_segments(text, chars, lines, shortest):
    out, now, n = [], [], 0
    for line in filter(None, map(str.strip, text.split("\n"))):
        if now and (n + len(line) > chars or len(now) >= lines):
            out.append("\n".join(now))
            now, n = [], 0
        now.append(line)
        n += len(line)
    if now:
        out.append("\n".join(now))
    return [s for s in out if len(s) >= shortest]


def test_segments(spark):
    rng = random.Random(1)
    texts = ["\n".join("w" * rng.randrange(60) for _ in range(rng.randrange(14))) for _ in range(30)] + ["", "short", "x" * 300]
    df = spark.createDataFrame([("s", f"f{k}", t) for k, t in enumerate(texts)], "script string, filename string, text string")
    got = {}
    for r in O.segment_texts(df).collect():
        got.setdefault(r["source_file"], {})[r["segment_index"]] = r["text"]
    for k, t in enumerate(texts):
        want = brute_segments(t, 100, 5, 20)
        assert [v for _, v in sorted(got.get(f"f{k}", {}).items())] == want
    assert O.segment_texts(df, cap=1).groupBy("source_file").count().where("count > 1").count() == 0


def test_statistics_and_coverage(spark):
    df = spark.createDataFrame([("s", "f1", "aab\nb"), ("s", "f2", ""), ("t", "f3", "é")], "script string, filename string, text string")
    st = {r["script"]: r for r in O.text_statistics(df).collect()}
    assert (st["s"]["files"], st["s"]["total_chars"], st["s"]["total_lines"], st["s"]["unique_chars"]) == (2, 5, 2, 3)
    top = [(r["ch"], r["n"]) for r in O.top_characters(df.where("script = 's'"), 2).orderBy("rank").collect()]
    assert top == [("a", 2), ("b", 2)]
    charset = spark.createDataFrame([("s", c) for c in "abz \n"] + [("u", "q")], "script string, ch string")
    c = {r["script"]: r for r in O.coverage(df, charset).collect()}
    assert (c["s"]["covered"], c["s"]["charset_size"], c["s"]["missing"]) == (3, 5, ["z"]) and c["s"]["coverage_percent"] == 60
    assert c["u"]["missing"] == ["q"]


def test_small_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(X.image_name(F.lit("s"), F.lit(7), F.lit(2))) == "s_0007_aug2.png" and val(X.one_line(F.lit("a\nb"))) == "a b"
    assert val(O.mean_confidence(F.array(F.lit(0.5), F.lit(1.0)), F.lit(0.1))) == 0.75
    assert val(O.mean_confidence(F.array().cast("array<double>"), F.lit(0.1))) == pytest.approx(0.1)
    words = spark.createDataFrame([(-1.0, "a"), (90.0, ""), (80.0, "b")], "conf double, text string")
    assert [r["text"] for r in O.word_filter(words).collect()] == ["b"]
    assert val(O.edit_distance(F.lit("kitten"), F.lit("sitting"))) == 3 and val(O.edit_distance(F.lit("kitten"), F.lit("sitting"), 2)) == -1
    assert val(X.characters(F.lit("a\U0001f600"))) == ["a", "\U0001f600"] and val(X.characters(F.lit(""))) == []


def test_straight_and_long_alignments_are_those_of_the_table(monkeypatch):
    rng = random.Random(6)
    word = lambda n, cs: "".join(rng.choice(cs) for _ in range(n))
    pairs = [(word(rng.randrange(40), "abcd"), word(rng.randrange(40), "abcx")) for _ in range(300)]
    pairs += [(a, a.translate(str.maketrans("ab", "xy"))) for a, _ in pairs]
    truths, preds = (list(x) for x in zip(*pairs, strict=True))
    straight = L._straight
    assert sum(map(straight, truths, preds)) >= 300
    monkeypatch.setattr(L, "_straight", lambda a, b: False)
    want = L.edit_alignments(truths, preds)
    monkeypatch.setattr(L, "CELLS", 0)
    assert L.edit_alignments(truths, preds) == want
    monkeypatch.setattr(L, "_straight", straight)
    assert L.edit_alignments(truths, preds) == want


def test_channel_queries_count_whole_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "CHARS", 3000)
    texts = ["a tone of note " * 100, "x" * 250, "é, eaotn " * 40, ""]
    rows = [("en", k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "lang string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((c, c.translate(str.maketrans("eaotn", "εαοτν"))) for t in texts for c in t)
    for query in (Q.channel_cells, Q.channel_engine):
        assert {(r["true_char"], r["pred_char"]): r["n"] for r in query(spark, str(tmp_path)).collect()} == want
    got = {r["doc_id"]: r["matches"] + r["substitutions"] for r in Q.channel_match(spark, str(tmp_path)).collect()}
    assert got == {k: len(t) for k, t in enumerate(texts)}


def test_segment_query_takes_whole_documents(spark, tmp_path):
    lines = [f"{k:04d} " + "w" * 55 for k in range(400)]
    rows = [("en", 1, "\n".join(lines)), ("de", 2, "\n".join(["ten chars."] * 7)), ("de", 3, "")]
    spark.createDataFrame(rows, "lang string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in Q.segment_texts(spark, str(tmp_path)).select("script", "source_file", "segment_index", "text").collect())
    want = [("de", "d000000002", 0, "\n".join(["ten chars."] * 5)), ("de", "d000000002", 1, "ten chars.\nten chars.")]
    assert got == want + [("en", "d000000001", k, line) for k, line in enumerate(lines)]


def test_counted_alignments_are_those_of_the_long_way(spark):
    from confuscope.operators.counts import count_pairs

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé東 \U0001f600") for _ in range(rng.randrange(0, 14)))
    rows = [(rng.choice(["x", "y", None]), f"f{k}", word(), word()) for k in range(150)] + [("x", "s", "abab", "acac"), ("y", "n", None, "a"), ("y", "e", "", ""), ("x", "d", "e\u0301", "é")]
    df = spark.createDataFrame(rows, "script string, filename string, truth string, prediction string").repartition(3)
    as_set = lambda d: {tuple(r) for r in d.select("script", "true_char", "pred_char", "n").collect()}
    assert as_set(O.match_cells(df)) == as_set(count_pairs(O.label_pairs(O.match_texts(df))))
    assert O.match_cells(df.where("1 = 0")).count() == O.match_counts(df.where("1 = 0")).count() == 0
    fold = df.withColumn("truth", F.upper("truth"))
    assert as_set(O.match_cells(fold, case_sensitive=False)) == as_set(count_pairs(O.label_pairs(O.match_texts(fold, case_sensitive=False))))
    short = O.match_counts(df)
    assert sorted(map(str, short.collect())) == sorted(map(str, O.match_texts(df).select(*short.columns).collect()))
