import pytest

from confuscope.operators import counts as C

from .conftest import by_script


def test_metrics(literal):
    m = by_script(C.matrix_metrics(*literal))
    assert (m["simple"]["size"], m["simple"]["total_observations"]) == (5, 508)
    assert m["simple"]["accuracy"] == pytest.approx(457 / 508) and m["simple"]["sparsity"] == pytest.approx(2 / 25)
    assert m["identity"]["accuracy"] == 1 and m["identity"]["error_rate"] == 0
    assert m["uniform"]["accuracy"] == pytest.approx(0.1)
    assert m["sparse"]["total_observations"] == 2020 and m["sparse"]["sparsity"] == pytest.approx(376 / 400)
    assert (m["zero"]["accuracy"], m["zero"]["sparsity"], m["zero"]["total_observations"]) == (0, 1, 0)


def test_label_accuracy(literal, dead):
    acc = {(r["script"], r["ch"]): r["accuracy"] for r in C.label_accuracy(*literal).collect()}
    assert acc["simple", "a"] == pytest.approx(100 / 108) and acc["zero", "b"] == 0
    assert {r["ch"]: r["accuracy"] for r in C.label_accuracy(*dead).collect()} == {"a": 0.8, "b": 0, "c": 0}


def test_top_confusions_and_ties(literal):
    top = [(r["true_char"], r["pred_char"], r["n"]) for r in C.top_confusions(literal[0].where("script = 'simple'"), 4).orderBy("rank").collect()]
    assert top == [("c", "d", 8), ("d", "c", 6), ("a", "b", 5), ("b", "c", 4)]
    assert C.top_confusions(literal[0].where("script = 'identity'")).count() == 0
    ties = [(r["true_char"], r["pred_char"]) for r in C.top_confusions(literal[0].where("script = 'uniform'"), 3).orderBy("rank").collect()]
    assert ties == [("a", "b"), ("a", "c"), ("a", "d")]


def test_count_build_and_prune(spark):
    rows = [("s", "a", "a"), ("s", "a", "b"), ("s", "a", "a"), ("t", "x", ""), ("t", "x", "y")]
    pairs = spark.createDataFrame(rows, "script string, true_char string, pred_char string")
    charset = spark.createDataFrame([("s", "z"), ("s", "a"), ("t", "q")], "script string, ch string")
    cells = C.count_pairs(pairs)
    assert sorted((r["script"], r["true_char"], r["pred_char"], r["n"]) for r in cells.collect()) == [("s", "a", "a", 2), ("s", "a", "b", 1), ("t", "x", "", 1), ("t", "x", "y", 1)]
    labels = C.label_table(cells, charset)
    assert sorted((r["script"], r["idx"], r["ch"]) for r in labels.collect()) == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "z"), ("t", 0, "q"), ("t", 1, "x"), ("t", 2, "y")]
    built, kept = C.build_matrices(pairs, charset, ["s", "t"])
    assert sorted((r["script"], r["idx"], r["ch"]) for r in kept.collect()) == [("s", 0, "a"), ("s", 1, "b"), ("t", 0, "x"), ("t", 1, "y")]
    assert built.count() == 3
    big, left = C.prune_unused(cells, labels, 4)
    assert [(r["script"], r["ch"]) for r in left.collect()] == [("s", "a")] and big.count() == 1
    report = by_script(C.prune_report(cells, labels, 4))
    assert (report["s"]["original_size"], report["s"]["pruned_size"], report["t"]["removed"]) == (3, 1, 3)
    with pytest.raises(ValueError):
        C.prune_unused(cells, labels, 0)
    with pytest.raises(Exception, match="unknown script"):
        C.build_matrices(pairs, None, ["s"])[0].collect()


def test_weights_and_statistics(spark):
    rows = [("s", "a", "a", 5), ("s", "a", "b", 3)]
    df = spark.createDataFrame(rows, "script string, true_char string, pred_char string, w int")
    assert sorted(r["n"] for r in C.count_pairs(df, "w").collect()) == [3, 5]
    s = C.builder_statistics(df).collect()[0]
    assert (s["total_samples"], s["unique_pairs"], s["accuracy"]) == (2, 2, 0.5)
    assert C.builder_statistics(df.where("1 = 0")).count() == 0


def test_checks(spark, literal):
    assert C.check_matrices(*literal).count() == 0
    cells = spark.createDataFrame([("s", "a", "b", -1.0), ("s", "a", "q", 1.0)], "script string, true_char string, pred_char string, n double")
    labels = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "b")], "script string, idx int, ch string")
    assert {r["problem"] for r in C.check_matrices(cells, labels).collect()} == {"negative or missing count", "label is not listed", "label is listed twice"}
