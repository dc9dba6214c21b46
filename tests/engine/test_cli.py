import numpy as np

from confuscope import cli


def test_end_to_end(spark, tmp_path):
    text = {"a.png": "the note", "b.png": "one tone", "c.png": "skipped"}
    for script in ("latin", "greek"):
        (tmp_path / "img" / script).mkdir(parents=True)
        (tmp_path / "gt").mkdir(exist_ok=True)
        for name, t in text.items():
            (tmp_path / "img" / script / name).write_bytes(t.encode())
        lines = [f'{n}: "{t}"' for n, t in text.items() if n != "c.png"]
        (tmp_path / "gt" / f"{script}_labels.txt").write_text("\n".join(lines), encoding="utf-8")
    report = cli.recognize(spark, str(tmp_path / "img"), str(tmp_path / "gt"), str(tmp_path / "m"))
    assert "## Latin" in report and "`e` read as `ε`: 4 times" in report
    assert {p.name for p in (tmp_path / "m" / "files").iterdir()} == {f"{s}.{e}" for s in ("latin", "greek") for e in ("npz", "json")}
    out = cli.analyze(spark, str(tmp_path / "m"), str(tmp_path / "a"), "frobenius")
    assert "- latin: greek (" in out and "- identity: holds" in out
    assert spark.read.text(str(tmp_path / "a/results")).count() == 1
    assert np.isfinite(spark.read.parquet(str(tmp_path / "a/distances")).first()["d"])


def test_scaffold_and_plan(spark, tmp_path):
    made = cli.scaffold(str(tmp_path), ["latin"])
    assert len(made) == 1 and (tmp_path / "images/latin").is_dir()
    assert cli.main(["scaffold", "--out", str(tmp_path), "--scripts", "latin,greek"]) == 0
    (tmp_path / "texts/latin").mkdir(parents=True)
    (tmp_path / "texts/latin/x.txt").write_text("one\ntwo\n")
    assert cli.main(["plan", "--texts", str(tmp_path / "texts"), "--out", str(tmp_path / "plan"), "--augmentations", "2"]) == 0
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "plan/script=latin")).collect()]
    assert len(lines) == 5 and lines[0].startswith("#")
