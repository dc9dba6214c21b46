import struct

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from confuscope.operators.counts import count_pairs, label_table
from confuscope.operators.profile import extract_profiles
from confuscope.plans import queries as Q
from confuscope.plans import reports
from confuscope.plans.oracles import ORACLE_SQL
from confuscope.operators import distance as D
from confuscope.sources import config as G
from confuscope.sources import engines as E
from confuscope.sources import files as IO

from .conftest import SIMPLE, dense_of, tables


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", matrix=SIMPLE, script="simple", characters=np.array(list("abcde")), note="x", extra=np.array([1, 2]))
    np.savez(tmp_path / "b.npz", matrix=np.eye(30), script="auto")
    np.savez(tmp_path / "c.npz", matrix=np.eye(2))
    (tmp_path / "d.npz").write_bytes(b"broken")
    np.savez(tmp_path / "e.npz", matrix=np.array([[-1.0]]), script="neg")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in IO.read_npz(spark, str(tmp_path)).collect()}
    assert rows["a.npz"]["metadata"] == {"note": "x", "extra": "[1, 2]"} and rows["a.npz"]["error"] is None
    assert rows["b.npz"]["chars"][29] == "char_29" and "missing keys" in rows["c.npz"]["error"] and rows["d.npz"]["error"] and rows["e.npz"]["error"]
    cells, labels = IO.npz_tables(IO.read_npz(spark, str(tmp_path)))
    assert np.allclose(dense_of(cells.where("script = 'simple'"), 5), SIMPLE) and labels.where("script = 'auto'").count() == 30
    with pytest.raises(Exception, match="npz"):
        IO.read_npz(spark, str(tmp_path), strict=True).collect()
    content = IO.npz_bytes(*(t.where("script = 'simple'") for t in (cells, labels))).first()["content"]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "x.npz").write_bytes(bytes(content))
    back = IO.npz_tables(IO.read_npz(spark, str(tmp_path / "out")))[0]
    assert np.allclose(dense_of(back, 5), SIMPLE)


def test_native_format_and_exports(spark, tmp_path, literal):
    cells, labels = (t.where("script in ('simple', 'one')") for t in literal)
    IO.write_matrices(cells, labels, str(tmp_path / "m"))
    c, n = IO.read_matrices(spark, str(tmp_path / "m"))
    assert np.allclose(dense_of(c.where("script = 'simple'"), 5), SIMPLE) and n.count() == 6
    lines = [r["line"] for r in IO.csv_rows(cells, labels).where("script = 'simple'").orderBy("line_no").collect()]
    assert lines[0] == ",a,b,c,d,e" and lines[1] == "a,100,5,2,1,0" and len(lines) == 6
    import json

    j = json.loads(IO.matrix_json(cells, labels).where("script = 'simple'").first()["json"])
    assert j["matrix"] == SIMPLE.tolist() and j["characters"] == list("abcde") and j["metadata"]["size"] == 5 and j["top_confusions"][0]["count"] == 8
    IO.export_matrices(cells, labels, str(tmp_path / "e"), ("npz", "csv", "json", "parquet"))
    assert spark.read.text(str(tmp_path / "e/csv")).count() == 8
    with pytest.raises(ValueError):
        IO.export_matrices(cells, labels, str(tmp_path), ("xml",))
    d = D.frobenius(cells, labels)
    IO.write_distances(d, str(tmp_path / "d"))
    assert IO.read_distances(spark, str(tmp_path / "d")).first()["d"] == pytest.approx(d.first()["d"])


def test_quoted_labels(spark):
    cells = spark.createDataFrame([("s", ",", '"', 2.7), ("s", '"', '"', 1.0)], "script string, true_char string, pred_char string, n double")
    lines = [r["line"] for r in IO.csv_rows(cells, label_table(cells)).orderBy("line_no").collect()]
    assert lines == [',"""",","', '"""",1,0', '",",2,0']


def test_label_files(spark, tmp_path):
    (tmp_path / "latin_labels.txt").write_text('# head\n\na.png: "it\'s: x"\r\n b.png :  plain \nno colon\na.png: \'\'second\'\'\n', encoding="utf-8")
    (tmp_path / "greek_labels.txt").write_text("g.png: αβ\n", encoding="utf-8")
    got = {(r["script"], r["filename"]): r["text"] for r in IO.read_labels(spark, str(tmp_path)).collect()}
    assert got == {("latin", "a.png"): "second", ("latin", "b.png"): "plain", ("greek", "g.png"): "αβ"}
    assert IO.read_labels(spark, str(tmp_path), ["greek"]).count() == 1
    IO.write_labels(IO.read_labels(spark, str(tmp_path)), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/script=latin")).collect()] == ['# labels of latin, file name: "text"', 'a.png: "second"', 'b.png: "plain"']


EDGES = [" a b ", "'a'", '" \'a\' "', "\"' a '\"", "\u00a0a\u2003\u3000", "\ta\n", "\ra\u2028", "\u200ba\u0085", '" "', '"', "' '", "", None, "# x: y", "a: b\\", ' " a " ']
#: Files of (doc_id, text, lang), and some of what comes out.
ODD_DOCUMENTS = {
    "edges": ([[(k, t, lang) for k, t in enumerate(EDGES) for lang in ("en", None)]], {("en", "d0"): "a b", (None, "d1"): "'a'", ("en", "d4"): "a", ("en", "d12"): ""}),
    "null ids": ([[(None, "x", "de"), (None, "y", "de"), (1, "z", "de"), (None, None, None)]], {("de", None): None, ("de", "d1"): "z", (None, None): None}),
    "huge ids": ([[(-3, "x", "de"), (2**63 - 1, "last", "de"), (-(2**63), "first", "de")]], {("de", f"d{2**63 - 1}"): "last", ("de", f"d{-(2**63)}"): "first"}),
    "repeated ids": ([[(5, "one", "en"), (5, "two", "en"), (5, "zero", "en"), (6, "b", "en"), (5, "other", "fr")], [(6, "a" * 9000, "en"), (6, "c", "en"), *((100 + k, f"{k} " * 500 + ".", "en") for k in range(200))]],
                     {("en", "d5"): "one", ("en", "d6"): "b", ("fr", "d5"): "other"}),
}


@pytest.mark.parametrize("kind", ODD_DOCUMENTS)
def test_label_lines_of_odd_documents_match_sql(spark, tmp_path, kind):
    """SQL in one thread, where of equal ids the first row of the table holds."""
    files, some = ODD_DOCUMENTS[kind]
    (tmp_path / "documents.parquet").mkdir()
    for k, rows in enumerate(files):
        table = pa.table([list(c) for c in zip(*rows, strict=True)], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())]))
        pq.write_table(table, tmp_path / f"documents.parquet/part-{k}.parquet")
    got = [tuple(r) for r in Q.label_lines(spark, str(tmp_path)).select("script", "filename", "text").collect()]
    db = duckdb.connect(config={"threads": 1})
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"select script, filename, text from ({ORACLE_SQL['label_lines']})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert some.items() <= {r[:2]: r[2] for r in got}.items()


def test_inner_quotes_of_label_files(spark):
    """Files keep the parser's own rule: apostrophes go behind the double quotes, spaces within stay, the last line holds."""
    lines = [("s", 0, "a: x"), ("s", 1, "a: \"' y '\""), ("s", 2, "b: \" 'z'\"")]
    got = IO.label_lines(spark.createDataFrame(lines, "script string, line_no int, value string")).collect()
    assert {r["filename"]: r["text"] for r in got} == {"a": " y ", "b": " 'z"}


def test_text_files(spark, tmp_path):
    for script, name, data in (("latin", "a.txt", b"x \xc3\xa9\nline two"), ("cyrillic", "b.txt", "привет".encode("cp1251")), ("cyrillic", "c.txt", b"\x98\xe9"), ("latin", "d.txt", b" \n ")):
        (tmp_path / script).mkdir(exist_ok=True)
        (tmp_path / script / name).write_bytes(data)
    t = {r["filename"]: r for r in IO.read_texts(spark, str(tmp_path)).collect()}
    assert t["a.txt"]["text"] == "x é\nline two" and t["b.txt"]["text"] == "привет" and t["c.txt"]["text"] == "\x98é" and t["a.txt"]["script"] == "latin"
    loaded = {r["filename"]: r for r in IO.load_texts(IO.read_texts(spark, str(tmp_path)), {"latin": G.get_charset("latin")}).collect()}
    assert loaded["a.txt"]["cleaned_text"] == "x \nline two" and loaded["a.txt"]["line_count"] == 2 and "d.txt" not in loaded and loaded["b.txt"]["char_count"] == 6
    plan = IO.image_plan(IO.read_texts(spark, str(tmp_path)).where("script = 'latin'"), 2)
    assert sorted((r["filename"], r["text"]) for r in plan.collect()) == [("a_0000_aug0.png", "x é"), ("a_0000_aug1.png", "x é"), ("a_0001_aug0.png", "line two"), ("a_0001_aug1.png", "line two")]
    assert (IO.dataset_summary(plan, 2).first()["total_lines"], IO.dataset_summary(plan, 2).first()["total_images"]) == (2, 4)


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\x00\x00\x00"


def test_images(spark, tmp_path):
    (tmp_path / "latin").mkdir()
    for name, data in (("a.png", png(200, 100)), ("b.png", png(50, 100)), ("c.jpg", b"xx"), ("d.gif", b"xx"), ("e.PNG", png(1, 1))):
        (tmp_path / "latin" / name).write_bytes(data)
    images = IO.read_images(spark, str(tmp_path))
    counts = {r["format"]: r["n"] for r in IO.image_counts(images).collect()}
    assert counts == {".png": 2, ".jpg": 1}
    w, h = IO.png_size(F.col("content"))
    sized = images.select("filename", w.alias("w"), h.alias("h"))
    assert {r["filename"]: (r["w"], r["h"]) for r in sized.collect()} == {"a.png": (200, 100), "b.png": (50, 100), "c.jpg": (None, None)}
    assert [r["filename"] for r in sized.where(IO.within_size(F.col("w"), F.col("h"))).collect()] == ["a.png"]
    truth = spark.createDataFrame([("latin", "a.png", "t")], "script string, filename string, text string")
    assert {r["filename"]: r["text"] for r in IO.with_truth(images, truth).collect()} == {"a.png": "t", "b.png": None, "c.jpg": None}


def test_engines(spark):
    img = spark.createDataFrame([("s", "1", b"toe"), ("s", "2", b"\xff\xfe")], "script string, filename string, content binary")
    r = {x["filename"]: x for x in E.recognize_images(img, E.ChannelEngine).collect()}
    assert r["1"]["text"] == "τοε" and r["1"]["characters"] == ["τ", "ο", "ε"] and r["2"]["text"] == "" and "UnicodeDecodeError" in r["2"]["error"]
    assert isinstance(E.get_engine("channel"), E.ChannelEngine)
    with pytest.raises(RuntimeError):
        E.get_engine("trocr")
    with pytest.raises(ValueError):
        E.get_engine("nope")
    E.register_engine("easyocr", E.ChannelEngine)
    try:
        assert isinstance(E.get_engine("trocr"), E.ChannelEngine)
    finally:
        E._FACTORIES.pop("easyocr")
    assert E.ChannelEngine().recognize_characters(b"e", "s") == [("ε", 0.9)]


def test_settings(spark):
    s = G.PipelineSettings()
    assert s.output_dir == "data/confusion_matrices/surya" and len(s.scripts) == 4
    assert G.supported("easyocr", ["latin", "greek"]) == ["latin"]
    for engine, scripts in (("easyocr", ["greek"]), ("trocr", ["klingon"])):
        with pytest.raises(ValueError):
            G.supported(engine, scripts)
    back = G.settings_from_yaml(G.settings_to_yaml(s))
    assert back == s
    with pytest.raises(TypeError):
        G.settings_from_yaml("ocr: {engine: surya, nope: 1}")
    G.register_language("runic", "ᚠᚢ", {"trocr"})
    try:
        assert "runic" in G.engine_support()["trocr"] and G.charset_table(spark, ["runic"]).count() == 2
    finally:
        G.LANGUAGES.pop("runic")
    assert G.get_charset("none") == ""


def test_reports(spark):
    cells, labels = tables(spark, {"x": SIMPLE, "y": np.full((5, 5), 20.0)})
    text = reports.pipeline_report(cells, labels, "channel")
    assert "## X" in text and "accuracy 90.0%" in text and "`c` read as `d`: 8 times" in text
    p = extract_profiles(cells, labels).cache()
    d = D.distances(p).cache()
    report = reports.analysis_report(p, d, "spectral")
    assert "- identity: holds" in report and "- x: y (" in report
    assert '"x_vs_y"' in reports.analysis_json(p, d, "spectral").first()["json"]
    assert reports.feature_bars(p).count() == 14 and reports.heatmap(cells, labels).where("not show_labels").count() == 0
    h = reports.histogram(spark.createDataFrame([("a", "b", float(k)) for k in range(101)], "a string, b string, d double"), bins=10)
    assert {r["bin"]: r["n"] for r in h.collect()} == {**dict.fromkeys(range(9), 10), 9: 11}
    reps = spark.createDataFrame([("a", "b", k, float(k)) for k in range(-1, 101)], "a string, b string, rep int, d double")
    c = reports.critical_values(reps).first()
    assert (c["low"], c["high"]) == (5, 95)
    assert reports.checklist(D.sanity(D.square(d))).count() == 6


def test_streaming(spark, tmp_path):
    from confuscope.streaming import counts as S

    rows = [("s", "a", "a"), ("s", "a", "b"), ("s", "a", "a")]
    schema = "script string, true_char string, pred_char string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    seen = {}

    def each(batch, number):
        seen.update({(r["true_char"], r["pred_char"]): r["n"] for r in batch.collect()})

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    S.follow(S.streaming_cells(stream), each, str(tmp_path / "cp")).awaitTermination()
    assert seen == {("a", "a"): 2, ("a", "b"): 1}
    spark.createDataFrame([("s", "b", "b")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    S.follow(S.streaming_cells(stream), each, str(tmp_path / "cp")).awaitTermination()
    assert seen["b", "b"] == 1
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 05:00:00")], "user_id int, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    assert sorted(r["n"] for r in S.session_pairs(ev).collect()) == [1, 2]
    w = S.windowed_cells(ev.select("ts", F.lit("s").alias("script"), F.lit("a").alias("true_char"), F.lit("b").alias("pred_char")))
    assert sorted(r["n"] for r in w.collect()) == [1, 2]
    assert count_pairs(ev.select(F.lit("s").alias("script"), F.lit("a").alias("true_char"), F.lit("b").alias("pred_char"))).first()["n"] == 3


def test_sizes_of_image_files(spark):
    import struct

    from confuscope.functions.glyphs import to_png

    png = to_png(np.zeros((7, 9), dtype=np.uint8))
    bmp = b"BM" + bytes(16) + struct.pack("<ii", 12, -5) + bytes(8)
    entry = lambda o, tag, kind, v: struct.pack(o + "HHI", tag, kind, 1) + (struct.pack(o + "HH", v, 0) if kind == 3 else struct.pack(o + "I", v))
    tiff = lambda o, head: head + struct.pack(o + "IH", 8, 3) + entry(o, 254, 4, 0) + entry(o, 256, 3, 300) + entry(o, 257, 4, 70_000)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x03x\xff\xc2\x00\x11\x08" + struct.pack(">HH", 40, 60) + bytes(8)
    files = [png, bmp, tiff("<", b"II*\0"), tiff(">", b"MM\0*"), jpeg, b"GIF89a", b"", b"\xff\xd8\xff\xda", b"BM"]
    df = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate(files)] + [(99, None)], "k int, content binary")
    w, h = IO.image_size(F.col("content"))
    got = [tuple(r) for r in df.select("k", w.alias("w"), h.alias("h")).orderBy("k").collect()]
    assert got[:5] == [(0, 9, 7), (1, 12, 5), (2, 300, 70_000), (3, 300, 70_000), (4, 60, 40)]
    assert all(r[1] is None and r[2] is None for r in got[5:])


def test_a_file_for_each_matrix(spark, literal, tmp_path):
    import json

    cells, labels = (t.where("script in ('simple', 'sparse')") for t in literal)
    got = IO.write_files(IO.matrix_files(cells, labels), f"file://{tmp_path}/f").collect()
    names = {f"{s}.{e}" for s in ("simple", "sparse") for e in ("npz", "csv", "json")}
    assert {r["name"] for r in got} == names == {p.name for p in (tmp_path / "f").iterdir()}
    assert (np.load(tmp_path / "f" / "simple.npz")["matrix"] == SIMPLE).all()
    assert json.loads((tmp_path / "f" / "simple.json").read_text())["matrix"] == SIMPLE.tolist()
    assert (tmp_path / "f" / "simple.csv").read_text().splitlines()[:2] == [",a,b,c,d,e", "a,100,5,2,1,0"]
    with pytest.raises(ValueError):
        IO.matrix_files(cells, labels, ("xls",))


def test_public_names():
    import confuscope

    assert all(callable(getattr(confuscope, n)) for n in confuscope.__all__) and "distances" in dir(confuscope)
    with pytest.raises(AttributeError):
        confuscope.nothing  # noqa: B018
