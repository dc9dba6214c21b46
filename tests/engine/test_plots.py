import re
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from confuscope import cli
from confuscope.plans import plots as P
from confuscope.plans import reports
from confuscope.sources import files as IO

SVG = "{http://www.w3.org/2000/svg}"


def drawn(df):
    out = {r["name"]: ET.fromstring(r["svg"]) for r in df.collect()}
    for page in out.values():
        w, h = float(page.get("width")), float(page.get("height"))
        for e in page.iter():
            for k in ("x", "cx", "x1", "x2"):
                assert e.get(k) is None or 0 <= float(e.get(k)) <= w
            for k in ("y", "cy", "y1", "y2"):
                assert e.get(k) is None or 0 <= float(e.get(k)) <= h
    return out


def test_heatmap(literal):
    pages = drawn(P.heatmap_svg(reports.heatmap(*literal)))
    squares = pages["simple"].findall(f"{SVG}rect")[1:]
    assert len(squares) == 23 and len(pages["identity"].findall(f"{SVG}rect")) == 11
    fills = {s.find(f"{SVG}title").text: s.get("fill") for s in squares}
    assert fills["e read as e: 0.94"] != fills["a read as d: 0.0093"] and all(re.fullmatch("#[0-9A-F]{6}", f) for f in fills.values())
    assert len(pages["simple"].findall(f"{SVG}text")) == 11


def test_odd_labels(spark):
    rows = [("a<&>", 0, 0, "<", "\n", 1.0), ("a<&>", 0, 1, "<", '"', 0.0), ("a<&>", 1, 1, "\x01", "&", 2.0)]
    df = spark.createDataFrame(rows, "script string, i int, j int, true_char string, pred_char string, n double")
    page, = drawn(P.heatmap_svg(df)).values()
    said = {e.text for e in page.iter() if e.text}
    assert {"Confusion matrix: a<&>", "<", "U+000A", "U+0001"} <= said


def test_lines_bars_and_points(spark):
    rows = [("p", f"s{k}", x, float(k * x)) for k in range(6) for x in range(4)] + [("flat", "one", 0, 0.0)]
    pages = drawn(P.lines_svg(spark.createDataFrame(rows, "name string, series string, x int, value double"), "Lines"))
    lines = pages["p"].findall(f"{SVG}polyline")
    assert [x.find(f"{SVG}title").text for x in lines] == ["s5", "s4", "s3", "s2", "s1", "s0"]
    assert [x.get("stroke") for x in lines] == [P.OTHERS, P.OTHERS, *reversed(P.SERIES)]
    ends = sorted(float(c.get("cy")) for c in pages["p"].findall(f"{SVG}circle"))
    assert len(ends) == 4 and all(b - a >= 13.9 for a, b in zip(ends, ends[1:], strict=False))
    bars = drawn(P.bars_svg(spark.createDataFrame([("p", "a", 2.0), ("p", "b", -1.0), ("p", "c", 0.0)], "name string, label string, value double"), "Bars"))["p"].findall(f"{SVG}rect")[1:]
    assert [float(b.get("height")) for b in bars] == [184.0, 92.0, 0.0] and float(bars[0].get("y")) == P.TOP
    dots = drawn(P.scatter_svg(spark.createDataFrame([("p", "a", 1.0, 2.0), ("p", "b", 3.0, 4.0)], "name string, id string, x double, value double"), "Points", "x", "y"))["p"].findall(f"{SVG}circle")
    assert [(d.get("cx"), d.get("cy")) for d in dots] == [("64.0", "316.0"), ("544.0", "40.0")]


def test_analysis_writes_plots(spark, literal, tmp_path, capsys):
    cells, labels = (t.where("script in ('simple', 'sparse')") for t in literal)
    IO.write_matrices(cells, labels, f"{tmp_path}/m")
    assert cli.main(["analyze", "--matrices", f"{tmp_path}/m", "--out", f"{tmp_path}/o", "--method", "spectral"]) == 0
    found = {str(p.relative_to(tmp_path / "o" / "plots").parent) for p in (tmp_path / "o" / "plots").rglob("part-*.txt")}
    assert found == {f"matrices/name={s}" for s in ("simple", "sparse")} | {"distances/name=spectral"} | {f"spectra/name={s}" for s in ("bistochastic", "symmetric", "laplacian")} | {
        f"measures/name={s}" for s in ("simple", "sparse")}
    page = spark.read.text(f"{tmp_path}/o/plots/distances", wholetext=True).select(F.col("value")).first()["value"]
    assert len(ET.fromstring(page.strip()).findall(f"{SVG}rect")) == 5
