import zlib
from urllib.parse import urlparse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confuscope import cli
from confuscope.functions import glyphs as G
from confuscope.functions import render as R
from confuscope.operators import texts as X
from confuscope.sources import engines as E
from confuscope.sources import files as IO

WIDE = R.RenderSettings(max_width=1 << 20, max_height=1 << 20)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\n"), max_size=12).map(lambda s: s.rstrip(" ")), min_size=1, max_size=4), st.integers(1, 3))
def test_what_is_drawn_is_read(lines, scale):
    while lines and not lines[-1]:
        lines.pop()
    pixels = G.from_png(G.to_png(G.draw("\n".join(lines), WIDE, scale)))
    text, sure = G.read(pixels, WIDE, scale)
    assert text == "\n".join(lines) and len(sure) == len(text) and all(x > 0.99 for x in sure)


def test_size_is_that_of_the_layout(spark):
    texts = ["ab\nabcd", "x" * 500, "l\n" * 60, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["l"] for r in df.select(R.layout(F.col("t"), G.BOX_WIDTH, G.BOX_HEIGHT).alias("l")).collect()]
    for t, want in zip(texts, got, strict=True):
        pixels = G.draw(t)
        assert pixels.shape == (want["height"], want["width"])
        assert (pixels[:20] == 255).all() and (pixels[:, :20] == 255).all() and (pixels[-20:] == 255).all()
    assert len(G.read(G.draw("l\n" * 60))[0].split("\n")) == got[2]["lines_drawn"]


def filtered(pixels, kind):
    """The rows of an image behind one of the format's filters, byte by byte."""
    h, w, n = pixels.shape
    out, above = b"", [0] * (w * n)
    for row in pixels.reshape(h, w * n).tolist():
        line = [kind]
        for i, x in enumerate(row):
            a, b, c = (row[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
            p = a + b - c
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes(line)
        above = row
    return out


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("colour, channels", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png_filters(kind, colour, channels):
    import struct

    pixels = np.random.default_rng(kind).integers(0, 256, (7, 9, channels))
    data = b"\x89PNG\r\n\x1a\n" + G._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 7, 8, colour, 0, 0, 0)) + G._chunk(b"IDAT", zlib.compress(filtered(pixels, kind))) + G._chunk(b"IEND", b"")
    want = pixels[:, :, : 3 if channels > 2 else 1].mean(axis=2)
    assert (G.from_png(data) == np.rint(want)).all()
    with pytest.raises(ValueError):
        G.from_png(data[:40] + b"x" + data[41:])
    with pytest.raises(ValueError):
        G.from_png(b"GIF89a")


def test_augmented_images_are_read_with_errors(spark):
    plan = spark.createDataFrame([("latin", f"f{k}", "The quick brown fox, 1234567890 jumps") for k in range(60)], "script string, filename string, text string")
    images = IO.render_images(plan, WIDE)
    rows = E.recognize_images(images, E.BoxEngine).collect()
    tags = {r["filename"]: r["tag"] for r in images.collect()}
    assert images.collect()[0]["content"] == images.repartition(3).where(F.col("filename") == images.collect()[0]["filename"]).first()["content"]
    assert all(r["error"] is None and r["characters"] == list(r["text"]) and len(r["char_confidences"]) == len(r["text"]) for r in rows)
    short = E.recognize_images(images, E.BoxEngine, details=False)
    assert short.columns == ["script", "filename", "text", "confidence", "error"]
    assert {(r["filename"], r["text"], r["confidence"]) for r in short.collect()} == {(r["filename"], r["text"], r["confidence"]) for r in rows}
    assert all(r["text"] == "The quick brown fox, 1234567890 jumps" for r in rows if tags[r["filename"]] in ("none", "noise", "brightness", "noise+brightness"))
    assert any(r["text"] != "The quick brown fox, 1234567890 jumps" for r in rows)
    broken = spark.createDataFrame([("latin", "x", bytearray(b"no image"))], "script string, filename string, content binary")
    assert "ValueError" in E.recognize_images(broken, E.BoxEngine).first()["error"]


def test_command_line_from_texts_to_matrices(spark, tmp_path, capsys):
    for script, text in (("latin", "Some words here\n\nand more of them"), ("cyrillic", "Съешь ещё\nэтих")):
        (tmp_path / "texts" / script).mkdir(parents=True)
        (tmp_path / "texts" / script / "a.txt").write_text(text, encoding="utf-8")
    out = f"file://{tmp_path}/out"
    assert cli.main(["render", "--texts", f"{tmp_path}/texts", "--out", out, "--augmentations", "2"]) == 0
    assert "8 images written" in capsys.readouterr().out
    images = IO.read_images(spark, f"{out}/images")
    assert images.count() == 8
    sizes = images.select(*[c.alias(n) for c, n in zip(IO.png_size(F.col("content")), ("w", "h"), strict=True)]).collect()
    assert all(r["w"] > 40 and r["h"] > 40 for r in sizes)
    truth = spark.read.text(f"{out}/labels")
    labels = IO.label_lines(truth.select("script", F.monotonically_increasing_id().alias("line_no"), "value")).withColumnRenamed("text", "truth")
    seen = E.recognize_images(images, lambda: E.BoxEngine(R.RenderSettings(max_width=4000))).withColumnRenamed("text", "prediction").select("script", "filename", "prediction")
    rows = X.match_texts(labels.join(seen, ["script", "filename"])).collect()
    assert len(rows) == 8 and all(r["cer"] == 0 for r in rows if r["filename"].endswith("aug0.png"))
    assert len(list((tmp_path / "out" / "images" / "latin").glob("*.png"))) == 4 and urlparse(out).path
