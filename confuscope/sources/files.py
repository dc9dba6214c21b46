"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import glyphs
from ..functions.render import RenderSettings, augment, augmentation_tag
from ..model import CELLS, LABELS
from .config import ImageSettings

# ------------------------------------------------------------------------------------------------- matrices

_NPZ = "path string, script string, chars array<string>, cells array<struct<i:int,j:int,n:double>>, metadata map<string,string>, error string"


def _npz_row(path: str, content: bytes) -> tuple:
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            missing = {"matrix", "script"} - set(z.files)
            if missing:
                raise ValueError(f"missing keys: {sorted(missing)}")
            m = z["matrix"].astype(float)
            if m.ndim != 2 or m.shape[0] != m.shape[1] or (m < 0).any():
                raise ValueError("not a square matrix of counts")
            n = len(m)
            auto = [chr(ord("a") + k) for k in range(n)] if n <= 26 else [f"char_{k}" for k in range(n)]
            chars = [str(c) for c in z["characters"]] if "characters" in z.files else auto
            if len(chars) != n:
                raise ValueError("labels and matrix differ in size")
            i, j = np.nonzero(m)
            cells = [{"i": int(a), "j": int(b), "n": float(m[a, b])} for a, b in zip(i, j, strict=True)]
            meta = {k: str(z[k].item() if z[k].ndim == 0 else z[k].tolist()) for k in z.files if k not in ("matrix", "script", "characters")}
            return path, str(z["script"]), chars, cells, meta, None
    except (ValueError, KeyError, OSError) as e:
        return path, None, [], [], {}, str(e)


def read_npz(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A row for each file of ``path``: script, labels, cells by index, metadata, error.

    Files with pickled objects are refused. ``strict`` raises at the first bad file, else it is a row with
    its error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_npz_row(p, c) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            if strict and any(r[-1] for r in rows):
                raise ValueError(next(f"{r[0]}: {r[-1]}" for r in rows if r[-1]))
            yield pd.DataFrame(rows, columns=["path", "script", "chars", "cells", "metadata", "error"])

    return files.mapInPandas(run, _NPZ)


def npz_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, labels) of the good files."""
    good = rows.where("error is null")
    labels = good.select("script", F.posexplode("chars").alias("idx", "ch"))
    at = lambda k: F.element_at("chars", F.col("c")[k] + 1)
    cells = good.select("script", "chars", F.explode("cells").alias("c")).select("script", at("i").alias("true_char"), at("j").alias("pred_char"), F.col("c.n").alias("n"))
    return cells, labels


def npz_bytes(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, content): the npz file of each matrix."""
    from ..operators.matrix import dense, dense_input

    chars = labels.groupBy("script").agg(F.array_sort(F.collect_list(F.struct("idx", "ch"))).alias("ls")).select("script", F.col("ls.ch").alias("chars"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.savez(out, matrix=dense(pdf), script=pdf["script"].iloc[0], characters=np.array(list(pdf["chars"].iloc[0])))
        return pd.DataFrame({"script": [pdf["script"].iloc[0]], "content": [out.getvalue()]})

    return dense_input(cells, labels).join(chars, "script").groupBy("script").applyInPandas(run, "script string, content binary")


def write_matrices(cells: DataFrame, labels: DataFrame, path: str) -> None:
    """The native format: two Parquet tables, partitioned by script."""
    cells.write.mode("overwrite").partitionBy("script").parquet(f"{path}/cells")
    labels.write.mode("overwrite").partitionBy("script").parquet(f"{path}/labels")


def read_matrices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A filter on script prunes folders."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return read("cells", CELLS), read("labels", LABELS)


def write_distances(dist: DataFrame, path: str) -> None:
    dist.write.mode("overwrite").parquet(path)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv_rows(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, line_no, line): the CSV of each matrix; a header of labels, then integer counts by row."""
    quote = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    names = labels.groupBy("script").agg(F.array_sort(F.collect_list(F.struct("idx", "ch"))).alias("ls"))
    head = names.select("script", F.lit(0).alias("line_no"), F.concat(F.lit(","), F.array_join(F.transform("ls", lambda x: quote(x["ch"])), ",")).alias("line"))
    rows = cells.groupBy("script", "true_char").agg(F.map_from_entries(F.collect_list(F.struct("pred_char", "n"))).alias("m"))
    full = labels.join(rows.withColumnRenamed("true_char", "ch"), ["script", "ch"], "left").join(names, "script")
    cell = lambda x: F.coalesce(F.element_at("m", x["ch"]), F.lit(0.0)).cast("bigint").cast("string")
    body = full.select("script", (F.col("idx") + 1).alias("line_no"), F.concat_ws(",", quote(F.col("ch")), F.array_join(F.transform("ls", cell), ",")).alias("line"))
    return head.unionByName(body)


def matrix_json(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(script, json): labels, dense matrix, metadata and the ten largest confusions."""
    from ..operators.counts import matrix_metrics, top_confusions

    names = labels.groupBy("script").agg(F.array_sort(F.collect_list(F.struct("idx", "ch"))).alias("ls"))
    rows = cells.groupBy("script", "true_char").agg(F.map_from_entries(F.collect_list(F.struct("pred_char", "n"))).alias("m"))
    full = labels.join(rows.withColumnRenamed("true_char", "ch"), ["script", "ch"], "left").join(names, "script")
    dense = full.select("script", "idx", F.transform("ls", lambda x: F.coalesce(F.element_at("m", x["ch"]), F.lit(0.0))).alias("row"))
    matrix = dense.groupBy("script").agg(F.array_sort(F.collect_list(F.struct("idx", "row"))).alias("m")).select("script", F.col("m.row").alias("matrix"))
    top = top_confusions(cells, 10).groupBy("script").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("true_char").alias("true"), F.col("pred_char").alias("predicted"), F.col("n").cast("bigint").alias("count")))).alias("top_confusions"))
    j = names.join(matrix, "script").join(matrix_metrics(cells, labels), "script").join(top, "script", "left")
    meta = F.struct("accuracy", "error_rate", "total_observations", "sparsity", "size").alias("metadata")
    return j.select("script", F.to_json(F.struct("script", F.col("ls.ch").alias("characters"), "matrix", meta, "top_confusions")).alias("json"))


def write_files(rows: DataFrame, out: str) -> DataFrame:
    """Write the binary ``content`` of each row as the file ``out/<name>``; returns (name, path). Files are written under a
    name of the attempt and then renamed, so that a task which runs again leaves whole files only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(out)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                folder, _, last = f"{root}/{name}".rpartition("/")
                fs.create_dir(folder, recursive=True)
                temp = f"{folder}/.{last}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(temp) as stream:
                    stream.write(bytes(content))
                fs.move(temp, f"{folder}/{last}")
            yield pd.DataFrame({"name": pdf["name"], "path": [f"{out}/{n}" for n in pdf["name"]]})

    return rows.select("name", "content").mapInPandas(run, "name string, path string")


def matrix_files(cells: DataFrame, labels: DataFrame, formats: tuple[str, ...] = ("npz", "csv", "json")) -> DataFrame:
    """(name, content): a file ``<script>.<format>`` for each matrix and format."""
    unknown = set(formats) - {"npz", "csv", "json"}
    if unknown or not formats:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    named = lambda df, ext, content: df.select(F.concat("script", F.lit("." + ext)).alias("name"), content.cast("binary").alias("content"))
    parts = []
    if "npz" in formats:
        parts.append(named(npz_bytes(cells, labels), "npz", F.col("content")))
    if "csv" in formats:
        lines = csv_rows(cells, labels).groupBy("script").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
        parts.append(named(lines, "csv", F.concat(F.array_join("ls.line", "\n"), F.lit("\n"))))
    if "json" in formats:
        parts.append(named(matrix_json(cells, labels), "json", F.col("json")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def export_matrices(cells: DataFrame, labels: DataFrame, path: str, formats: tuple[str, ...] = ("npz", "csv", "json")) -> None:
    """Write each format under its own folder, a folder for each script in it."""
    unknown = set(formats) - {"npz", "csv", "json", "parquet"}
    if unknown:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    for f in formats:
        if f == "parquet":
            write_matrices(cells, labels, f"{path}/parquet")
        elif f == "npz":
            npz_bytes(cells, labels).write.mode("overwrite").partitionBy("script").parquet(f"{path}/npz")
        elif f == "csv":
            lines = csv_rows(cells, labels).repartition("script").sortWithinPartitions("script", "line_no")
            lines.select("script", F.col("line").alias("value")).write.mode("overwrite").partitionBy("script").text(f"{path}/csv")
        else:
            matrix_json(cells, labels).withColumnRenamed("json", "value").write.mode("overwrite").partitionBy("script").text(f"{path}/json")


# ---------------------------------------------------------------------------------------------------- labels


#: The space separators, which SQL's trim() takes off when it is told no characters.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def label_lines(lines: DataFrame, inner: str = "'", ties: tuple[str, ...] = ()) -> DataFrame:
    """(script, filename, text) of (script, line_no, value): blank lines, comments and lines without a colon
    are skipped; double quotes around the text go and then the characters of ``inner``; of a repeated name the last
    line holds, of equal numbers the first by the columns ``ties``."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    v = strip(F.col("value"))
    rows = lines.withColumn("v", v).where("v <> '' and not startswith(v, '#') and instr(v, ':') > 0")
    text = F.trim(F.trim(F.col("t"), F.lit('"')), F.lit(inner))
    rows = rows.select("script", "line_no", *ties, strip(F.expr("substring(v, 1, instr(v, ':') - 1)")).alias("filename"), strip(F.expr("substring(v, instr(v, ':') + 1)")).alias("t"))
    rows = rows.select("script", "filename", F.struct(F.negative("line_no"), *ties).alias("at"), text.alias("text"))
    return rows.groupBy("script", "filename").agg(F.min_by("text", "at").alias("text"))


def read_labels(spark: SparkSession, folder: str, scripts: list[str] | None = None) -> DataFrame:
    """truth from the files ``<script>_labels.txt`` of a folder; other scripts' files are left out."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*_labels.txt").text(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)_labels\.txt$", 1)
    rows = files.select(name.alias("script"), F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "value"))
    return label_lines(rows if scripts is None else rows.where(F.col("script").isin(scripts)))


def write_labels(truth: DataFrame, folder: str) -> None:
    """Label lines ``name: "text"`` sorted by name behind a comment that says so, a folder for each script."""
    lines = truth.select("script", "filename", F.concat("filename", F.lit(': "'), "text", F.lit('"')).alias("value"))
    head = truth.select("script").distinct().select("script", F.lit("").alias("filename"), F.concat(F.lit("# labels of "), "script", F.lit(', file name: "text"')).alias("value"))
    lines = head.unionByName(lines)
    sorted_ = lines.repartition("script").sortWithinPartitions("script", "filename")
    sorted_.select("script", "value").write.mode("overwrite").partitionBy("script").text(folder)


# ----------------------------------------------------------------------------------------------------- texts


def decode_text(content: Column) -> Column:
    """UTF-8 if valid, else Windows-1251 unless its one undefined byte occurs, else ISO-8859-1."""
    # Windows-1251 is no charset of decode(): each byte above 127 is read as its ISO-8859-1 character and
    # replaced by the one that it stands for. In hex, an even place holds the first digit of a byte.
    high = [b for b in range(0x80, 0x100) if b != 0x98]
    cyrillic = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, high)), bytes(high).decode("cp1251"))
    undefined = F.hex(content).rlike("^(?:[0-9A-F]{2})*?98")
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, F.decode(content, "UTF-8")).when(undefined, F.decode(content, "ISO-8859-1")).otherwise(cyrillic)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(script, filename, text) of ``folder/<script>/*.txt``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(folder)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)$", k)
    return files.select(part(1).alias("script"), part(2).alias("filename"), decode_text(F.col("content")).alias("text"))


def load_texts(texts: DataFrame, charsets: dict[str, str] | None = None) -> DataFrame:
    """(script, filename, original_text, cleaned_text, line_count, char_count); empty ones are dropped."""
    from ..functions.text import clean_text

    cleaned = clean_text(F.col("text"), "")
    for script, charset in (charsets or {}).items():
        cleaned = F.when(F.col("script") == script, clean_text(F.col("text"), charset)).otherwise(cleaned)
    rows = texts.select("script", "filename", F.col("text").alias("original_text"), cleaned.alias("cleaned_text")).where("trim(cleaned_text) <> ''")
    return rows.withColumn("line_count", F.size(F.split("cleaned_text", "\n"))).withColumn("char_count", F.char_length("cleaned_text"))


#: Characters of a file's name by which files are gathered.
FRONT = 7


def image_plan(texts: DataFrame, augmentations: int = 3) -> DataFrame:
    """(script, filename, text): one image for each non-empty line and augmentation. Images of a script are
    numbered over its files by name; the numbers of lines before a file are summed up among the files that
    begin alike, and then over these beginnings, so that no task gets all files."""
    lines = texts.select("script", F.col("filename").alias("file"), F.posexplode(F.expr(
        r"filter(transform(split(text, '\n'), x -> regexp_replace(x, r'(?U)^\s+|\s+$', '')), x -> x <> '')")).alias("at", "text"))
    counts = lines.groupBy("script", "file").agg(F.count("*").alias("n"))
    counts = counts.withColumn("front", F.substring("file", 1, FRONT))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    far = counts.groupBy("script", "front").agg(F.sum("n").alias("n")).select("script", "front", before(W.partitionBy("script").orderBy("front")).alias("far"))
    near = counts.select("script", "file", "front", before(W.partitionBy("script", "front").orderBy("file")).alias("near"))
    base = near.join(far, ["script", "front"]).select("script", "file", (F.col("near") + F.col("far")).alias("base"))
    stem = F.regexp_replace("file", r"\.txt$", "")
    rows = lines.join(base, ["script", "file"]).withColumn("aug", F.explode(F.sequence(F.lit(0), F.lit(augmentations - 1))))
    return rows.select("script", F.format_string("%s_%04d_aug%d.png", stem, (F.col("base") + F.col("at")).cast("int"), "aug").alias("filename"), "text")


def dataset_summary(plan: DataFrame, augmentations: int = 3) -> DataFrame:
    """(script, total_lines, total_images)."""
    return plan.groupBy("script").agg((F.count("*") / augmentations).cast("long").alias("total_lines"), F.count("*").alias("total_images"))


# ---------------------------------------------------------------------------------------------------- images


def render_images(plan: DataFrame, settings: RenderSettings | None = None, scale: int = 1, augmented: bool = True, seed: int = 42) -> DataFrame:
    """(script, filename, text, tag, content): the PNG file of each row (script, filename, text) of a plan. ``augmented``: with the
    augmentations that are drawn for the file's name; tag says which."""
    tagged = plan.select("script", "filename", "text", (augmentation_tag(F.col("filename"), seed, (settings or RenderSettings()).probability) if augmented else F.lit("none")).alias("tag"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..operators.resample import rng_for

        for pdf in batches:
            drawn = [glyphs.draw(t or "", settings, scale) for t in pdf["text"]]
            files = [glyphs.to_png(augment(p, tag, rng_for(seed, name), settings)) for p, tag, name in zip(drawn, pdf["tag"], pdf["filename"], strict=True)]
            yield pdf.assign(content=files)

    return tagged.mapInPandas(run, "script string, filename string, text string, tag string, content binary")


def write_images(images: DataFrame, out: str) -> DataFrame:
    """Write every image as ``out/<script>/<filename>``; returns (name, path)."""
    return write_files(images.select(F.concat_ws("/", "script", "filename").alias("name"), "content"), out)


def read_images(spark: SparkSession, folder: str, settings: ImageSettings | None = None) -> DataFrame:
    """(script, filename, format, content) of ``folder/<script>/*``; the names' case counts."""
    formats = (settings or ImageSettings()).formats
    glob = "*.{" + ",".join(f.lstrip(".") for f in formats) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)$", k)
    return files.select(part(1).alias("script"), part(2).alias("filename"), F.concat(F.lit("."), F.substring_index("path", ".", -1)).alias("format"), "content")


def png_size(content: Column) -> tuple[Column, Column]:
    """(width, height) from a PNG's header, null for other content."""
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.when(is_png, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))
    return number(17), number(21)


def size_of(content: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, JPEG, BMP or TIFF file; None for other content."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return abs(w), abs(h)
    if content[:4] in (b"II*\0", b"MM\0*") and len(content) >= 8:
        return _tiff_size(content, "<" if content[:2] == b"II" else ">")
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            kind = content[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header, not tables
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 1 if kind == 0xFF else 2 if kind == 1 or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def _tiff_size(content: bytes, order: str) -> tuple[int, int] | None:
    """Width and height are the entries 256 and 257 of the first directory, numbers of two or four bytes."""
    found, at = {}, struct.unpack(order + "I", content[4:8])[0]
    n = struct.unpack(order + "H", content[at : at + 2])[0] if at + 2 <= len(content) else 0
    for k in range(n):
        entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12:
            tag, kind = struct.unpack(order + "HH", entry[:4])
            if tag in (256, 257):
                found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (found[256], found[257]) if len(found) == 2 else None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def _size_udf(contents: pd.Series) -> pd.DataFrame:
    found = [size_of(bytes(c)) if c is not None else None for c in contents]
    return pd.DataFrame({"width": pd.array([f[0] if f else None for f in found], "Int32"), "height": pd.array([f[1] if f else None for f in found], "Int32")})


def image_size(content: Column) -> tuple[Column, Column]:
    """(width, height) of an image file, null if it is of no known kind. PNG files are read by the JVM; only others are
    handed to Python."""
    width, height = png_size(content)
    other = _size_udf(F.when(width.isNull(), content))
    return F.coalesce(width, other["width"]), F.coalesce(height, other["height"])


def within_size(width: Column, height: Column, settings: ImageSettings | None = None) -> Column:
    s = settings or ImageSettings()
    return width.between(s.min_width, s.max_width) & height.between(s.min_height, s.max_height)


def image_counts(images: DataFrame) -> DataFrame:
    """(script, format, n); contents are not read."""
    return images.groupBy("script", "format").agg(F.count("*").alias("n"))


def with_truth(images: DataFrame, truth: DataFrame) -> DataFrame:
    """Images with their label, null if there is none."""
    return images.join(truth, ["script", "filename"], "left")
