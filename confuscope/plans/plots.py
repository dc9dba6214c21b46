"""Plots as SVG files, put together by column expressions: a row (name, svg) for each plot.

Inputs are tables behind plots (reports.py), whose rows follow alphabets and numbers of matrices, not observations.
Every mark has a title, which browsers show under the pointer. One hue stands for one measure; of several series the first
four have a colour and a label at their end, in fixed order, and the others are drawn in grey with their title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH, HEIGHT, LEFT, TOP, RIGHT, BOTTOM = 640, 360, 64, 40, 96, 44
SURFACE, INK, MUTED, GRID, AXIS = "#fcfcfb", "#0b0b0b", "#52514e", "#e1e0d9", "#c3c2b7"
SERIES, OTHERS = ("#2a78d6", "#eb6834", "#1baf7a", "#eda100"), "#c3c2b7"
#: Ends of the scale of one hue, as red, green and blue.
PALE, DEEP = (0xF4, 0xF8, 0xFE), (0x0D, 0x36, 0x6B)


def _escaped(text: Column) -> Column:
    out = text.cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    # What XML does not allow is shown by its code point.
    return F.when(out.rlike(r"^[\x00-\x1f]$"), F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(out)), 4, "0"))).otherwise(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def _n(x: Column, places: int = 1) -> Column:
    """A number as it stands in SVG."""
    return F.round(x, places).cast("string")


def _text(x: Column | float, y: Column | float, what: Column, anchor: str = "middle", size: int = 12, ink: str = MUTED) -> Column:
    at = lambda v: _n(v) if isinstance(v, Column) else F.lit(f"{v:g}")
    return F.concat(F.lit('<text x="'), at(x), F.lit('" y="'), at(y), F.lit(f'" text-anchor="{anchor}" font-size="{size}" fill="{ink}">'), what, F.lit("</text>"))


def _page(title: Column, body: Column, width: Column | float = WIDTH, height: Column | float = HEIGHT) -> Column:
    of = lambda v: v.cast("int").cast("string") if isinstance(v, Column) else F.lit(str(v))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), of(width), F.lit('" height="'), of(height), F.lit('" viewBox="0 0 '), of(width), F.lit(" "), of(height),
                    F.lit(f'" font-family="system-ui, sans-serif"><rect width="100%" height="100%" fill="{SURFACE}"/>'))
    return F.concat(head, _text(LEFT, 22, title, "start", 14, INK), body, F.lit("</svg>"))


def _joined(mark: Column, *order: str) -> Column:
    """The marks of a group in order, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, mark.alias("mark")))), lambda m: m["mark"]), "")


def _shade(share: Column) -> Column:
    part = lambda a, b: F.lpad(F.hex(F.round(F.lit(a) + (b - a) * share).cast("long")), 2, "0")
    return F.concat(F.lit("#"), *[part(a, b) for a, b in zip(PALE, DEEP, strict=True)])


def heatmap_svg(rows: DataFrame, name: str = "script", title: str = "Confusion matrix", cell: int = 18) -> DataFrame:
    """Of (name, i, j, true_char, pred_char, n): a square for each cell that has a value, darker for larger ones of the
    plot; labels on both sides up to 30 of them."""
    size = F.greatest(F.max("i").over(W.partitionBy(name)), F.max("j").over(W.partitionBy(name))) + 1
    top = F.max("n").over(W.partitionBy(name))
    r = rows.select(F.col(name).alias("name"), "i", "j", "true_char", "pred_char", "n", size.alias("size"), F.when(top > 0, F.col("n") / top).otherwise(F.lit(0.0)).alias("share"))
    tip = F.concat(_escaped(F.col("true_char")), F.lit(" read as "), _escaped(F.col("pred_char")), F.lit(": "), _n(F.col("n"), 4))
    mark = F.concat(F.lit('<rect x="'), (F.col("j") * cell + LEFT).cast("string"), F.lit('" y="'), (F.col("i") * cell + TOP).cast("string"),
                    F.lit(f'" width="{cell - 2}" height="{cell - 2}" fill="'), _shade(F.col("share")), F.lit('"><title>'), tip, F.lit("</title></rect>"))
    seen = r.groupBy("name").agg(F.first("size").alias("size"), _joined(mark, "i", "j").alias("body"))
    ends = r.select("name", F.col("i").alias("at"), F.col("true_char").alias("ch"), F.lit(True).alias("left")).unionByName(r.select("name", F.col("j").alias("at"), F.col("pred_char").alias("ch"), F.lit(False).alias("left"))).distinct()
    mid = F.col("at") * cell + cell // 2
    label = F.when(F.col("left"), _text(LEFT - 8, mid + TOP + 3, _escaped(F.col("ch")), "end", 11)).otherwise(_text(mid + LEFT - 1, TOP - 4, _escaped(F.col("ch")), "middle", 11))
    labels = ends.groupBy("name").agg(_joined(label, "left", "at").alias("labels"))
    both = seen.join(labels, "name")
    shown = F.when(F.col("size") <= 30, F.col("labels")).otherwise(F.lit(""))
    side = F.col("size") * cell
    return both.select("name", _page(F.concat(F.lit(f"{title}: "), _escaped(F.col("name"))), F.concat(F.col("body"), shown), side + LEFT + 24, side + TOP + 24).alias("svg"))


def _frame(x_title: str, y_title: str) -> Column:
    """Grid at quarters of the height, baseline, and what the axes measure; needs columns low, high."""
    bottom, parts = HEIGHT - BOTTOM, []
    for k in range(5):
        y = bottom - k * (bottom - TOP) / 4
        colour = AXIS if k == 0 else GRID
        parts.append(F.lit(f'<line x1="{LEFT}" x2="{WIDTH - RIGHT}" y1="{y:g}" y2="{y:g}" stroke="{colour}"/>'))
        parts.append(_text(LEFT - 6, y + 4, _n(F.col("low") + (F.col("high") - F.col("low")) * k / 4, 3), "end", 11))
    parts.append(_text((LEFT + WIDTH - RIGHT) / 2, HEIGHT - 8, F.lit(x_title)))
    parts.append(_text(LEFT, TOP - 6, F.lit(y_title), "start", 11))
    return F.concat(*parts)


def _y(value: Column) -> Column:
    high = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    return F.lit(float(HEIGHT - BOTTOM)) - (value - F.col("low")) / high * (HEIGHT - BOTTOM - TOP)


def _x(value: Column) -> Column:
    wide = F.when(F.col("right") > F.col("left"), F.col("right") - F.col("left")).otherwise(F.lit(1.0))
    return F.lit(float(LEFT)) + (value - F.col("left")) / wide * (WIDTH - RIGHT - LEFT)


def _edges(rows: DataFrame, zero: bool) -> DataFrame:
    """With the smallest and largest x and value of each plot; ``zero``: from zero on."""
    w = W.partitionBy("name")
    low = F.least(F.min("value").over(w), F.lit(0.0)) if zero else F.min("value").over(w)
    return rows.select("*", low.alias("low"), F.max("value").over(w).alias("high"), F.min("x").over(w).alias("left"), F.max("x").over(w).alias("right"))


def lines_svg(rows: DataFrame, title: str, x_title: str = "index", y_title: str = "value") -> DataFrame:
    """Of (name, series, x, value): a line for each series, the first four by name in colour and labelled at their end."""
    r = _edges(rows.select("name", "series", F.col("x").cast("double"), F.col("value").cast("double")), True)
    point = F.concat(_n(_x(F.col("x"))), F.lit(","), _n(_y(F.col("value"))))
    per = r.groupBy("name", "series").agg(
        F.array_sort(F.collect_list(F.struct("x", point.alias("p"), _y(F.col("value")).alias("y")))).alias("ps"), *[F.first(c).alias(c) for c in ("low", "high", "left", "right")])
    rank = F.row_number().over(W.partitionBy("name").orderBy("series"))
    per = per.withColumn("k", rank)
    colour = F.coalesce(*[F.when(F.col("k") == i + 1, F.lit(c)) for i, c in enumerate(SERIES)], F.lit(OTHERS))
    line = F.concat(F.lit('<polyline fill="none" stroke-width="2" stroke-linejoin="round" stroke="'), colour, F.lit('" points="'), F.array_join(F.transform("ps", lambda p: p["p"]), " "),
                    F.lit('"><title>'), _escaped(F.col("series")), F.lit("</title></polyline>"))
    # Labels keep a line's height from each other, in order of the lines' ends.
    end = F.element_at("ps", -1)["y"]
    place = F.rank().over(W.partitionBy("name", F.col("k") <= len(SERIES)).orderBy(end, "series"))
    y = F.greatest(end + 4, F.lit(float(TOP)) + place * 14)
    label = F.when(F.col("k") <= len(SERIES), F.concat(F.lit(f'<circle cx="{WIDTH - RIGHT + 8}" cy="'), _n(y - 4), F.lit('" r="4" fill="'), colour, F.lit('"/>'),
                                                       _text(WIDTH - RIGHT + 16, y, _escaped(F.col("series")), "start", 11, INK))).otherwise(F.lit(""))
    marked = per.withColumn("mark", F.concat(line, label)).withColumn("back", -F.col("k"))
    plots = marked.groupBy("name").agg(_joined(F.col("mark"), "back").alias("body"), F.first("low").alias("low"), F.first("high").alias("high"))
    return plots.select("name", _page(F.concat(F.lit(f"{title}: "), _escaped(F.col("name"))), F.concat(_frame(x_title, y_title), F.col("body"))).alias("svg"))


def bars_svg(rows: DataFrame, title: str, y_title: str = "value") -> DataFrame:
    """Of (name, label, value): a bar for each label, in the order of the labels, from zero."""
    w = W.partitionBy("name")
    r = rows.select("name", F.col("label").alias("label"), F.col("value").cast("double"), F.row_number().over(w.orderBy("label")).alias("k"), F.count("*").over(w).alias("n"))
    r = _edges(r.withColumn("x", F.col("k").cast("double")), True)
    step = F.lit(float(WIDTH - RIGHT - LEFT)) / F.col("n")
    x = F.lit(float(LEFT)) + (F.col("k") - 1) * step
    top, base = F.least(_y(F.col("value")), _y(F.lit(0.0))), F.greatest(_y(F.col("value")), _y(F.lit(0.0)))
    bar = F.concat(F.lit('<rect rx="2" x="'), _n(x + 1), F.lit('" y="'), _n(top), F.lit('" width="'), _n(F.greatest(step - 2, F.lit(1.0))), F.lit('" height="'), _n(base - top),
                   F.lit(f'" fill="{SERIES[0]}"><title>'), _escaped(F.col("label")), F.lit(": "), _n(F.col("value"), 4), F.lit("</title></rect>"))
    label = F.when(F.col("n") <= 12, _text(x + step / 2, HEIGHT - BOTTOM + 14 + 11 * F.pmod(F.col("k") - 1, F.lit(2)), _escaped(F.col("label")), "middle", 10)).otherwise(F.lit(""))
    plots = r.withColumn("mark", F.concat(bar, label)).groupBy("name").agg(_joined(F.col("mark"), "k").alias("body"), F.first("low").alias("low"), F.first("high").alias("high"))
    return plots.select("name", _page(F.concat(F.lit(f"{title}: "), _escaped(F.col("name"))), F.concat(_frame("", y_title), F.col("body"))).alias("svg"))


def scatter_svg(rows: DataFrame, title: str, x_title: str, y_title: str) -> DataFrame:
    """Of (name, id, x, value): a point for each row."""
    r = _edges(rows.select("name", "id", F.col("x").cast("double"), F.col("value").cast("double")), False)
    dot = F.concat(F.lit('<circle cx="'), _n(_x(F.col("x"))), F.lit('" cy="'), _n(_y(F.col("value"))), F.lit(f'" r="4" fill="{SERIES[0]}" stroke="{SURFACE}" stroke-width="2"><title>'),
                   _escaped(F.col("id")), F.lit(": "), _n(F.col("x"), 4), F.lit(", "), _n(F.col("value"), 4), F.lit("</title></circle>"))
    plots = r.groupBy("name").agg(_joined(dot, "id").alias("body"), *[F.first(c).alias(c) for c in ("low", "high", "left", "right")])
    ends = F.concat(_text(LEFT, HEIGHT - BOTTOM + 16, _n(F.col("left"), 3), "start", 11), _text(WIDTH - RIGHT, HEIGHT - BOTTOM + 16, _n(F.col("right"), 3), "end", 11))
    return plots.select("name", _page(F.concat(F.lit(f"{title}: "), _escaped(F.col("name"))), F.concat(_frame(x_title, y_title), ends, F.col("body"))).alias("svg"))


def write_svg(plots: DataFrame, out: str) -> None:
    """A folder ``name=...`` with the file of each plot."""
    plots.select("name", F.col("svg").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(out)
