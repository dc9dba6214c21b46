"""What images of text are made of beside the glyphs: sizes, kept lines, augmentations.

Glyph widths come from a font, which is not part of this engine; callers give the metrics. glyphs.py draws boxes of
hexadecimal digits instead, which need no font.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUGMENTATIONS = ("noise", "blur", "rotation", "brightness")


@dataclass(frozen=True)
class RenderSettings:
    padding: int = 20
    line_spacing: float = 1.4
    max_width: int = 800
    max_height: int = 600
    probability: float = 0.3
    noise: float = 0.02
    blur: float = 1.5
    degrees: float = 2.0
    low: float = 0.8
    high: float = 1.2


def layout(text: Column, char_width: float, line_height: int, settings: RenderSettings | None = None) -> Column:
    """struct(width, height, lines_drawn) of a text in glyphs of one width: clipped to the largest image;
    lines that would reach into the lower padding are left out."""
    s = settings or RenderSettings()
    lines = F.split(text, "\n")
    longest = F.array_max(F.transform(lines, F.char_length))
    width = F.least(F.ceil(longest * char_width) + 2 * s.padding, F.lit(s.max_width)).cast("int")
    height = F.least(F.floor(F.size(lines) * line_height * F.lit(s.line_spacing) + 2 * s.padding), F.lit(s.max_height)).cast("int")
    step = int(line_height * s.line_spacing)
    room = F.floor((height - 2 * s.padding - line_height) / step) + 1
    return F.struct(width.alias("width"), height.alias("height"), F.greatest(F.lit(0), F.least(F.size(lines), room)).cast("int").alias("lines_drawn"))


def augmentation_tag(key: Column, seed: int = 42, probability: float = 0.3) -> Column:
    """Joined names of the augmentations drawn for a key, or none; each is drawn by itself from a hash, so an
    image has the same ones wherever it is made."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), key), F.lit(1 << 20)) < int(probability * (1 << 20))
    tags = F.filter(F.array(*[F.when(draw(k), F.lit(k)) for k in AUGMENTATIONS]), lambda x: x.isNotNull())
    return F.when(F.size(tags) == 0, F.lit("none")).otherwise(F.array_join(tags, "+"))


def _gauss(img: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(img.ndim)]
        wide = np.pad(img, pad, mode="edge")
        img = sum(w * np.take(wide, range(i, i + img.shape[axis]), axis=axis) for i, w in enumerate(k))
    return img


def _turn(img: np.ndarray, degrees: float, fill: float = 255.0) -> np.ndarray:
    h, w = img.shape[:2]
    t, (y, x) = np.deg2rad(degrees), np.indices((h, w))
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.rint(cy + (y - cy) * np.cos(t) - (x - cx) * np.sin(t)).astype(int)
    sx = np.rint(cx + (y - cy) * np.sin(t) + (x - cx) * np.cos(t)).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.full_like(img, fill)
    out[inside] = img[sy[inside], sx[inside]]
    return out


def augment(pixels: np.ndarray, tag: str, rng: np.random.Generator, settings: RenderSettings | None = None) -> np.ndarray:
    """Apply the named augmentations to 8-bit pixels, in their order."""
    s, img = settings or RenderSettings(), pixels.astype(float)
    for name in () if tag == "none" else tag.split("+"):
        if name == "noise":
            img = np.clip(img + rng.normal(0, s.noise * 255, img.shape), 0, 255)
        elif name == "blur":
            img = _gauss(img, s.blur)
        elif name == "rotation":
            img = _turn(img, rng.uniform(-s.degrees, s.degrees))
        elif name == "brightness":
            img = img * rng.uniform(s.low, s.high)
            img = np.clip((img - img.mean()) * rng.uniform(s.low, s.high) + img.mean(), 0, 255)
        else:
            raise ValueError(f"unknown augmentation {name!r}")
    return np.clip(img, 0, 255).astype(np.uint8)


def augment_images(images: DataFrame, seed: int = 42) -> DataFrame:
    """(key, width, height, pixels, tag) of grey images (key, width, height, pixels binary), seeded by key."""
    tagged = images.withColumn("tag", augmentation_tag(F.col("key"), seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..operators.resample import rng_for

        for pdf in batches:
            out = [augment(np.frombuffer(p, dtype=np.uint8).reshape(h, w), t, rng_for(seed, k)).tobytes()
                   for k, w, h, p, t in zip(pdf["key"], pdf["width"], pdf["height"], pdf["pixels"], pdf["tag"], strict=True)]
            yield pdf[["key", "width", "height"]].assign(pixels=out, tag=pdf["tag"])

    return tagged.mapInPandas(run, "key string, width int, height int, pixels binary, tag string")
