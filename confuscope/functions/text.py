"""Text preparation as column expressions; only normalisation to NFC needs Python, and not for ASCII."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC."""
    return _nfc(text)


def fold_case(text: Column, case_sensitive: bool) -> Column:
    return text if case_sensitive else F.lower(text)


def _char_class(charset: str) -> str:
    return "".join("\\" + c if c in r"\]^-[&~" else c for c in charset)


def clean_text(text: Column, charset: str = "", normalize: bool = True) -> Column:
    """NFC, line ends to LF, tabs to spaces, runs of spaces to one and of three or more LF to two; other
    characters than the charset's and LF go, white space among them becoming a space; trimmed.

    An empty charset keeps every character.
    """
    out = nfc(text) if normalize else text
    out = F.replace(F.replace(out, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(F.translate(out, "\t", " "), " +", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    if charset:
        kept = _char_class(charset)
        out = F.regexp_replace(out, rf"(?U)[\s&&[^\n{kept}]]", " ")
        out = F.regexp_replace(out, rf"[^\n {kept}]", "")
    return F.regexp_replace(F.regexp_replace(out, " +", " "), r"(?U)^\s+|\s+$", "")


def characters(text: Column) -> Column:
    """Array of code points."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def line_texts(text: Column) -> Column:
    """Non-empty trimmed lines."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def one_line(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def segments(text: Column, chars: int = 100, lines: int = 5, shortest: int = 20) -> Column:
    """Array of segments: lines are gathered until the next one would exceed ``chars`` (line feeds not
    counted) or there are ``lines``; segments shorter than ``shortest`` (line feeds counted) go.

    A fold over the lines that carries the open segment; closed ones collect in an array.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, line: Column) -> Column:
        size = F.char_length(line)
        full = (a["n"] + size > chars) | (F.size(a["open"]) >= lines)
        closed = F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["done"])
        return F.when(full, F.struct(closed.alias("done"), F.array(line).alias("open"), size.alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(line)).alias("open"), (a["n"] + size).alias("n")))

    end = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(F.array_join(a["open"], "\n")))).otherwise(a["done"])
    return F.filter(F.aggregate(line_texts(text), start, step, end), lambda s: F.char_length(s) >= shortest)


def image_name(script: Column, number: Column, augmentation: Column) -> Column:
    return F.format_string("%s_%04d_aug%d.png", script, number, augmentation)
