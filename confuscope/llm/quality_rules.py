"""Rule bitmask ledger: every rule is evaluated once; policies are masks over the stored bits.

The ledger holds a row for each document with its measurements and ``failed``, a bitmask with a bit
for each rule that the document fails. A policy is a named, versioned set of rules; applying it is a
bitwise and, and an ablation (what would be kept without a rule) needs only the counts by mask.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 5
#: Texts that are Python objects at once.
ROWS = 500

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule names with the SQL condition under which a document fails; the position is the bit. Append only:
#: stored ledgers keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
#: The policy in production.
STANDARD = Policy("standard", 1, ("few_words", "repeated_windows", "symbols", "word_length", "duplicate_lines"))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; null counts as empty."""
    if not text:
        return (0,) * len(MEASURES)
    words = _WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            end = 0  # words before this one are counted
            for k, w in enumerate(windows):
                if often[w] > 1:
                    repeated += k + WINDOW - max(end, k)
                    end = k + WINDOW
    return n, sum(map(len, words)), len(_SYMBOL.findall(text)), lines, dup, repeated


_MEASURED = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])


@F.pandas_udf(_MEASURED)
def _measure_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    forget()
    for texts in batches:
        yield pd.DataFrame(list(map(measure, texts)), columns=list(MEASURES), dtype="int64")


def failed_bits() -> Column:
    """The bitmask over columns named as MEASURES."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def passes(policy: Policy, failed: Column) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def build_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the measurements, failed) for every row.

    Null texts measure zero throughout and so fail few_words. Repeated rows and null ids give a row
    each, other columns are left out, an empty table gives an empty ledger. Texts are read whole and
    one by one, so a very long one costs its own size in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                found = zip(*map(measure, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(m, pa.int64()) for m in found]], names=["doc_id", *MEASURES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("failed", failed_bits())


def filter_documents(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were, whatever their names."""
    m, f = fresh(docs, "measures"), fresh(docs, "failed")
    rules = [F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"`{m}`.\1", rule)) for _, rule in RULES]
    failed = F.lit(0)
    for k, rule in enumerate(rules):
        failed = failed.bitwiseOR(F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)))
    rows = docs.withColumn(m, _measure_udf(F.col(text_col))).withColumn(f, failed.cast("long"))
    return rows.where(passes(policy, F.col(f))).drop(m, f)


def mask_counts(ledger: DataFrame) -> DataFrame:
    """(failed, n): at most 2 ** number of rules rows, whatever the corpus."""
    return ledger.groupBy("failed").agg(F.count("*").alias("n"))


def ablations(spark: SparkSession, ledger: DataFrame, policies: list[Policy]) -> DataFrame:
    """For each policy and rule: documents kept, failed by the rule, failed by it alone, and kept
    without it. Aggregates masks bitwise; texts are not read again."""
    rows = [(p.name, p.version, r, p.mask, BITS[r]) for p in policies for r in p.rules]
    plan = spark.createDataFrame(rows, "policy string, version int, rule string, mask long, bit long")
    counts = mask_counts(ledger)
    on = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    failed = F.col("failed").bitwiseAND(F.col("mask"))
    return (
        # Both sides are bounded by the number of rules.
        plan.join(F.broadcast(counts), F.lit(True), "left").groupBy("policy", "version", "rule")
        .agg(
            on(failed == 0).alias("kept"),
            on(failed.bitwiseAND(F.col("bit")) != 0).alias("failed_by_rule"),
            on(failed == F.col("bit")).alias("failed_by_rule_alone"),
            on((failed == 0) | (failed == F.col("bit"))).alias("kept_without_rule"),
        )
    )
