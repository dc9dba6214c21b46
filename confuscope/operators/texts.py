"""Statistics, coverage and segments of texts by script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.align import COUNTS, char_accuracy, char_error_rate, confusion_pairs, counted_alignment, operation_counts, with_alignment, with_edit_counts
from ..functions.scalar import ratio
from ..functions.text import characters, segments


def char_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(script, ch, n): pre-aggregated before the shuffle, so it moves one row for each character, script and task."""
    return texts.select("script", F.explode(characters(F.col(text_col))).alias("ch")).groupBy("script", "ch").agg(F.count("*").alias("n"))


def text_statistics(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(script, files, total_chars, total_lines, unique_chars); lines are LF-separated."""
    c = F.col(text_col)
    lines = F.when(c == "", 0).otherwise(F.size(F.split(c, "\n")))
    sums = texts.groupBy("script").agg(F.count("*").alias("files"), F.sum(F.char_length(c)).alias("total_chars"), F.sum(lines).cast("long").alias("total_lines"))
    kinds = char_counts(texts, text_col).groupBy("script").agg(F.count("*").alias("unique_chars"))
    return sums.join(kinds, "script", "left").na.fill(0, ["unique_chars"])


def top_characters(texts: DataFrame, k: int = 20, text_col: str = "text") -> DataFrame:
    """(script, rank, ch, n), ties by character."""
    w = W.partitionBy("script").orderBy(F.desc("n"), "ch")
    return char_counts(texts, text_col).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("script", "rank", "ch", "n")


def coverage(texts: DataFrame, charset: DataFrame, text_col: str = "text") -> DataFrame:
    """(script, covered, charset_size, coverage_percent, missing): missing characters sorted, without space and LF."""
    seen = char_counts(texts, text_col)
    j = charset.select("script", "ch").distinct().join(seen, ["script", "ch"], "left")
    lost = F.collect_list(F.when(F.col("n").isNull() & ~F.col("ch").isin(" ", "\n"), F.col("ch")))
    got = F.count("n")
    return j.groupBy("script").agg(got.alias("covered"), F.count("*").alias("charset_size"),
                                   (ratio(got, F.count("*")) * 100).alias("coverage_percent"), F.array_sort(lost).alias("missing"))


def segment_texts(texts: DataFrame, chars: int = 100, lines: int = 5, shortest: int = 20, cap: int | None = None, text_col: str = "text", file_col: str = "filename") -> DataFrame:
    """(script, source_file, segment_index, text); ``cap``: segments of a file at most."""
    rows = texts.select("script", F.col(file_col).alias("source_file"), F.posexplode(segments(F.col(text_col), chars, lines, shortest)).alias("segment_index", "text"))
    return rows if cap is None else rows.where(F.col("segment_index") < cap)


def match_texts(pairs: DataFrame, case_sensitive: bool = True, normalize: bool = True) -> DataFrame:
    """(script, filename, truth, prediction) with alignment, the four counts, accuracy and error rate."""
    rows = with_alignment(pairs, "truth", "prediction", case_sensitive, normalize)
    return _with_rates(rows.select("*", *operation_counts(F.col("alignment"))))


def _with_rates(rows: DataFrame) -> DataFrame:
    m, s, i, d = (F.col(c) for c in COUNTS)
    return rows.withColumn("char_accuracy", char_accuracy(m, s, d)).withColumn("cer", char_error_rate(m, s, i, d))


def match_counts(pairs: DataFrame, case_sensitive: bool = True, normalize: bool = True, keep: list[str] | None = None) -> DataFrame:
    """What match_texts gives but for the alignments, which then never leave their task; ``keep``: the columns of
    ``pairs`` that are wanted, by default all."""
    return _with_rates(with_edit_counts(pairs, "truth", "prediction", case_sensitive, normalize, keep))


def label_pairs(matched: DataFrame) -> DataFrame:
    """(script, true_char, pred_char) of all matched rows."""
    return matched.select("script", F.inline(confusion_pairs(F.col("alignment"))))


def match_cells(pairs: DataFrame, case_sensitive: bool = True, normalize: bool = True) -> DataFrame:
    """(script, true_char, pred_char, n) of (script, truth, prediction): what count_pairs makes of label_pairs of
    match_texts, without a row for each character in between."""
    counted = counted_alignment(pairs, "truth", "prediction", case_sensitive, normalize)
    return counted.groupBy("script", "true_char", "pred_char").agg(F.sum("n").cast("double").alias("n"))


def edit_distance(a: Column, b: Column, limit: int | None = None) -> Column:
    """Built-in edit distance; -1 beyond ``limit``."""
    return F.levenshtein(a, b) if limit is None else F.levenshtein(a, b, limit)


def mean_confidence(chars: Column, overall: Column) -> Column:
    """Mean of the characters' confidences, else the overall one."""
    s = F.aggregate(chars, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(chars) > 0, s / F.size(chars)).otherwise(overall)


def word_filter(words: DataFrame) -> DataFrame:
    """Recognised words that have a confidence and characters."""
    return words.where("conf <> -1 and text <> ''")
