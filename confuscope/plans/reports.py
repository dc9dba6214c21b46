"""Reports for reading: a few rows are collected and set as Markdown; and the tables behind the plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import distance as D
from ..operators.counts import matrix_metrics, top_confusions
from ..operators.interpret import VECTOR
from ..operators.matrix import row_normalize


def pipeline_report(cells: DataFrame, labels: DataFrame, engine: str) -> str:
    """Size, observations, accuracy and the five largest confusions of each script."""
    rows = matrix_metrics(cells, labels).orderBy("script").collect()
    top: dict[str, list] = {}
    for r in top_confusions(cells, 5).orderBy("script", "rank").collect():
        top.setdefault(r["script"], []).append(r)
    out = [f"# Recognition report: {engine.upper()}", "", f"Scripts: {', '.join(r['script'] for r in rows)} ({len(rows)} matrices)", ""]
    for r in rows:
        out += [f"## {r['script'].title()}", "", f"- size {r['size']} x {r['size']}", f"- observations {r['total_observations']:,}",
                f"- accuracy {r['accuracy']:.1%}, error rate {r['error_rate']:.1%}, sparsity {r['sparsity']:.1%}", ""]
        out += [f"- `{x['true_char']}` read as `{x['pred_char']}`: {int(x['n'])} times" for x in top.get(r["script"], [])] + [""]
    return "\n".join(out)


def analysis_report(profiles: DataFrame, dist: DataFrame, method: str, validation: DataFrame | None = None) -> str:
    """Scripts, axioms, distances and nearest neighbours."""
    p = profiles.select("script", "matrix_size", "accuracy", "bistochastic_gap", "effective_rank").orderBy("script").collect()
    dist = dist.where(F.col("method") == method)
    ok = D.sanity(D.square(dist)).collect()
    d = {(r["a"], r["b"]): r["d"] for r in D.square(dist).collect()}
    out = [f"# Analysis: {method}", "", "| script | size | accuracy | gap | effective rank |", "|---|---|---|---|---|"]
    out += [f"| {r['script']} | {r['matrix_size']} | {r['accuracy']:.1%} | {r['bistochastic_gap']:.4f} | {r['effective_rank']:.1f} |" for r in p]
    out += ["", "## Axioms", ""] + [f"- {x}: {'holds' if r[x] else 'fails'}" for r in ok for x in D.AXIOMS]
    if validation is not None:
        out += ["", "## Synthetic ground truth", "", "| method | rho | tau | passed |", "|---|---|---|---|"]
        out += [f"| {r['method']} | {r['rho']:.3f} | {r['tau']:.3f} | {'yes' if r['passed'] else 'no'} |" for r in validation.collect()]
    names = [r["script"] for r in p]
    out += ["", "## Distances", "", "| | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    out += [f"| {a} | " + " | ".join(f"{d.get((a, b), 0.0):.4f}" for b in names) + " |" for a in names]
    out += ["", "## Nearest", ""] + [f"- {r['a']}: {r['nearest']} ({r['d']:.4f})" for r in D.nearest(dist).orderBy("a").collect()]
    return "\n".join(out) + "\n"


def analysis_json(profiles: DataFrame, dist: DataFrame, method: str) -> DataFrame:
    """One row (json): method, scripts, distances of pairs a < b keyed a_vs_b, and the axioms."""
    dist = dist.where(F.col("method") == method)
    scripts = profiles.agg(F.array_sort(F.collect_list(F.struct(F.col("script").alias("name"), F.col("matrix_size").alias("size"), "accuracy", F.col("bistochastic_gap").alias("spectral_gap"), "effective_rank"))).alias("scripts"))
    pairs = dist.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("_vs_", "a", "b"), "d")))).alias("distances"))
    ok = D.sanity(D.square(dist)).select(F.struct(*D.AXIOMS, "all_passed").alias("sanity"))
    one = scripts.join(F.broadcast(pairs), F.lit(True)).join(F.broadcast(ok), F.lit(True))
    return one.select(F.to_json(F.struct(F.lit(method).alias("method"), "scripts", "distances", "sanity")).alias("json"))


# ------------------------------------------------------------------------------------- tables behind plots


def heatmap(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Row-normalised cells by index, with whether labels are to be shown (30 at most)."""
    at = lambda c, name: labels.select("script", F.col("ch").alias(c), F.col("idx").alias(name))
    rows = row_normalize(cells, labels, "zero").join(at("true_char", "i"), ["script", "true_char"]).join(at("pred_char", "j"), ["script", "pred_char"])
    return rows.withColumn("show_labels", F.count("*").over(W.partitionBy("script")) <= 900).select("script", "i", "j", "true_char", "pred_char", "n", "show_labels")


def spectrum_lines(spectra: DataFrame) -> DataFrame:
    """(script, idx, value, cum) of (script, values): spectrum and its cumulative share."""
    zipped = F.arrays_zip(F.col("values").alias("value"), A.running(A.normalized_spectrum(F.col("values"))).alias("cum"))
    return spectra.select("script", F.posexplode(zipped).alias("idx", "z")).select("script", "idx", F.col("z.value").alias("value"), F.col("z.cum").alias("cum"))


def feature_bars(profiles: DataFrame) -> DataFrame:
    """(script, feature, value) of the interpretable measures."""
    return profiles.select("script", F.inline(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(v).alias("value")) for v in VECTOR])))


def histogram(values: DataFrame, value: str = "d", bins: int = 50, by: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """(by, bin, n) with bins of equal width between the smallest and the largest value."""
    edge = values.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    k: Column = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return values.join(edge, list(by)).groupBy(*by, k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def critical_values(reps: DataFrame) -> DataFrame:
    """(a, b, low, high): the 5 % and 95 % points of the null distances."""
    q = reps.where("rep >= 0").groupBy("a", "b").agg(F.percentile("d", [0.05, 0.95]).alias("q"))
    return q.select("a", "b", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def checklist(sanity: DataFrame) -> DataFrame:
    """(method, check_name, passed)."""
    return sanity.select("method", F.inline(F.array(*[F.struct(F.lit(x).alias("check_name"), F.col(x).alias("passed")) for x in (*D.AXIOMS, "all_passed")])))
