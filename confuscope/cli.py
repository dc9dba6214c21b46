"""Command line: the batch entry points over folders of inputs.

    python -m confuscope.cli recognize --images DIR --truth DIR --out DIR [--engine NAME] [--scripts a,b]
    python -m confuscope.cli analyze --matrices DIR --out DIR [--method spectral]
    python -m confuscope.cli validate [--sizes latin=26,greek=24]
    python -m confuscope.cli plan --texts DIR --out DIR [--augmentations 3]
    python -m confuscope.cli render --texts DIR --out DIR [--augmentations 3] [--max-width 4000]
    python -m confuscope.cli scaffold --out DIR [--scripts a,b]
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.render import RenderSettings
from .operators import counts as C
from .operators import distance as D
from .operators import texts as X
from .operators import validation as V
from .operators.profile import extract_profiles
from .plans import plots, reports
from .session import get_session
from .sources import engines as E
from .sources import files as IO
from .sources.config import LANGUAGES, charset_table


def recognize(spark: SparkSession, images: str, truth: str, out: str, engine: str = "channel", scripts: list[str] | None = None) -> str:
    """Images and labels to matrices under ``out``; returns the report. Images without a label are skipped."""
    E.get_engine(engine)  # fails here, not in a task, if there is none
    labels = IO.read_labels(spark, truth, scripts)
    found = IO.read_images(spark, images)
    if scripts:
        found = found.where(found["script"].isin(scripts))
    labelled = found.join(labels.withColumnRenamed("text", "truth"), ["script", "filename"])
    read = E.recognize_images(labelled, lambda: E.get_engine(engine), details=False).where("error is null").select("script", "filename", "text")
    both = labels.withColumnRenamed("text", "truth").join(read.withColumnRenamed("text", "prediction"), ["script", "filename"])
    charset = charset_table(spark, scripts) if scripts else None
    cells, kept = C.build_matrices(X.label_pairs(X.match_texts(both)), charset)
    IO.write_matrices(cells, kept, out)
    cells, kept = IO.read_matrices(spark, out)
    IO.export_matrices(cells, kept, out, ("npz", "json"))
    IO.write_files(IO.matrix_files(cells, kept, ("npz", "json")), f"{out}/files").count()
    return reports.pipeline_report(cells, kept, engine)


def labels_of(profiles: DataFrame) -> DataFrame:
    """(script, k): scripts numbered by name, a row for each matrix."""
    return profiles.select("script", (F.row_number().over(W.orderBy("script")) - 1).alias("k"))


def analyze(spark: SparkSession, matrices: str, out: str, method: str = "spectral") -> str:
    """Matrices to profiles, distances, checks and plots under ``out``; returns the report."""
    cells, labels = IO.read_matrices(spark, matrices)
    profiles = extract_profiles(cells, labels)
    profiles.write.mode("overwrite").parquet(f"{out}/profiles")
    profiles = spark.read.parquet(f"{out}/profiles")
    IO.write_distances(D.distances(profiles, method, cells, labels), f"{out}/distances")
    dist = IO.read_distances(spark, f"{out}/distances")
    plots.write_svg(plots.heatmap_svg(reports.heatmap(cells, labels)), f"{out}/plots/matrices")
    square = D.square(dist).select("method", "a", "b", "d")
    at = lambda c, k: labels_of(profiles).select(F.col("script").alias(c), F.col("k").alias(k))
    grid = square.join(at("a", "i"), "a").join(at("b", "j"), "b").select(F.col("method").alias("script"), "i", "j", F.col("a").alias("true_char"), F.col("b").alias("pred_char"), F.col("d").alias("n"))
    plots.write_svg(plots.heatmap_svg(grid, title="Distances"), f"{out}/plots/distances")
    spectra = [profiles.select(F.lit(k).alias("name"), F.col("script").alias("series"), F.posexplode(f"{k}_spectrum").alias("x", "value")) for k in D.SPECTRA]
    plots.write_svg(plots.lines_svg(spectra[0].unionByName(spectra[1]).unionByName(spectra[2]), "Spectrum", "eigenvalue index", "magnitude"), f"{out}/plots/spectra")
    bars = reports.feature_bars(profiles).select(F.col("script").alias("name"), F.col("feature").alias("label"), "value")
    plots.write_svg(plots.bars_svg(bars, "Measures"), f"{out}/plots/measures")
    reports.analysis_json(profiles, dist, method).withColumnRenamed("json", "value").write.mode("overwrite").text(f"{out}/results")
    return reports.analysis_report(profiles, dist, method)


def render(spark: SparkSession, texts: str, out: str, augmentations: int = 3, max_width: int = 4000) -> str:
    """Texts to images, labels and a summary under ``out``, as recognize() takes them; returns the summary. The first
    image of a line is as drawn, the others are augmented."""
    settings = RenderSettings(max_width=max_width)
    plan = IO.image_plan(IO.read_texts(spark, texts), augmentations)
    first = plan["filename"].endswith("_aug0.png")
    images = IO.render_images(plan.where(first), settings, augmented=False).unionByName(IO.render_images(plan.where(~first), settings))
    n = IO.write_images(images, f"{out}/images").count()
    IO.write_labels(plan, f"{out}/labels")
    summary = IO.dataset_summary(plan, augmentations)
    summary.write.mode("overwrite").json(f"{out}/summary")
    lines = [f"{r['script']}: {r['total_lines']} lines, {r['total_images']} images" for r in summary.orderBy("script").collect()]
    return "\n".join([*lines, f"{n} images written"])


def scaffold(out: str, scripts: list[str]) -> list[str]:
    """Folders for images and labels of each script, and a label file to fill in; existing files stay."""
    made = []
    for s in scripts:
        Path(out, "images", s).mkdir(parents=True, exist_ok=True)
        target = Path(out, "ground_truth", f"{s}_labels.txt")
        target.parent.mkdir(parents=True, exist_ok=True)
        if not target.exists():
            target.write_text("# file name: text\n# image001.png: \"text\"\n", encoding="utf-8")
        made.append(str(target))
    return made


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="confuscope", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    names = lambda text: [x for x in text.split(",") if x]
    r = sub.add_parser("recognize")
    for k in ("images", "truth", "out"):
        r.add_argument(f"--{k}", required=True)
    r.add_argument("--engine", default="channel")
    r.add_argument("--scripts", type=names)
    a = sub.add_parser("analyze")
    a.add_argument("--matrices", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--method", default="spectral", choices=("spectral", "multi_spectrum", "frobenius"))
    v = sub.add_parser("validate")
    v.add_argument("--sizes", type=lambda t: {k: int(n) for k, _, n in (x.partition("=") for x in names(t))})
    t = sub.add_parser("plan")
    t.add_argument("--texts", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--augmentations", type=int, default=3)
    d = sub.add_parser("render")
    d.add_argument("--texts", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--augmentations", type=int, default=3)
    d.add_argument("--max-width", type=int, default=4000)
    s = sub.add_parser("scaffold")
    s.add_argument("--out", required=True)
    s.add_argument("--scripts", type=names, default=list(LANGUAGES))
    args = p.parse_args(argv)
    if args.command == "scaffold":
        print("\n".join(scaffold(args.out, args.scripts)))
        return 0
    spark = get_session()
    if args.command == "recognize":
        print(recognize(spark, args.images, args.truth, args.out, args.engine, args.scripts))
    elif args.command == "analyze":
        print(analyze(spark, args.matrices, args.out, args.method))
    elif args.command == "render":
        print(render(spark, args.texts, args.out, args.augmentations, args.max_width))
    elif args.command == "validate":
        V.method_comparison(spark, args.sizes).show(100, truncate=False)
    else:
        IO.write_labels(IO.image_plan(IO.read_texts(spark, args.texts), args.augmentations), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
