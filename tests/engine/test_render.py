import numpy as np
import pytest
from pyspark.sql import functions as F

from confuscope.functions import render as R
from confuscope.operators import matrix as M

from .conftest import by_script


def test_layout(spark):
    df = spark.createDataFrame([("ab\nabcd",), ("x" * 500,), ("l\n" * 60,), ("",)], "t string")
    got = [tuple(r["l"]) for r in df.select(R.layout(F.col("t"), 10, 20).alias("l")).collect()]
    assert got[0] == (80, 96, 2) and got[1] == (800, 68, 1) and got[2][1] == 600 and got[2][2] == 20 and got[3] == (40, 68, 1)


def test_tags_are_fixed_and_about_as_likely_as_said(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k")).select("k", R.augmentation_tag(F.col("k")).alias("tag"))
    rows = {r["k"]: r["tag"] for r in df.collect()}
    assert rows == {r["k"]: r["tag"] for r in df.repartition(3).collect()}
    for name in R.AUGMENTATIONS:
        assert abs(np.mean([name in t for t in rows.values()]) - 0.3) < 0.03
    assert "none" in rows.values() and "noise+blur+rotation+brightness" in rows.values()


def test_pixels(spark):
    img = np.full((20, 30), 255, dtype=np.uint8)
    img[5:15, 10:20] = 0
    rng = np.random.default_rng(1)
    assert (R.augment(img, "none", rng) == img).all()
    blurred = R.augment(img, "blur", rng)
    assert 0 < blurred[5, 10] < 255 and blurred.shape == img.shape
    assert R.augment(img, "rotation", rng)[0, 15] == 255 and (R.augment(img, "noise", rng) != img).any()
    assert (R.augment(img // 2, "brightness", rng) != img // 2).any()
    with pytest.raises(ValueError):
        R.augment(img, "melt", rng)
    df = spark.createDataFrame([("a", 30, 20, bytearray(img.tobytes()))], "key string, width int, height int, pixels binary")
    r = R.augment_images(df).first()
    assert len(r["pixels"]) == 600 and r["tag"] == R.augment_images(df).first()["tag"]


def test_eigen_summary(literal):
    two = tuple(t.where("script in ('simple', 'one')") for t in literal)
    e = by_script(M.eigen_summary(M.eigen_table(*two, "laplacian", check=False), laplacian=True))
    assert e["simple"]["is_real"] and 0 < e["simple"]["fiedler_value"] < 2 and e["one"]["fiedler_value"] == 0
    b = M.eigen_table(*two, "bistochastic")
    assert by_script(M.eigen_summary(b))["simple"]["spectral_gap"] == pytest.approx(by_script(M.spectral_features(*two))["simple"]["bistochastic_gap"])
    assert M.top_eigenvalues(b, 2).count() == 3
