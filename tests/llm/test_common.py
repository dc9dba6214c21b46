from pathlib import Path
from urllib.parse import urlparse

import pytest

from confuscope.llm import common


def test_written_tables_and_their_end(spark):
    df = spark.range(3).selectExpr("id", "cast(null as string) as t")
    back = common.written(df, "x")
    assert back.dtypes == df.dtypes and back.count() == 3
    assert common.written(df.where("id > 5"), "x").count() == 0
    work = Path(urlparse(common.shared_dir(spark)).path) / "work"
    assert work.is_dir()
    common.clear_work(spark)
    assert not work.exists()


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "__id int, `A.b` int")
    assert common.fresh(df, "id") == "__id_" and common.fresh(df, "ID") == "__ID_"
    assert df.select(common.col_of("A.b").alias("x")).first()["x"] == 2
    assert df.select(common.ascii_lower(common.F.lit("ÄBc")).alias("x")).first()["x"] == "Äbc"

def test_tasks_forget_what_others_remember(tmp_path):
    seen = []
    common.remembers(lambda: seen.append(1))
    try:
        common.forget()
        assert seen == [1]
    finally:
        common._MEMORIES.pop()


def test_scratch_deletes_what_is_not_kept(spark):
    from types import SimpleNamespace

    exists = lambda df: Path(urlparse(df.__dict__["work_path"]).path).exists()
    with common.scratch(spark) as keep:
        a = common.written(spark.range(3), "a")
        with common.scratch(spark) as inner:
            b, c = inner(common.written(spark.range(4), "b")), common.written(spark.range(5), "c")
        assert exists(b) and not exists(c)
        keep(a)
    assert exists(a) and not exists(b) and a.count() == 3
    common.discard(a)
    assert not exists(a)
    common.discard(spark.range(1))
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    far = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        common.shared_dir(far)
