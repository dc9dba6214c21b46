"""Label pairs and spectra out of the synthetic tables, so that every operator has input at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import KEYS
from ..operators.counts import label_table
from .engines import channel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script: market segment; true: the customer's nation; pred: the supplier's.

    The order is (segment, nation) before it meets lineitem, so the large join carries two keys and two
    short strings. nation has 25 rows whatever the scale.
    """
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    name = lambda df, key, out: df.join(nation, F.col(key) == F.col("n_nationkey")).drop("n_nationkey", key).withColumnRenamed("n_name", out)
    customer = name(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("script"), "c_nationkey"), "c_nationkey", "true_char")
    supplier = name(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "pred_char")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "script", "true_char")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(*KEYS)


def _with_next(rows: DataFrame, key: str, time: str, unit: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with a column pred_char: ``value`` of the next row of the same ``key``, in ``order``, which starts with ``time``.

    Rows meet by key and unit of time only, so a key that very many rows have is many tasks; the last row of a unit gets
    the first one of the key's next unit from a table with a row for each key and unit.
    """
    rows = rows.withColumn("unit", F.date_trunc(unit, F.col(time)))
    first = rows.groupBy(F.col(key).alias("k"), F.col("unit").alias("u")).agg(F.min(F.struct(*order, F.col(value).alias("v"))).alias("first"))
    later = first.select("k", "u", F.lead("first.v").over(W.partitionBy("k").orderBy("u")).alias("later"))
    near = F.lead(F.struct(F.col(value).alias("v"))).over(W.partitionBy(key, "unit").orderBy(*order))
    both = rows.withColumn("near", near).join(later, F.col(key).eqNullSafe(F.col("k")) & F.col("unit").eqNullSafe(F.col("u")))
    return both.withColumn("pred_char", F.when(F.col("near").isNotNull(), F.col("near.v")).otherwise(F.col("later"))).drop("near", "later", "k", "u", "unit")


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script: user_id mod 4; an event's type and the next one of the user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    e = _with_next(e, "user_id", "ts", "day", ["ts", "event_id"], "event_type").where("pred_char is not null")
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("script"), F.col("event_type").alias("true_char"), "pred_char")


def status_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script: the customer's region; an order's status and the next one of the customer."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    where = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("script")))
    customer = table(spark, sf_dir, "customer").join(where, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "script")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("true_char"), "o_orderdate", "o_orderkey")
    o = _with_next(o, "o_custkey", "o_orderdate", "year", ["o_orderdate", "o_orderkey"], "true_char").where("pred_char is not null")
    return o.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(*KEYS)


def with_labels(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, labels) of pairs that are counted once and kept: the cells of all scripts are few, and
    every further operator starts from them."""
    from ..operators.counts import count_pairs

    cells = count_pairs(pairs).persist()
    return cells, label_table(cells)


def embedding_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script, family, values): absolute coordinates in descending order."""
    e = table(spark, sf_dir, "embeddings")
    values = F.sort_array(F.transform("embedding", lambda x: F.abs(x).cast("double")), asc=False)
    return e.select(F.format_string("v%06d", "vec_id").alias("script"), F.concat(F.lit("f"), F.col("label").cast("string")).alias("family"), values.alias("values"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script, filename, text): script is the language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("script"), F.format_string("d%09d", "doc_id").alias("filename"), "text")


def channel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script, filename, truth, prediction): a document's whole text and what a
    substituting channel makes of it. The rows are dealt out evenly, as aligning them costs far more
    than moving them and a file's split may hold all of them."""
    t = document_texts(spark, sf_dir).select("script", "filename", F.col("text").alias("truth"))
    t = t.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return t.withColumn("prediction", channel(F.col("truth")))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(script, a, b, truth, prediction): each turn of a conversation and the next one, whole texts; script is the role of
    the first, a the conversation and b its turn. As many pairs as turns, met by an equi-join."""
    c = table(spark, sf_dir, "conversations")
    first = c.select(F.col("role").alias("script"), F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.col("text").alias("truth"))
    second = c.select(F.col("conv_id").alias("a"), (F.col("turn") - 1).alias("b"), F.col("text").alias("prediction"))
    return first.join(second, ["a", "b"]).select("script", "a", "b", "truth", "prediction")
