"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records uniformly over buckets of memory size by a seeded hash of their id and
text. Pass two gathers each bucket, puts it in a canonical order, applies a Fisher-Yates
shuffle whose draws are hashes of seed, bucket and place, and writes it. The shuffle moves the numbers of the records
alone; texts go through sorts, which spill, and never lie in one array. The concatenation of the buckets is one
shuffled order; record number p goes to shard p mod shards, at slot p div shards, so the shards'
counts are at most one apart. Nothing but the rows and the seed decides the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import work_path

SEED = 20_240_607
SHARDS = 8
#: Target bytes of text, and rows, in a bucket; a swap costs as much as the bucket has rows.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 1024
#: Target bytes of text that one task gathers; each writes a file for every shard.
TASK_BYTES = 32 << 20
#: Buckets whose offsets one task sums up.
GROUP = 4096


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with the number of each among its equals (h and c are hashes of id and text). Equal rows are
    merged within tasks before the shuffle and made again after it, so they never meet in one task."""
    merged = rows.groupBy("h", "c").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("n"))
    return merged.select("doc_id", "text", "h", "c", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy"))


def _offsets(sizes: DataFrame) -> DataFrame:
    """(bucket, n, base) of (bucket, n): the records in all buckets before. Sums run within groups of buckets, and over the
    groups, of which there is one for GROUP buckets."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = sizes.withColumn("group", F.floor(F.col("bucket") / GROUP))
    groups = rows.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", before(W.orderBy("group")).alias("far"))
    near = rows.select("bucket", "n", "group", before(W.partitionBy("group").orderBy("bucket")).alias("near"))
    return near.join(groups, "group").select("bucket", "n", (F.col("near") + F.col("far")).alias("base"))


def _places(n: Column, seed: int, bucket: Column) -> Column:
    """Array of the places to which a Fisher-Yates shuffle brings the records 0 to n - 1. The shuffle goes from the last place
    down, each swaps with a drawn one up to it; the same swaps from the first place up give its inverse, which this is."""

    def swapped(a: Column, i: Column, j: Column) -> Column:
        at = lambda k: F.array(F.coalesce(F.element_at(a, k + 1), F.lit(0)))
        part = lambda lo, hi: F.slice(a, lo + 1, hi - lo)
        return F.when(i == j, a).otherwise(F.concat(part(F.lit(0), j), at(i), part(j + 1, i), at(j), part(i + 1, F.size(a))))

    def step(a: Column, i: Column) -> Column:
        draw = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        return F.element_at(F.transform(F.array(draw), lambda j: swapped(a, i, j)), 1)

    start = F.sequence(F.lit(0), n - 1)
    return F.when(n < 2, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, lambda a, i: F.coalesce(step(a, i), a)))


def shuffle_to_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES, out: str | None = None,
) -> DataFrame:
    """Write the shards and read them back: (doc_id, text, shard, slot).

    Files lie under ``shard=k`` folders of ``out`` (by default a folder in the shared one). Null texts
    stay null and null ids are hashed like values; rows equal in id and text are numbered, so that
    they scatter like others; texts of any length are kept whole; other columns are left out, whatever their names; an empty
    table gives no rows. The seed alone fixes the order of given rows, however they are partitioned. The number of
    buckets follows the bytes and rows, that of the tasks that gather them the bytes; offsets are summed up by tasks and joined
    by bucket. Each file's rows lie in the order of their slots.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = docs.sparkSession
    out = out or work_path(spark, "shards")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("c", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)))
    keys = rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 16).alias("bytes"))
    n_rows, n_bytes, most = keys.agg(F.sum("n"), F.sum("bytes"), F.max("n")).first()
    buckets = max(1, -(-(n_bytes or 0) // bucket_bytes), -(-(n_rows or 0) // BUCKET_ROWS))
    rows = _numbered(rows) if (most or 0) > 1 else rows.withColumn("copy", F.lit(0))
    bucket = F.pmod(F.xxhash64("h", "copy"), F.lit(buckets))
    scattered = rows.select(bucket.alias("bucket"), "doc_id", "text", "h", "copy")
    tasks = min(buckets, max(-(-(n_bytes or 0) // TASK_BYTES), spark.sparkContext.defaultParallelism))
    offsets = _offsets(scattered.groupBy("bucket").agg(F.count("*").alias("n"))).repartition(tasks, "bucket")
    places = offsets.select("bucket", "base", _places(F.col("n").cast("int"), seed, F.col("bucket")).alias("places"))
    rank = F.row_number().over(W.partitionBy("bucket").orderBy("h", "copy", "doc_id", "text"))
    ranked = scattered.repartition(tasks, "bucket").withColumn("rank", rank)
    # Merged and not broadcast: Spark cannot tell how long the arrays are, and they are made in the tasks that join.
    at = F.col("base") + F.element_at("places", F.col("rank"))
    placed = ranked.join(places.hint("merge"), "bucket").select(
        "doc_id", "text", F.floor(at / shards).cast("long").alias("slot"), F.pmod(at, F.lit(shards)).cast("int").alias("shard"))
    placed = placed.sortWithinPartitions("shard", "slot")
    placed.write.partitionBy("shard").option("compression", "zstd").parquet(out)
    return spark.read.schema("doc_id long, text string, slot long, shard int").parquet(out)
