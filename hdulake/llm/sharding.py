"""Op 1. Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets that fit in memory, by a seeded hash of the record. Pass two
takes one bucket at a time and puts it into a uniformly random order (Fisher-Yates). The buckets one
after the other are then a random order of the whole table, and the shards are equal cuts of it, so
their row counts are at most one apart (the law ``rows``).

Only counts per bucket reach the driver, and there are at most ``MAX_BUCKETS`` of them.

Edge cases: a null text counts as empty for the size and its crc is that of the empty text; a null
doc_id is a value like any other; repeated rows are all kept, each with its own slot; an empty table
gives an empty result; an input's further columns are carried by ``shard_records`` if asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hdulake.llm._common import read, shuffle_partitions

#: Counts of this many buckets (two numbers each) may be held by the driver.
MAX_BUCKETS = 1 << 20
#: Small inputs are still dealt to this many buckets, so that all executors have work.
MIN_BUCKETS = 1024
BUCKET_BYTES = 64 << 20
ROW_OVERHEAD = 16


def record_size(text: Column) -> Column:
    """Bytes of a record: those of the text in UTF-8 and a fixed amount for the rest."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def bucket_of(doc_id: Column, text: Column, n_buckets: int, seed: int) -> Column:
    """Uniform in 0..n_buckets-1. The text takes part, so null or repeated doc_ids scatter as well."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text)), F.lit(n_buckets)).cast("int")


def count_buckets(total_bytes: int, bucket_bytes: int, least: int) -> int:
    return int(min(MAX_BUCKETS, max(least, -(-total_bytes // bucket_bytes))))


def fisher_yates(schema: pa.Schema, starts: np.ndarray, seed: int) -> Callable[[pa.Table], pa.Table]:
    """A function that shuffles one bucket and numbers its rows by their place in the whole order."""

    def shuffle(bucket: pa.Table) -> pa.Table:
        k = bucket["bucket"][0].as_py()
        # the rows come in any order; the same start order makes a rerun agree
        bucket = bucket.sort_by([("doc_id", "ascending"), ("order_key", "ascending")])
        order = np.arange(bucket.num_rows)
        np.random.Generator(np.random.PCG64([seed, k])).shuffle(order)  # numpy's shuffle is Fisher-Yates
        place = int(starts[k]) + np.arange(bucket.num_rows, dtype=np.int64)
        taken = bucket.take(pa.array(order)).append_column("place", pa.array(place))
        return taken.select(schema.names).cast(schema)

    return shuffle


def shard_records(docs: DataFrame, n_shards: int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """doc_id, text, shard (0..n_shards-1) and slot (its place in the shard, from 0)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    records = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    total = records.agg(F.sum(record_size(F.col("text")))).first()[0] or 0
    n_buckets = count_buckets(total, bucket_bytes, min_buckets)
    dealt = records.withColumn("bucket", bucket_of(F.col("doc_id"), F.col("text"), n_buckets, seed))
    counts = np.zeros(n_buckets + 1, dtype=np.int64)
    for k, n in dealt.groupBy("bucket").count().toLocalIterator():  # at most MAX_BUCKETS rows
        counts[k + 1] = n
    starts = np.cumsum(counts)
    n_rows = int(starts[-1])
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("place", T.LongType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("place", pa.int64())])
    placed = (
        dealt.withColumn("order_key", F.xxhash64(F.col("text")))
        .repartition(max(shuffle_partitions(spark), -(-n_buckets // 64)), "bucket")
        .groupBy("bucket")
        .applyInArrow(fisher_yates(arrow, starts[:-1], seed), out)
    )
    # shard s holds the places from floor(s * n / k) on
    shard = F.expr(f"((place + 1) * {n_shards} - 1) div {max(n_rows, 1)}").cast("int")
    return placed.withColumn("shard", shard).withColumn(
        "slot", F.col("place") - F.expr(f"(cast(shard as bigint) * {n_rows}) div {n_shards}")
    ).drop("place")


def write_shards(docs: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write the shards as Parquet, one folder a shard, in slot order within each file."""
    sharded = shard_records(docs, n_shards, **options)
    sharded.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_records(read(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id",
        record_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
