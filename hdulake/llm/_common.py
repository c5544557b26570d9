"""What the training-data operators share: input tables, scratch space, Arrow batches, hashes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that a Python operator works on at a time.
ROWS_AT_A_TIME = 512
#: Bytes of such a batch, unless one row has more.
BYTES_AT_A_TIME = 4 << 20
_adaptive = threading.RLock()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed_by(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """``df`` dealt by ``key`` and checkpointed so that later joins on ``key`` needn't shuffle it again.

    Only a plan that isn't adaptive tells how its output is dealt, so adaptive execution is off for this write, which
    one thread does at a time.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    with _adaptive:
        before = conf.get(name)
        conf.set(name, "false")
        try:
            return checkpointed(df.repartition(partitions, key))
        finally:
            conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder; its lineage ends there.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset (tests, a laptop) a folder of our own is made and removed when the process ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    tidy(spark)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            named = tempfile.mkdtemp(prefix="hdulake-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now rather than at the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_A_TIME, size: int = BYTES_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and, as far as single rows allow it, ``size`` bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halves(batch.slice(at, rows), size)


def _halves(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _halves(batch.slice(0, half), size)
    yield from _halves(batch.slice(half), size)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``rid``, a number of each row; it takes the place of a column of that name.

    The number follows from the row's place in its partition, and how files are cut into partitions may
    differ from plan to plan. Where several plans meet on it, the numbered rows are written first (``stored``).
    """
    return df.withColumn("rid", F.monotonically_increasing_id())


def stored(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``rid``, ``carried`` (a struct of the columns ``carry``) and ``packed`` (the text, compressed) of each row, written once.

    They are dealt by ``rid``, so joins on it leave the texts where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            packed = [None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["carried"], pa.array(packed, pa.binary())], names=["rid", "carried", "packed"])

    rows = numbered(docs.select(F.struct(*(docs[c] for c in carry)).alias("carried"), docs["text"].cast("string").alias("text"))).select("rid", "carried", "text")
    schema = T.StructType([rows.schema["rid"], rows.schema["carried"], T.StructField("packed", T.BinaryType())])
    return checkpointed_by(rows.mapInArrow(run, schema), shuffle_partitions(docs.sparkSession), "rid")


def text_of(packed: bytes | None) -> str | None:
    """The text of a ``packed`` column's value."""
    return None if packed is None else zlib.decompress(packed).decode("utf-8", "surrogatepass")


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` with ``text`` in place of ``packed``, which comes last."""
    others = [f for f in rows.schema if f.name != "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = [text_of(x) for x in batch["packed"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in others), pa.array(text, pa.string())], names=[*(f.name for f in others), "text"])

    return rows.mapInArrow(run, T.StructType([*others, T.StructField("text", T.StringType())]))


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod ``divisor``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply, twice); bijective, so no two values meet."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` well-mixed 64-bit words that follow from ``seed``."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BASE = np.uint64(0x9E3779B97F4A7C15)
#: Powers of the base and of its inverse modulo 2^64, by position; grown as texts ask for it.
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text's bytes, and where each begins and ends."""
    n = len(raw)
    edge = np.diff(np.concatenate(([1], _SPACE[raw].view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start, end
    power, inverse = powers_to(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end
