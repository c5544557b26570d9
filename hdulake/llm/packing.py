"""Op 2. Packing by concatenate and cut.

Every document becomes its ids and one end id. All documents are thought of as one long row of ids,
and sequences are fixed windows of it, so only the very last sequence is short. Pass one encodes and
totals each partition; the prefix sums of the totals (one number a partition, on the driver) tell each
partition where it starts. Pass two adds the prefix sums within the partition and cuts documents at
the window borders: a document over a border gives a record on either side.

The encoded rows are written to the checkpoint folder between the passes, with the number of the partition
that they were totalled in, so neither a lost executor nor another dealing of the partitions can make the
second pass see other sums than the first, and nothing is encoded twice.

Edge cases: a null or empty text is the end id alone; a very long text spans many sequences; repeated
rows and null doc_ids are packed like any other row; an empty table gives an empty result; further
columns are left behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.llm._common import checkpointed, read, slices

LENGTH = 2048
END_ID = 1

_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("piece", pa.binary())])


def encode_documents(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, ids (16-bit little-endian, with the end id) and their number."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hdulake.llm.tokens import encoder

        ids_of = encoder(path)
        for batch in slices(batches):
            ids = [ids_of.encode(text or "") + end for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], schema=_ENCODED)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n long")


def cut(starts: dict[int, int], length: int, with_ids: bool):
    """Pass two: pieces of the documents, given the global start of each partition ``part``; its rows come in their order."""
    fields = [f for f in _PIECES if with_ids or f.name != "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict(starts)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids, n, part in zip(*(batch[c].to_pylist() for c in ("doc_id", "ids", "n", "part")), strict=True):
                start, first = 0, at[part]
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    k = min(n - start, length - offset)
                    piece = ids[2 * start : 2 * (start + k)]
                    crc = zlib.crc32(np.frombuffer(piece, dtype="<u2").astype("<u4").tobytes())
                    rows.append((doc_id, start, k, crc, n, sequence, offset, piece)[: len(fields)])
                    start += k
                at[part] = first + n
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return run


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and piece (16-bit ids) if asked for.

    ids_crc32 is the digest of the piece's ids as little-endian unsigned 32-bit numbers.
    """
    encoded = checkpointed(encode_documents(docs, end_id, path).withColumn("part", F.spark_partition_id()))
    totals = encoded.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row a partition
    starts, at = {}, 0
    for p, n in sorted(map(tuple, totals)):
        starts[p] = at
        at += n
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", piece binary" * with_ids
    return encoded.mapInArrow(cut(starts, length, with_ids), schema)


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids (16-bit; at most ``length`` of them)."""
    parts = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("parts"))  # at most ``length`` pieces
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.piece))").alias("ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), with_ids=False)
