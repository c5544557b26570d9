"""Op 3. Approximate nearest neighbours by multi-index hashing.

Codes: vectors are scaled to unit length (the largest inner product is what is sought; see below) and
multiplied by ``TABLES`` rotations, each learned on a bounded sample so that the signs keep as much of
the vectors as they can (iterative quantisation); the signs are the code.

Radius: ``CALIBRATION`` sampled queries are compared with every row, exactly; the radius is such that it
holds the share ``WANTED`` of their true neighbours.

Search: a code is split into 16-bit substrings. By the pigeonhole principle a code within the radius r
of a query's has a substring within floor(r / m) of the query's. Each block of the base is indexed: it has a posting
list for each value of each substring; the queries probe the lists of all values within that distance,
the codes found are compared in full, and those within the radius are reranked by their inner products
in double precision. Queries (the rows whose id is divisible by 20) meet the base in blocks of ``QUERY_BLOCK``,
of which ``PROBED`` at a time probe the index.

Norms: the rotation sees directions, and ranks are by inner product. A query whose ``K`` best in a block
could be beaten by a longer vector that isn't within the radius is the usual loss of hashing; the
calibration is done with true inner products, so the radius grows to what the data need.

Queries that find fewer than K within the radius over all blocks are searched again among all rows, exactly.

Edge cases: vectors that are null, zero, of another length than most, or with null or non-finite components take no part;
fewer candidates than K give fewer rows; ties go to the smaller vec_id; rows that repeat a vec_id are rows of their
own, each a candidate for the others, and as queries each with a ranking of its own; an empty table gives an empty result; further columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hdulake.llm._common import checkpointed, read

K = 20
QUERY_DIVISOR = 20
TABLES = 4
#: Bounds of the two samples: vectors that the rotations are learned on, and queries that set the radius.
SAMPLE, CALIBRATION = 8192, 64
WANTED = 0.985
BLOCK, QUERY_BLOCK = 4096, 16384
#: Queries that probe a block's index at a time.
PROBED = 1024


def learn_rotations(x: np.ndarray, tables: int = TABLES, rounds: int = 30, seed: int = 3) -> list[np.ndarray]:
    """Rotations R whose signs sign(x R) lie nearest to x R."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    out = []
    for _ in range(tables):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        out.append(r)
    return out


def encode(x: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    bits = np.concatenate([x @ r >= 0 for r in rotations], axis=1)
    pad = -bits.shape[1] % 16
    packed = np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)
    return np.ascontiguousarray(packed).view("<u2")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of aligned rows."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class MultiIndex:
    """Posting lists of a block's codes, by substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.lists = []
        for u in range(codes.shape[1]):
            values, inverse = np.unique(codes[:, u], return_inverse=True)
            self.lists.append((values, inverse))

    def probe(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Query and base places of all codes within the radius."""
        near = radius // self.codes.shape[1]
        found = np.zeros((len(queries), len(self.codes)), dtype=bool)
        for u, (values, inverse) in enumerate(self.lists):
            lists = np.bitwise_count(queries[:, u][:, None] ^ values[None, :]) <= near  # the posting lists to read
            found |= lists.take(inverse, axis=1)
        q, b = np.nonzero(found)
        keep = np.zeros(len(q), dtype=bool)
        for at in range(0, len(q), 1 << 18):
            part = slice(at, at + (1 << 18))
            keep[part] = distances(queries[q[part]], self.codes[b[part]]) <= radius
        return q[keep], b[keep]


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each query's k best rows: score falling, ties to the smaller id."""
    order = np.lexsort((ids, -scores, q))
    start = np.concatenate(([True], q[order][1:] != q[order][:-1]))
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < k]


@dataclass
class Block:
    """Vectors with their ids and the numbers of their rows."""

    rids: np.ndarray
    ids: np.ndarray
    x: np.ndarray

    @classmethod
    def of(cls, rids: bytes, ids: bytes, x: bytes) -> Block:
        i = np.frombuffer(ids, dtype="<i8")
        return cls(np.frombuffer(rids, dtype="<i8"), i, np.frombuffer(x, dtype=np.float64).reshape(len(i), -1))

    def parts(self, size: int = PROBED) -> Iterator[Block]:
        for at in range(0, len(self.ids), size):
            yield Block(*(v[at : at + size] for v in (self.rids, self.ids, self.x)))


def search_block(queries: Block, base: Block, rotations: list[np.ndarray], radius: int, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of a query and a vector of the base, and their score: each query's k best of the block within the radius."""
    index, done = MultiIndex(encode(unit(base.x), rotations)), 0
    for part in queries.parts():
        q, b = index.probe(encode(unit(part.x), rotations), radius)
        other = part.rids[q] != base.rids[b]
        q, b, s = best_of(q[other], b[other], part, base, k)
        yield q + done, b, s
        done += len(part.ids)


def best_of(q: np.ndarray, b: np.ndarray, queries: Block, base: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the candidates (places of queries and base) each query's k best, and their scores."""
    scores = np.empty(len(q))
    for at in range(0, len(q), 1 << 17):
        part = slice(at, at + (1 << 17))
        scores[part] = np.einsum("ij,ij->i", queries.x[q[part]], base.x[b[part]])
    top = best(q, base.ids[b], scores, k)
    return q[top], b[top], scores[top]


def search_whole(queries: Block, base: Block, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same from all rows of the block."""
    done = 0
    for part in queries.parts():
        other = part.rids[:, None] != base.rids[None, :]
        rough = np.where(other, part.x @ base.x.T, -np.inf)
        if len(base.ids) > k:
            # a product's rounding depends on its order of sums: what is that near the k-th best is scored again
            slack = 1e-9 * np.linalg.norm(part.x, axis=1) * np.linalg.norm(base.x, axis=1).max()
            other &= rough >= (np.partition(rough, -k, axis=1)[:, -k] - slack)[:, None]
        q, b, s = best_of(*np.nonzero(other), part, base, k)
        yield q + done, b, s
        done += len(part.ids)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null and size(vector) > 0")
    fine = rows.filter("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)")
    length = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.filter(F.size("vector") == (length["d"] if length else 0))


def blocks(rows: DataFrame, size: int, n: int, name: str) -> DataFrame:
    """The rows in about n // size blocks: row numbers, ids and vectors of each as byte strings, ordered by id."""

    def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        ids, rids = batch["vec_id"].to_numpy(), batch["rid"].to_numpy()
        order = np.lexsort((rids, ids))
        flat = batch["vector"].combine_chunks()
        x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), -1)
        return pa.table({name: pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([v[order].tobytes()], pa.binary()) for c, v in (("rids", rids.astype("<i8")), ("ids", ids.astype("<i8")), ("x", x))}})

    # the row's number takes part, so rows that repeat an id scatter as well
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(F.lit(33), "vec_id", "rid"), F.lit(max(1, -(-n // size)))).cast("int"))
    return dealt.groupBy(name).applyInArrow(run, f"{name} int, rids binary, ids binary, x binary")


def search(vectors: DataFrame, k: int = K, divisor: int = QUERY_DIVISOR, wanted: float = WANTED) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query."""
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors)).withColumn("rid", F.monotonically_increasing_id())  # stable: the rows lie in files now
    queries = rows.filter(F.col("vec_id") % divisor == 0)
    out = "query_rid long, query_id long, vec_id long, rid long, score double"
    n, n_queries = rows.count(), queries.count()
    order = (F.xxhash64(F.lit(3), "vec_id"), F.col("vec_id"), F.col("rid"))
    sample = np.array([r[0] for r in rows.orderBy(*order).limit(SAMPLE).select("vector").collect()])
    if not n_queries or n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rotations = learn_rotations(unit(sample))
    asked = queries.orderBy(*order).limit(CALIBRATION).collect()
    a = Block(*(np.array([r[c] for r in asked]) for c in ("rid", "vec_id", "vector")))
    base = checkpointed(blocks(rows, BLOCK, n, "base_block"))
    codes = encode(unit(a.x), rotations)
    every = codes.shape[1] * 16  # a radius that holds all codes

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*(batch[c].to_pylist() for c in ("rids", "ids", "x")), strict=True):
                block = Block.of(*cells)
                own = encode(unit(block.x), rotations)
                for q, b, s in search_block(a, block, rotations, every, k):
                    yield pa.RecordBatch.from_arrays([pa.array(a.rids[q]), pa.array(s), pa.array(distances(codes[q], own[b]), pa.int32())], names=["query_rid", "score", "far"])

    best_first = Window.partitionBy("query_rid").orderBy(F.desc("score"))
    nearest = base.mapInArrow(calibrate, "query_rid long, score double, far int").withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    far = sorted(r[0] for r in nearest.select("far").collect())  # CALIBRATION * k numbers
    radius = far[min(len(far) - 1, int(wanted * len(far)))]

    def meet(asking: DataFrame, n_asking: int, within: int | None) -> DataFrame:
        """The ranked k best of each asking row: within the radius, or of all rows if it is None."""

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for *left, r, i, x in zip(*(batch[c].to_pylist() for c in ("q_rids", "q_ids", "q_x", "rids", "ids", "x")), strict=True):
                    asked, block = Block.of(*left), Block.of(r, i, x)
                    for q, b, s in search_whole(asked, block, k) if within is None else search_block(asked, block, rotations, within, k):
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (asked.rids[q], asked.ids[q], block.ids[b], block.rids[b], s)], names=["query_rid", "query_id", "vec_id", "rid", "score"])

        n_blocks = max(1, -(-n_asking // QUERY_BLOCK))
        dealt = blocks(asking, QUERY_BLOCK, n_asking, "query_block").select("query_block", *(F.col(c).alias(f"q_{c}") for c in ("rids", "ids", "x")))
        # the stated query set against all rows, in blocks: each base block goes to every block of queries
        meeting = base.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(dealt, F.col("met") == F.col("query_block"))
        found = meeting.select("q_rids", "q_ids", "q_x", "rids", "ids", "x").repartition(max(8, min(n_blocks * max(1, n // BLOCK), 4096))).mapInArrow(find, out)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id", "rid")))
        return ranked.filter(F.col("rank") <= k).select("query_rid", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    near = checkpointed(meet(queries, n_queries, radius))
    full = near.filter(F.col("rank") == k).select(F.col("query_rid").alias("full"))
    short = checkpointed(queries.join(full, F.col("rid") == F.col("full"), "left_anti"))
    n_short = short.count()
    if n_short:
        near = near.join(full, F.col("query_rid") == F.col("full"), "left_semi").unionByName(meet(short, n_short, None))
    return near.select("query_id", "rank", "vec_id", "score")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
