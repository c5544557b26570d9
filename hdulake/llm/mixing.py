"""Op 9. Mixing sources to target weights with cube-method balanced sampling.

A source's target over its size is the expected number of copies of each of its documents, 0 to 2. The
whole part is taken for certain; the fractional part is an inclusion probability. The cube method
turns the probabilities into 0 or 1: in its flight phase it moves the vector of probabilities along
directions in the null space of the balancing constraints (the documents' number and their words), so
both totals stay what they were while at each step at least one probability becomes 0 or 1. With two
constraints any three open documents allow such a step; a flight ends when ``KEEP`` are still open.

Flights run in blocks of documents dealt out by a seeded hash, each block within one source; the open
documents of all blocks meet in ever fewer blocks (a round leaves ``KEEP`` of ``BLOCK``) until one block
for each source is left. There the landing phase decides the last ones by trying all outcomes.

The driver holds one row a source. Hot sources are many blocks like any other.

Edge cases: a null text has size 0 and is taken 0 words; null sources form a group of their own that
sorts last; repeated rows are units of their own; an empty table gives an empty result; further
columns are left behind. Reruns agree: a block's order is that of its hashes.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hdulake.llm._common import checkpointed, numbered, read

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096
#: Documents that a block leaves open. So many, of all sizes, make the landing exact to a few words.
KEEP = 12
EPSILON = 1e-9

_UNITS = pa.schema([("rid", pa.int64()), ("source", pa.string()), ("unit", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("size", pa.int64()), ("chance", pa.float64()), ("block", pa.int64())])
_UNITS_DDL = "rid long, source string, unit long, doc_id long, text_hash long, size long, chance double, block long"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """The words to take from each source: ``share`` of all, by weight, none over ``most`` times its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        open_ -= set(over)
        left -= sum(out[i] for i in over)
    return out


def flight(chance: list[float], size: list[float], seed: int = 0, keep: int = KEEP) -> list[float]:
    """Move the chances, keeping their sum and the sum of chance * size, until at most ``keep`` (2 at least) lie within (0, 1)."""
    coin = random.Random(seed).random
    chance = list(chance)
    waiting = [i for i, p in enumerate(chance) if EPSILON < p < 1 - EPSILON][::-1]
    open_: list[int] = []
    while True:
        while len(open_) < 3 and waiting:
            open_.append(waiting.pop())
        if len(open_) + len(waiting) <= max(2, keep):
            return chance
        i, j, k = open_
        # the null space of the rows (1, 1, 1) and (size_i, size_j, size_k)
        step = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
        if not any(step):
            step = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, u in zip(open_, step, strict=True):
            if u > 0:
                up, down = min(up, (1 - chance[x]) / u), min(down, chance[x] / u)
            elif u < 0:
                up, down = min(up, chance[x] / -u), min(down, (1 - chance[x]) / -u)
        # the nearer end with the higher chance, so that each expected value stays as it was
        by = up if coin() < down / (up + down) else -down
        for x, u in zip(open_, step, strict=True):
            chance[x] = min(1.0, max(0.0, chance[x] + by * u))
            if chance[x] < EPSILON:
                chance[x] = 0.0
            elif chance[x] > 1 - EPSILON:
                chance[x] = 1.0
        open_ = [x for x in open_ if 0 < chance[x] < 1]


def landing(chance: list[float], size: list[float]) -> list[float]:
    """Decide what is still open: of all outcomes the one nearest in words, then in documents."""
    chance = list(chance)
    open_ = [i for i, p in enumerate(chance) if 0 < p < 1]
    words, number = sum(chance[i] * size[i] for i in open_), sum(chance[i] for i in open_)
    outcomes = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(outcomes @ np.array([size[i] for i in open_], dtype=float) - words) if open_ else np.zeros(1)
    best = int(np.lexsort((np.abs(outcomes.sum(1) - number), off))[0])
    for b, x in enumerate(open_):
        chance[x] = float(best >> b & 1)
    return chance


def fly(last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("unit", "ascending"), ("doc_id", "ascending"), ("text_hash", "ascending")])
        size = [float(x) for x in block["size"].to_pylist()]
        chance = flight(block["chance"].to_pylist(), size, block["unit"][0].as_py())
        if last:
            chance = landing(chance, size)
        return block.set_column(block.schema.get_field_index("chance"), "chance", pa.array(chance, pa.float64())).select(_UNITS.names).cast(_UNITS)

    return run


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 9, block: int = BLOCK, rid: str | None = None) -> DataFrame:
    """rid (a number of the row, or the column ``rid`` that has it), doc_id, source, text_hash, size, source_size, target, copies (times the mix takes the document)."""
    spark = docs.sparkSession
    units = (docs.withColumn("rid", docs[rid]) if rid else numbered(docs)).select("rid", docs["source"].cast("string").alias("source"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), words_in(docs["text"]).alias("size"))
    units = checkpointed(units)  # counted once; a few numbers a row
    # one row a source; Python orders strings by code point, as is asked for
    found = sorted(units.groupBy("source").agg(F.sum("size"), F.count("*")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([r[1] for r in found], weights, share, most)
    plan = [(r[0], int(r[1]), float(t), float(t / r[1]) if r[1] else 0.0, int(r[2])) for r, t in zip(found, wanted, strict=True)]
    table = spark.createDataFrame(plan, "p_source string, source_size long, target double, ratio double, n long")
    units = units.join(table, units["source"].eqNullSafe(F.col("p_source")), "left").drop("p_source")
    units = units.withColumns({"base": F.floor("ratio").cast("long"), "unit": F.xxhash64(F.lit(seed), "doc_id", "text_hash")})
    units = units.withColumn("chance", F.col("ratio") - F.col("base"))
    # documents of no words are never taken; the others with a fractional part fly
    flying = units.filter((F.col("chance") > EPSILON) & (F.col("chance") < 1 - EPSILON) & (F.col("size") > 0))
    blocks = {r[0]: max(1, -(-int(r[2]) // block)) for r in found}
    n = max(blocks.values(), default=1)
    level = flying.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "unit", "size"), F.expr(f"(n + {block - 1}) div {block}"))).select(*_UNITS.names)
    done: list[DataFrame] = []
    while True:
        last = n <= 1
        level = checkpointed(level.groupBy("source", "block").applyInArrow(fly(last), _UNITS_DDL))
        done.append(level.filter((F.col("chance") <= 0) | (F.col("chance") >= 1)))
        if last:
            break
        n = -(-KEEP * n // block)
        still = level.filter((F.col("chance") > 0) & (F.col("chance") < 1))
        level = still.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 2), "unit", "block"), F.lit(n)))
    picked = done[0]
    for more in done[1:]:
        picked = picked.unionAll(more)
    columns = ("rid", "source", "doc_id", "text_hash", "size", "source_size", "target")
    copies = picked.join(table, picked["source"].eqNullSafe(F.col("p_source"))).select(*columns, (F.floor("ratio") + F.col("chance")).cast("long").alias("copies"))
    certain = units.filter(~((F.col("chance") > EPSILON) & (F.col("chance") < 1 - EPSILON) & (F.col("size") > 0)))
    return copies.unionAll(certain.select(*columns, F.when(F.col("size") > 0, F.round("ratio")).otherwise(0).cast("long").alias("copies")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
