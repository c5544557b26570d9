"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hdulake.llm._common import checkpointed


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """u, v and m: the least of u and all its v. The minimum is aggregated before it is joined back."""
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the least of u's neighbourhood."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link u and every smaller neighbour of u to the least of them. Each edge has u > v."""
    seen = _least_neighbour(edges)
    moved = seen.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(seen.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``id`` and ``component`` (the least id of its component) for each id of the edges u, v.

    Self-links and repeated edges are harmless. Each round is checkpointed. The edges are stars around
    their least ids once a round changes nothing, which a count and a sum of hashes show.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = checkpointed(edges)
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        edges = checkpointed(small_star(large_star(edges)))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
