"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.storage import discard, durable


def _directed(edges: DataFrame) -> DataFrame:
    """Edges from the larger node to the smaller, once each, without loops."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _directed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _directed(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node that it reaches) for all nodes of ``edges``.

    Nodes may be of any ordered type. Edges with a null end are ignored; loops
    and repeated edges do no harm. Rounds end when the stars no longer change.
    """
    nodes = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    loops = nodes.where("a = b").select("a").distinct()
    stars = durable(_directed(nodes), "stars")
    mark = _mark(stars)
    for _ in range(max_rounds):
        stars, old = durable(_small_star(_large_star(stars)), "stars"), stars
        discard(old)
        mark, before = _mark(stars), mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = leaves.unionByName(roots)
    alone = loops.select(F.col("a").alias("node")).join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
