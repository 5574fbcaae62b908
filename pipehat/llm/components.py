"""Connected components by alternating large-star and small-star steps.

Every step is a group-by and a join on edges, until the edges are stars; nothing is collected but two numbers.
Group-bys aggregate before they shuffle; the edges of a hot vertex are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipehat.llm.arrow import settle
from pipehat.llm.hot import dealt_join, hot_values
from pipehat.runtime import remove, written


def _beside_least(edges: DataFrame, rows: int, paths: list[str]) -> DataFrame:
    """Edges (a, b), so many rows at most, with m, the least b of their a. Written tables go to paths."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least", rows)
    paths.append(least.path)
    total = least.agg(F.sum("n")).first()[0] or 0
    return dealt_join(edges, least.select("a", "m"), "a", hot_values(least.select("a", "n"), "a", total), "b")


def _stars(edges: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b, so many rows; neither step makes more."""
    paths: list[str] = []
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _beside_least(both, 2 * rows, paths).select("a", "b", F.least("a", "m").alias("m")).where("b > a")
    large = written(near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "large", rows)
    paths.append(large.path)
    near = _beside_least(large, rows, paths)
    moved = near.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = written(moved.unionAll(near.where("b = m").select("a", "b")).distinct(), "edges", rows)
    remove(edges.sparkSession, *paths)
    return out


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges; whether every edge leads to a vertex without one of its own, and no vertex has two: then each star is a
    component."""
    n, vertices = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    return n, n == vertices and edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi").isEmpty()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component. Nodes without an edge aren't
    returned; empty edges give an empty table; loops and repeated or reversed edges change nothing. `.path` is the table it
    reads. rows: how many edges there are at most, if that is known."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    while not (shape := _shape(now))[1]:
        then = _stars(now, shape[0])
        remove(edges.sparkSession, now.path)
        settle(edges.sparkSession)
        now = then
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select("b", "b").distinct().toDF("node", "root"))
    out.path = now.path
    return out
