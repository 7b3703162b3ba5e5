"""Connected components by alternating large and small stars, with DataFrame joins only.

Each round lets every node point its neighbours at the smallest node it knows. Edges never grow in number,
rounds grow with the logarithm of the longest chain, and a node with very many neighbours costs one
combined row before the shuffle and a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, fixed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("least"))
    larger = both.where(F.col("dst") > F.col("src")).join(least, "src")
    return larger.select(F.col("dst").alias("src"), F.least("least", "src").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    others = down.join(least, "src").where(F.col("dst") != F.col("least"))
    moved = others.select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.withColumnRenamed("least", "dst")).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has either one smaller neighbour or none but larger ones; then no round changes anything."""
    up, down = F.lit(1).alias("up"), F.lit(0).alias("up")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), up), F.struct(F.col("dst").alias("node"), down))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.min("end.up").alias("least"))
    return not nodes.where("ups > 1 or (ups = 1 and least = 0)").head(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (src, dst; any order, one type).

    Loops and edges with a null end are ignored; nodes without any other edge do not come out.
    """
    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    edges = fixed(edges.distinct(), "edges")
    while not _all_stars(edges):
        edges, older = fixed(_small_star(_large_star(edges)), "edges"), edges
        discard(older)
    stars = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
