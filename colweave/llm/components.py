"""Connected components of a table of links, all work in joins and minima.

Each round every node takes its smallest neighbour as parent if that is smaller, parents are followed to the roots of the trees so
made (paths halve with each step), and the links are rewritten to the roots and made distinct. A root is smaller than all its
neighbours, so at most half of a component's nodes are left, and rounds grow with the logarithm of its size. Every round is written to the shared folder, which cuts the lineage and
lets a lost executor be replaced. No list of neighbours is ever gathered; a hub only meets as the many-sided end of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for each end of a link (``a``, ``b``); the root is the smallest node of the component."""
    edges = written(_both_ways(links), "cc-edges")
    roots = None
    while edges.limit(1).count():
        parents = written(
            edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("up")), "cc-parents"
        )
        moving = True
        while moving:  # up to the root of each tree; the length of the path to it halves
            over = parents.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            parents = written(
                parents.join(over, "up").select("node", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")), "cc-jumped"
            )
            moving = parents.where("moved").limit(1).count() > 0
            parents = parents.drop("moved")
        if roots is None:
            roots = parents.withColumnRenamed("up", "root")
        else:
            moved = parents.withColumnRenamed("node", "root")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        roots = written(roots, "cc-roots")
        ends = edges.where("u < v")
        for end in ("u", "v"):
            up = parents.select(F.col("node").alias(end), F.col("up").alias(f"{end}_up"))
            ends = ends.join(up, end).drop(end).withColumnRenamed(f"{end}_up", end)
        edges = written(_both_ways(ends.select(F.col("u").alias("a"), F.col("v").alias("b"))), "cc-edges")
    return roots if roots is not None else links.sparkSession.createDataFrame([], "node long, root long")


def _both_ways(links: DataFrame) -> DataFrame:
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ordered.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
