"""Connected components of edge tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vitalgrid.llm.common import cut_lineage, discard


def _star(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    seen = Observation()
    mark = F.xxhash64("a", "b").cast("decimal(20,0)")
    written = cut_lineage(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(mark).alias("marks")), name)
    return written, (seen.get["n"], seen.get["marks"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node that the edges (a, b) lead to; nodes without edges are missing.

    A step moves each node's larger neighbours, then its smaller ones, to the smallest neighbour. Minima are pre-aggregated,
    and the join that hands them back is one that Spark can split, so a node with very many neighbours is no bottleneck.
    Of equal edges one is kept after both. It ends once the first move changes nothing, which means that all smaller ends are
    roots, and each larger end comes once.
    """
    kept, mark = _star(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while mark[0]:
        both = kept.select("a", "b").union(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, new = _star(large.where("a <> b"), "large-star")
        if new == mark and kept.select("a").distinct().count() == mark[0]:
            discard(large)
            break
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved, new = _star(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        discard(kept, large)
        kept, same, mark = moved, new == mark, new
        if same:
            break
    return kept.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        kept.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
