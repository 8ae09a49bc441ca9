"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.llm.common import Scratch, shared_path, written


def components(edges: DataFrame, path: str | None = None) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``u, v``, any comparable type); the root is the component's least node. Kept at ``path``.

    Each round joins edges with their ends' least neighbours. Those are summed before their shuffle and written before the
    join, and so are a round's edges: a join is a stage of its own, in which a node of very many edges is dealt out. Rounds are
    about the logarithm of the longest shortest path. Loops, repeated edges and no edges are allowed.
    """
    u, v = F.col("u"), F.col("v")
    spark = edges.sparkSession
    old, new = Scratch(spark), Scratch(spark)
    with old, new:
        state = old.keep(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
        told = None
        while True:
            both = state.unionByName(state.select(v.alias("u"), u.alias("v")))
            least = old.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
            large = old.keep(both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct(), "large")
            least = old.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            state = new.keep(small.where(u != v).distinct(), "edges")
            now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            old.drop()
            old, new = new, old
            if now == told:
                break
            told = now
        found = state.select(u.alias("node"), v.alias("root")).unionByName(state.select(v.alias("node"), v.alias("root")).distinct())
        return written(found, path or shared_path(spark, "components"))
