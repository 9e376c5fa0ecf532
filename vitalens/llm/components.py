"""Connected components of a table of links, by rounds of star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import saved, sorted_join


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node of it.

    Each round points every node at the smallest node it can see, first along larger and
    then along smaller neighbours, which turns the links into stars.  A node of many
    links is reduced by partial aggregates; its links are split by adaptive joins.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(sorted_join(lowest), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sorted_join(lowest), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = saved(small.select("e.u", "e.v").where("u != v").distinct())
        # Stars: no node is both a centre and a leaf.
        if after.select(F.col("v").alias("u")).join(sorted_join(after), "u", "left_semi").isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty():
            break
        edges = after
    centres = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return saved(after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres))
