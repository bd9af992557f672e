"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import join_spread, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links` (long columns): the smallest node it reaches.

    Alternating large-star and small-star: each node's neighbours are told the smallest of
    them, until nothing changes; a round shortens paths by about half. Groups are only
    aggregated (min), never gathered, and the links of a node that has very many are dealt to
    many tasks to be told; each round
    is a table in the shared folder, which cuts lineage and survives lost executors. Null
    ends and loops are left out; no links give no rows.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        # large star: the larger neighbours of u are linked to the smallest node of u's star
        large = join_spread(both.where(F.col("v") > F.col("u")), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of these
        large = written(large)
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = join_spread(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now.n:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """`members` (node, component, as connected_components has it) after more links (a, b).

    Only components are linked, so that the rounds cost what the new links do, not the old
    ones. Ends that are in no component are components of themselves. A component's name stays
    its smallest node, and the rows of one that holds very many nodes are dealt to many tasks.
    """
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = written(ends.join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    between = links.join(known.select(F.col("node").alias("a"), F.col("component").alias("from")), "a").join(known.select(F.col("node").alias("b"), F.col("component").alias("to")), "b")
    tops = connected_components(between.select(F.col("from").alias("a"), F.col("to").alias("b")).distinct()).select(F.col("node").alias("component"), F.col("component").alias("top"))
    everyone = written(members.unionByName(known.join(members, "node", "left_anti")))
    sizes = everyone.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    named = written(sizes.join(tops, "component", "left").select("component", F.coalesce("top", "component").alias("top"), "n"))
    return join_spread(everyone, named, "component").select("node", F.col("top").alias("component"))
