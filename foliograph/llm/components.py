"""Connected components of links by alternating large and small stars, in DataFrame operations.

No node's neighbours are ever gathered in one row or task: a node's least neighbour is an aggregate, pre-aggregated where
the links lie. It is written before it goes back to the links by a join, because only then are both sides of the join
exchanges of their own, which adaptive execution may split where one node has a large part of all links. Every round is a
few tables in the shared folder.

Defined results: links with a null end are left out; repeated links and links of a node to itself change nothing; no links
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair of a written table with the least of u and its neighbours."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    s = _star(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return s.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b, of one orderable type); the root is the least node reachable."""
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")
    before = now.agg(F.count("*"), mark).first()
    while before[0]:
        now = written(_small(written(_large(now), "large-star")), "links")
        after = now.agg(F.count("*"), mark).first()
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select("b").distinct().select("b", F.col("b").alias("r")))
