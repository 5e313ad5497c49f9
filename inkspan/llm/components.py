"""Connected components over an edge table, by alternating large-star and small-star rounds.

Every step is a combinable aggregate or a shuffled join, so a vertex with very many neighbours is
never gathered in one place: its minimum is pre-aggregated and its edges stay split across tasks
(adaptive skew handling splits the join when one vertex holds a large share of the edges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import cut, drop_cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex that occurs in ``edges``; component is its smallest reachable id.

    Edges are undirected. Self loops keep a vertex in the result; edges with a null end are ignored;
    repeated edges count once. An empty table gives an empty result.
    """
    a, b = F.col(f"`{src}`"), F.col(f"`{dst}`")
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNotNull() & b.isNotNull()).alias("ok"))
    start = cut(start.filter("ok").select("u", "v").distinct(), "edges")
    vertices = start.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    links = start.filter("u != v")
    told = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark, made = told(links), False
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(floor.select("u", F.col("m").alias("v"))).distinct(), "stars")
        got = told(new)
        if made:
            drop_cut(links)
        links, made = new, True
        if got == mark:
            break
        mark = got
    return vertices.join(links.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
