"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round points the neighbours of a vertex to the smallest vertex among them; edges only ever
shrink towards stars. Minima are aggregated before they are shuffled and joined back, so a vertex
that a third of all edges share is never gathered in one place. Rounds are cut by tables in the
shared folder; the driver sees one checksum for each.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genopair.llm.common import Scratch


def _round(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """``edges`` (u > v). Large: neighbours greater than u meet the smallest neighbour of u; small: the others."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table of its own, so that Spark can split the join on a vertex that many edges share.
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """vertex and component, its smallest vertex, for every vertex that has an edge to another.

    ``edges`` has two columns of ids, in any order and direction; rows with a null and loops are ignored.
    """
    a, b = (F.col(f"`{c}`").cast("bigint") for c in edges.columns[:2])
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a.isNull().alias("x"), b.isNull().alias("y"))
    edges = scratch.write(edges.where("NOT x AND NOT y AND u > v").select("u", "v").distinct(), "edges")
    check = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
    before = check(edges)
    while True:
        after = scratch.write(_round(_round(edges, True, scratch), False, scratch), "stars")
        scratch.drop(edges)
        edges, now = after, check(after)
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct())
