"""Graphs as tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut


def components(edges: DataFrame, src: str, dst: str, most_rounds: int = 60) -> DataFrame:
    """``id, component`` of every node of an edge: the smallest id that undirected edges lead to.

    Rounds of two star steps: every node ties its larger neighbours, then its
    smaller ones, to the smallest neighbour there is, until nothing changes;
    about as many rounds as the logarithm of the longest path. Each round is
    written to the shared folder. Loops, repeated edges and either direction are
    harmless; edges with a null end are left out; no edges give no rows. A graph
    that has not settled after ``most_rounds`` is an error.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select("u").distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(smallest, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("id"), F.col("u").alias("component")).join(stars.select("id"), "id", "left_anti")
    return stars.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).unionByName(alone).distinct()


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``id, outlinks, inlinks`` of every node of a distinct edge; loops count for both."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("o").alias("outlinks"), F.sum("i").alias("inlinks"))


def reachable(edges: DataFrame, src: str, dst: str, starts: DataFrame, hops: int) -> DataFrame:
    """``id, hops`` of every node that edges lead to from ``starts`` (``id``) in at most ``hops`` steps, with the fewest; starts have 0."""
    e = edges.select(F.col(src).alias("id"), F.col(dst).alias("to")).where("id is not null and to is not null").distinct()
    seen = starts.select("id").where("id is not null").distinct().withColumn("hops", F.lit(0).cast("long"))
    front = seen
    for h in range(1, hops + 1):
        front = front.select("id").join(e, "id").select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(h).cast("long"))
        seen = seen.unionByName(front)
    return seen


def roots(parents: DataFrame, node: str, parent: str, depth: int = 8) -> DataFrame:
    """``id, root, hops``: following parents that are nodes themselves, at most ``depth`` of them. Pointers double each round; a cycle ends after ``depth`` steps."""
    p = parents.select(F.col(node).alias("id"), F.col(parent).alias("up")).where("id is not null").dropDuplicates(["id"])
    known = p.select(F.col("id").alias("up"))
    jump = p.join(known, "up", "left_semi").where("up <> id").select("id", "up", F.lit(1).cast("long").alias("k"))
    full = p.select("id").join(jump, "id", "left").select("id", F.coalesce("up", "id").alias("root"), F.coalesce("k", F.lit(0).cast("long")).alias("hops"))
    step = 1
    while step < depth:
        nxt = full.select(F.col("id").alias("root"), F.col("root").alias("root2"), F.col("hops").alias("more"))
        full = full.join(nxt, "root").select("id", F.col("root2").alias("root"), (F.col("hops") + F.col("more")).alias("hops"))
        step *= 2
    return full
