"""Graph operators as joins and aggregations over edge tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.storage import written


def _lower(edges: DataFrame) -> DataFrame:
    """Each undirected edge once as (u, v) with v < u; loops go."""
    return edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionAll(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root"))
    )
    odd = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return odd.where("child > 1 OR (child > 0 AND root > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: (node, root), root the smallest node id.

    Alternates large-star and small-star steps, each of which emits at most one
    row per edge, until the edges form stars; only a flag reaches the driver.
    Rows with a null end are dropped. Each round is written to the shared folder.
    Joins are merge joins: a side of a few MB is below the threshold of a broadcast, and
    many times that in the driver, which holds those of several rounds.
    """
    now = written(_lower(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna()), "edges")
    for _ in range(max_rounds):
        if _is_star(now):
            break
        now = written(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def pagerank(edges: DataFrame, reset: float = 0.15, rounds: int = 10, every: int = 5) -> DataFrame:
    """(id, rank) after ``rounds`` iterations over edges (src, dst), ranks starting at 1.

    Nodes without out-edges give nothing on. Lineage is cut every few rounds; the
    edges are dealt by source once a cut, and ranks are summed before they move.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    links = written(edges.join(out, "src"), "links")
    nodes = written(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "nodes")
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for k in range(rounds):
        sent = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        ranks = nodes.join(sent, nodes["id"] == sent["dst"], "left").select("id", (reset + (1 - reset) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % every == every - 1:
            ranks = written(ranks, "ranks")
    return ranks


def shortest_paths(edges: DataFrame, landmark: int) -> DataFrame:
    """(id, hops) of every node that reaches ``landmark`` along edges (src, dst), by breadth-first rounds until nothing is new."""
    links = written(edges.select("src", "dst").distinct(), "links")
    found = written(links.sparkSession.range(1).select(F.lit(landmark).cast("long").alias("id"), F.lit(0).alias("hops")), "found")
    edge = found
    for k in count(1):
        near = links.join(edge, links["dst"] == edge["id"], "left_semi").select(F.col("src").alias("id")).distinct()
        new = written(near.join(found, "id", "left_anti").withColumn("hops", F.lit(k)), "frontier")
        if new.isEmpty():
            break
        found, edge = written(found.unionAll(new), "found"), new
    return found


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles) of an undirected graph: edges point from the smaller degree to the larger, so hubs list few pairs."""
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = both.select(F.col("a").alias("n")).unionAll(both.select("b")).groupBy("n").agg(F.count("*").alias("d"))
    ranked = both.join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    arcs = written(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")), "arcs")
    x, y = arcs.select("u", F.col("v").alias("p")), arcs.select("u", F.col("v").alias("q"))
    wedges = x.join(y, "u").where("p < q")
    closed = both.select(F.col("a").alias("p"), F.col("b").alias("q"))
    found = wedges.join(closed, ["p", "q"]).select(F.explode(F.array("u", "p", "q")).alias("id"))
    return found.groupBy("id").agg(F.count("*").alias("triangles"))
