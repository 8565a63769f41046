"""Recursion, closures and components as joins over edge tables. Loops cut lineage by writing to the shared folder each round."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

def materialize(df: DataFrame) -> DataFrame:
    """Writes df below spark.checkpoint.dir and reads it back: later rounds neither recompute it nor depend on an executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ancestors(nodes: DataFrame, key: str, parent: str, is_start: Column, most: int = 1000) -> DataFrame:
    """(start, id, depth): every start node and all its ancestors. Parents are unique, so a round is one join, by shuffle: a broadcast each round would pass the table through the driver again and again. A cycle ends at `most` rounds."""
    tree = materialize(nodes.select(F.col(key).alias("id"), F.col(parent).alias("up")))
    front = nodes.where(is_start).select(F.col(key).alias("start"), F.col(key).alias("id"), F.col(parent).alias("up"))
    found = []
    for depth in range(most):
        front = materialize(front)
        found.append(front.select("start", "id", F.lit(depth).alias("depth")))
        step = front.where("up IS NOT NULL")
        if step.isEmpty():
            out = found[0]
            for x in found[1:]:
                out = out.union(x)
            return out
        front = step.select("start", F.col("up").alias("id")).join(tree.hint("merge"), "id").select("start", "id", "up")
    raise RuntimeError(f"a lineage is longer than {most}")


def closure(start: DataFrame, rules: Sequence[Callable[[DataFrame], DataFrame]], rounds: int = 1000) -> DataFrame:
    """The least set of rows that holds start and all that the rules derive from it; each round applies them to the newest rows alone."""
    known = new = materialize(start.distinct())
    for _ in range(rounds):
        derived = rules[0](new)
        for rule in rules[1:]:
            derived = derived.unionByName(rule(new))
        new = materialize(derived.distinct().join(known, known.columns, "left_anti"))
        if new.isEmpty():
            return known
        known = materialize(known.unionByName(new))
    raise RuntimeError(f"no fixed point in {rounds} rounds")


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Bidirectional expansion: every edge and its reverse."""
    return edges.unionByName(edges.withColumns({a: F.col(b), b: F.col(a)}))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id each node is connected to. nodes: id; edges: a, b. Each round points nodes to their smallest neighbour, jumps along the pointers and contracts the edges, so settled parts leave the edge table."""
    edges = materialize(edges.where("a <> b").select("a", "b").distinct())
    labels = materialize(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in range(rounds):
        if edges.isEmpty():
            return labels
        near = both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
        up = materialize(near.select("id", F.least("id", "near").alias("up")))
        for _ in range(2):
            up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        up = materialize(up)
        labels = materialize(labels.join(up.toDF("component", "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component")))
        ends = edges.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").where("x <> y")
        edges = materialize(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def clusters(nodes: DataFrame, edges: DataFrame, most: int, rounds: int = 100) -> DataFrame:
    """(id, cluster): nodes (id) that edges (a, b) bring together, at most `most` to a cluster. Rounds contract the edges as in components(); what a round would make too large stays as it was and leaves the edge table. Ids should be hashes: along a chain in the order of its ids, a round would gather little."""
    edges = materialize(edges.where("a <> b").select("a", "b").distinct())
    labels = materialize(nodes.select("id", F.col("id").alias("cluster")).distinct())
    for _ in range(rounds):
        if edges.isEmpty():
            return labels
        up = materialize(both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("up")))
        for _ in range(2):
            up = up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up"))
        up = materialize(up)
        labels = materialize(labels.join(up.toDF("cluster", "up"), "cluster", "left").select("id", "cluster", F.coalesce("up", "cluster").alias("up")))
        large = materialize(labels.groupBy("up").agg(F.count("*").alias("n")).where(F.col("n") > most).select("up", F.lit(True).alias("large")))
        labels = materialize(labels.join(large, "up", "left").select("id", F.when(F.col("large"), F.col("cluster")).otherwise(F.col("up")).alias("cluster")))
        ends = edges.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        for end in "ab":
            ends = ends.join(large.select(F.col("up").alias(end)), end, "left_anti")
        edges = materialize(ends.select("a", "b"))
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")


def mutual_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): nodes that reach each other share the smallest such id. For small graphs (floors of a building): the closure holds a row per reachable pair."""
    pairs = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    edges = materialize(edges.select("a", "b").distinct())
    step = lambda new: new.alias("n").join(edges.alias("e"), F.col("n.b") == F.col("e.a")).select(F.col("n.a").alias("a"), F.col("e.b").alias("b"))
    reach = closure(pairs, [step])
    back = reach.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return reach.join(back, ["a", "b"], "left_semi").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
