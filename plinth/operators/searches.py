"""Shortest paths and reachability over graphs of any size, one way for all of them.

Nodes are numbered in the order of their ids and dealt into blocks of about BLOCK_NODES; a block has the edges that leave its nodes. A search
settles a block in one task, best first, and sends what leaves the block as messages to the blocks it leads to; only
blocks with messages go on. So a graph of one block takes one round, and a large one as many rounds as its shortest paths cross from block to block. Where the order of
the ids leaves more than a tenth of the edges between blocks, connected nodes are gathered first and numbered cluster by cluster; the result is the same. Several searches and graphs go side by side.

Edges whose ends or lengths are null or NaN take no part. Negative lengths raise an error. Of equal distances the smaller predecessor is kept; a step of length 0 is only kept where it makes a way shorter, so predecessors have no cycles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graphs import clusters, materialize
from .relational import placed

BLOCK_NODES = 50_000
#: The share of edges between blocks from which nodes are gathered.
CROSSING = 0.1
#: Requests of one search that a task walks back, while the search has fewer tasks than MOST_PARTS; a task reads all that its search found.
REQUESTS, MOST_PARTS = 2_000, 64
#: Paths that a task gives to Spark at a time.
PATHS = 1_000


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a frame can meet another that it shares a source with."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def searches(edges: DataFrame, sources: DataFrame, block_nodes: int = BLOCK_NODES, rounds: int = 10_000) -> DataFrame:
    """(search, graph, id, distance, previous) of every node that a search reaches. edges: graph, a, b, length; sources: search, graph, id, one or several of a search, with distance 0 and no predecessor."""
    clean = materialize(edges.select("graph", "a", "b", F.col("length").cast("double").alias("length")).where("graph IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND length IS NOT NULL AND NOT isnan(length)"))
    if clean.where("length < 0").limit(1).count():
        raise ValueError("lengths must not be negative")
    kind = {c: t.dataType.simpleString() for c, t in zip(("id", "graph", "search"), (clean.schema["a"], clean.schema["graph"], sources.schema["search"]), strict=True)}
    starts = sources.where("id IS NOT NULL").select("search", F.col("graph").cast(kind["graph"]).alias("graph"), F.col("id").cast(kind["id"]).alias("id")).distinct()
    nodes = clean.select("graph", F.col("a").alias("id")).unionByName(clean.select("graph", F.col("b").alias("id"))).unionByName(starts.select("graph", "id")).distinct()

    def dealt_by(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
        nodes = materialize(placed(nodes, [F.col(c) for c in order]).select("graph", "id", F.floor((F.col("place") - 1) / block_nodes).alias("block")))
        dealt = clean.join(nodes.select("graph", F.col("id").alias("a"), "block"), ["graph", "a"]).join(nodes.select("graph", F.col("id").alias("b"), F.col("block").alias("to")), ["graph", "b"])
        return nodes, materialize(dealt.select("graph", "block", "a", "b", "to", "length"))

    nodes, dealt = dealt_by(nodes, ["graph", "id"])
    crossing = dealt.agg(F.count("*").alias("n"), F.count_if(F.col("block") != F.col("to")).alias("over")).first()
    if crossing["over"] > CROSSING * crossing["n"]:
        key = lambda c: F.xxhash64("graph", c)  # noqa: E731  (one hash for two nodes only puts them side by side)
        near = clusters(nodes.select(key("id").alias("id")), clean.select(key("a").alias("a"), key("b").alias("b")), block_nodes)
        gathered = _renewed(nodes).withColumn("key", key("id")).join(near.withColumnRenamed("id", "key"), "key").select("graph", "cluster", "id")
        nodes, dealt = dealt_by(gathered, ["graph", "cluster", "id"])

    columns = ["search", "graph", "block", "id", "distance", "previous", "sent"]
    schema = f"search {kind['search']}, graph {kind['graph']}, block long, id {kind['id']}, distance double, previous {kind['id']}, sent boolean"

    def settle(key: tuple, known: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        """One block of one search: known are its nodes with their distances so far, and what has been sent to it. A source is its own predecessor here: pandas makes floats of whole numbers beside nulls, which hold no more than 53 bits of an id."""
        search, graph, block = key
        ahead: dict = {}
        for a, b, to, length in zip(*(edges[c].tolist() for c in ("a", "b", "to", "length")), strict=True):
            ahead.setdefault(a, []).append((length, to, b))
        best: dict = {}
        heap: list = []
        sent = known["sent"].tolist()
        rows = sorted(zip(sent, known["id"].tolist(), known["distance"].tolist(), known["previous"].tolist(), strict=True), key=lambda r: r[0])
        for new, node, distance, previous in rows:
            previous = None if previous == node else previous
            old = best.get(node)
            if old is None or distance < old[0] or (distance == old[0] and previous is not None and old[1] is not None and previous < old[1]):
                best[node] = (distance, previous)
                if new and (old is None or distance < old[0]):
                    heapq.heappush(heap, (distance, node))
        out: dict = {}
        while heap:
            distance, node = heapq.heappop(heap)
            if distance > best[node][0]:
                continue
            for length, to, b in ahead.get(node, ()):
                there = distance + length
                held = best if to == block else out
                at = b if to == block else (to, b)
                old = held.get(at)
                if old is None or there < old[0] or (there == old[0] and length > 0 and old[1] is not None and node < old[1]):
                    held[at] = (there, node)
                    if held is best and (old is None or there < old[0]):
                        heapq.heappush(heap, (there, b))
        rows = [(search, graph, block, i, d, i if p is None else p, False) for i, (d, p) in best.items()] + [(search, graph, to, i, d, p, True) for (to, i), (d, p) in out.items()]
        return pd.DataFrame(rows, columns=columns)

    messages = materialize(starts.join(nodes, ["graph", "id"]).select("search", "graph", "block", "id", F.lit(0.0).alias("distance"), F.lit(None).cast(kind["id"]).alias("previous"), F.lit(True).alias("sent")))
    state = messages.where("false")
    by = ["search", "graph", "block"]
    for _ in range(rounds):
        active = messages.select(*by).distinct()
        here = state.join(active, by, "left_semi").unionByName(messages).withColumn("previous", F.coalesce("previous", "id"))
        asked = _renewed(dealt.join(active, ["graph", "block"]))
        made = materialize(here.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(settle, schema).withColumn("previous", F.nullif("previous", "id")))
        state = materialize(state.join(active, by, "left_anti").unionByName(made.where("NOT sent")))
        found = made.where("sent").groupBy(*by, "id").agg(F.min(F.struct("distance", "previous")).alias("n")).select(*by, "id", "n.distance", "n.previous", F.lit(True).alias("sent"))
        old = state.select("search", "graph", "id", F.struct("distance", "previous").alias("old"))
        messages = materialize(found.join(old, ["search", "graph", "id"], "left").where("old IS NULL OR distance < old.distance OR (distance = old.distance AND previous < old.previous)").drop("old"))
        if messages.isEmpty():
            return state.select("search", "graph", "id", "distance", "previous")
    raise RuntimeError(f"paths did not settle in {rounds} rounds")


def shortest_paths(edges: DataFrame, source: object, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(id, distance, previous) from one source over the edges (a, b, length) of one graph."""
    kind = edges.schema["a"].dataType.simpleString()
    start = edges.sparkSession.createDataFrame([(source,)], f"id {kind}").select(F.lit(0).alias("search"), F.lit(0).alias("graph"), "id")
    return searches(edges.select(F.lit(0).alias("graph"), "a", "b", "length"), start, block_nodes).select("id", "distance", "previous")


def reachable(edges: DataFrame, start: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Nodes (id) that are reached from start (id) along edges (a, b), cycles included."""
    starts = start.select(F.lit(0).alias("search"), F.lit(0).alias("graph"), "id")
    return searches(edges.select(F.lit(0).alias("graph"), "a", "b", F.lit(0.0).alias("length")), starts, block_nodes).select("id")


def paths(found: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (search, request, target) with cost and path (node ids from the source to the target) by what searches() found; nulls for targets that are not reached. The requests of a search are dealt over up to MOST_PARTS tasks, each with the predecessors of that search."""
    kind, node = asked.schema["request"].dataType.simpleString(), found.schema["id"].dataType.simpleString()
    schema = f"request {kind}, cost double, path array<{node}>"
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    asked = _renewed(asked).withColumn("target", F.col("target").cast(node))
    parts = asked.groupBy("search").agg(F.least(F.lit(MOST_PARTS), F.ceil(F.count("*") / REQUESTS)).cast("int").alias("parts"))
    dealt = asked.join(_renewed(parts), "search", "left").withColumn("part", F.pmod(F.xxhash64("request"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = found.select("search", "id", "distance", "previous").join(parts, "search").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def walk(key: tuple, found: pa.Table, asked: pa.Table) -> pa.Table:
        ids = found["id"].combine_chunks()
        places = lambda c: pc.fill_null(pc.index_in(c.combine_chunks(), value_set=ids, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        before, targets = places(found["previous"]), places(asked["target"])

        def back() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """A step at a time, the requests that are still on their way and the nodes they are at."""
            rows = np.flatnonzero(targets >= 0)
            at = targets[rows]
            while len(rows):
                yield rows, at
                at = before[at]
                rows, at = rows[at >= 0], at[at >= 0]

        nodes = np.zeros(len(targets), np.int64)
        for k, (rows, _) in enumerate(back()):
            if k == found.num_rows:
                raise ValueError(f"search {key[0]}: predecessors run in a circle")
            nodes[rows] += 1
        ends = np.cumsum(nodes)
        ways = np.empty(int(nodes.sum()), np.int32)
        for k, (rows, at) in enumerate(back()):
            ways[ends[rows] - 1 - k] = at
        path = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), ids.take(pa.array(ways)), mask=pa.array(nodes == 0))
        cost = found["distance"].combine_chunks().take(pa.array(targets, mask=targets < 0))
        out = pa.table([asked["request"].combine_chunks(), cost, path], names=kinds.names).cast(kinds)
        return pa.concat_tables([out.slice(k, PATHS) for k in range(0, max(1, len(targets)), PATHS)])

    by = ["search", "part"]
    return copies.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(walk, schema)
