"""Lineages are walked by shuffles: no round passes a table through the driver."""

from pyspark.sql import functions as F

from plinth.operators import graphs
from plinth.plans import joins


def test_rounds_broadcast_nothing(spark, monkeypatch):
    plans, write = [], graphs.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(graphs, "materialize", noted)
    nodes = spark.createDataFrame([(i, i // 2 if i > 1 else None, i % 5) for i in range(1, 60)], "id long, parent long, version long")
    got = {(r["start"], r["id"], r["depth"]) for r in graphs.ancestors(nodes, "id", "parent", F.lit(True)).collect()}
    assert got == {(i, i >> k, k) for i in range(1, 60) for k in range(i.bit_length())}
    best = joins._best_in_lineage(nodes, F.lit(True))
    assert {(r["start"], r["id"]) for r in best.collect()} == {(i, min((i >> k for k in range(i.bit_length())), key=lambda x: (x % 5 % 2, -(x % 5), x))) for i in range(1, 60)}
    plans.append(best._jdf.queryExecution().executedPlan().toString())
    assert not any("Broadcast" in p for p in plans)
