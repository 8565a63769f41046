"""Queries over whole tables have a row, or a place, for every row of their table."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plinth.operators.relational import placed
from plinth.plans import catalog

DATA = "/root/testdata/sf0.001"


def run(spark, name):
    return catalog.QUERIES[name](spark, DATA).collect()


def size(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").count()


@pytest.mark.parametrize("name", ["w15_running_precision", "w16_precision_envelope", "f21_pricing", "f49_alignment_confidence"])
def test_every_line_item_counts(spark, name):
    assert len(run(spark, name)) == size(spark, "lineitem")


def test_no_served_type_is_called_unserved(spark):
    every, served = {"click", "error", "purchase", "signup", "view"}, defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_type").collect():
        served[r["user_id"]].add(r["event_type"])
    wanted = {user: "[" + ", ".join(sorted(every - types)) + "]" for user, types in served.items()}
    assert {r["user_id"]: r["unserved"] for r in run(spark, "u05_set_difference")} == wanted


def test_every_part_starts_a_lineage(spark):
    rows = run(spark, "u06_recursive_ancestors")
    ids = range(size(spark, "part"))
    assert sorted((r["start"], r["id"], r["depth"]) for r in rows) == sorted((i, i >> k, k) for i in ids for k in range(max(1, i.bit_length())))
    assert len(run(spark, "u07_best_in_lineage")) == len(ids)


def test_the_graph_has_an_edge_of_every_row(spark):
    n = size(spark, "embeddings")
    assert len(run(spark, "r04_bidirectional")) == 2 * n
    distance, at = {1: 0.0}, 1
    while (to := at * 2 % n) not in distance:
        distance[to] = distance[at] + 1.0 + at % 7
        at = to
    assert {r["id"]: r["distance"] for r in run(spark, "r06_shortest_paths")} == distance
    seen, at = set(), 3
    while at not in seen:
        seen.add(at)
        at = at * 2 % n
    assert {r["id"] for r in run(spark, "r13_reachability")} == seen


@pytest.mark.parametrize(("name", "rows"), [("k02_ranking_order", "part"), ("k06_tier_order", "orders"), ("p08_boolean_sort_key", "part")])
def test_every_row_has_a_place(spark, name, rows):
    assert sorted(r["place"] for r in run(spark, name)) == list(range(1, size(spark, rows) + 1))


def test_later_tiers_and_nulls_have_places(spark):
    assert {r["tier"] for r in run(spark, "k06_tier_order")} == {0, 1, 2}
    rows = [(i, None if i % 5 == 0 else i * 37 % 101) for i in range(1000)]
    got = placed(spark.createDataFrame(rows, "id long, v long").repartition(7), [F.col("v").desc_nulls_last(), F.col("id")]).collect()
    wanted = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [tuple(r)[:2] for r in sorted(got, key=lambda r: r["place"])] == wanted
    assert placed(spark.createDataFrame([], "id long"), [F.col("id")]).count() == 0
