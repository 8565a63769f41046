"""Average precision and retrieval metrics: several range-sorted parts a class, against a plain loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plinth.operators import evaluation as E

def order():
    return [F.col("score").desc(), F.col("id")]


def plain(rows, k):
    out = {}
    for key in {r[0] for r in rows}:
        hits = [bool(h) for _, _, _, h in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], r[1]))]
        tp = [sum(hits[: i + 1]) for i in range(len(hits))]
        precision = [t / (i + 1) for i, t in enumerate(tp)]
        total = tp[-1]
        ap = sum(max(precision[i:]) for i, h in enumerate(hits) if h) / total if total else None
        out[key] = ap, (sum(hits[:k]) / total, sum(hits[:k]) / k, sum(p for p, h in zip(precision, hits, strict=True) if h) / total) if total else None
    return out


def test_parts_equal_a_plain_loop(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, float(rng.randrange(40)), rng.choice([True, False, False, None])) for i in range(900)] + [("none", 1000 + i, 1.0, False) for i in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a class has several parts
    try:
        frame = spark.createDataFrame(rows, "key string, id long, score double, hit boolean").repartition(5)
        wanted = plain(rows, 10)
        got = {r["key"]: r["ap"] for r in E.average_precision(frame, ["key"], order(), "hit").collect()}
        assert got == {key: v[0] if v[0] is None else pytest.approx(v[0], abs=1e-12) for key, v in wanted.items()}
        found = {r["key"]: (r["recall_at_10"], r["precision_at_10"], r["ap"]) for r in E.retrieval_metrics(frame, ["key"], order(), "hit", 10).collect()}
        assert found == {key: pytest.approx(v[1], abs=1e-12) for key, v in wanted.items() if v[1]}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_class_of_many_rows_takes_no_quadratic_time(spark):
    n = 400_000
    frame = spark.range(n).select(F.lit(1).alias("key"), "id", (F.hash("id") % 1000).cast("double").alias("score"), (F.col("id") % 3 == 0).alias("hit"))
    start = time.monotonic()
    assert 0 < E.average_precision(frame, ["key"], order(), "hit").first()["ap"] < 1
    assert time.monotonic() - start < 40
