import numpy as np
import pyarrow as pa
import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from plinth.llm.ann import nearest, op7_nearest


def brute(rows, is_query, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(good):
        if is_query(i):
            scores = sorted((-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 12), j) for other, (j, w) in enumerate(good) if other != at and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def test_recall_and_scores(spark):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    wanted = brute(rows, lambda i: i % 50 == 0)
    found = op7_nearest(spark, SMALL).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(wanted) and all(len(v) == 5 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted) >= 0.9 * sum(map(len, wanted.values()))
    vectors = {i: np.array(v) for i, v in rows}
    for q, best in got.items():
        assert [s for _, s in best] == sorted((s for _, s in best), reverse=True)
        for i, s in best:
            assert s == pytest.approx(vectors[q] @ vectors[i] / np.sqrt((vectors[q] @ vectors[q]) * (vectors[i] @ vectors[i])), abs=1e-12)


def test_odd_vectors_copies_and_ties(spark):
    rows = [(i, [float(np.cos(i)), float(np.sin(i)), 0.5]) for i in range(100)] + [(50, [1.0, 0.0, 0.0])]
    rows += [(200 + i, [0.3, 0.4, 0.5]) for i in range(20)] + [(150, [0.3, 0.4, 0.5])]
    rows += [(300, None), (350, []), (400, [0.0, 0.0, 0.0]), (450, [1.0, None, 2.0]), (500, [float("nan"), 1.0, 1.0]), (550, [float("inf"), 1.0, 1.0]), (600, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (650, [1.0, 2.5])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, row int, id string")
    got = {}
    for r in nearest(frame.repartition(3), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 50, 150, 200, 600, 650}
    assert [i for i, _ in got[150]] == [200, 201, 202, 203, 204] and [i for i, _ in got[200]] == [150, 201, 202, 203, 204]
    assert [i for i, _ in got[600]] == [650]


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") >= 0).count() == 0


def test_recall_at_fifty_thousand(spark):
    """Random vectors, the hardest case: no row is much nearer than another. Queries are the rows with ids divisible by 100."""
    vectors = np.random.default_rng(5).standard_normal((50_000, 64)).astype(np.float32)
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(range(50_000), pa.int64()), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))}))
    got = {}
    for r in nearest(frame, F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None]
    hits = 0
    for q in range(0, 50_000, 100):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(got[q] & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.9 * 5 * 500


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e307, 1e-310])
def test_very_large_and_very_small_vectors(spark, size):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((60, 4))
    if size < 1e-300:
        vectors = np.round(vectors * 8) / 8  # few digits are left there
    rows = [(i, [float(x) for x in v * size / (4 if size > 1 else 1)]) for i, v in enumerate(vectors)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    assert sorted(got) == list(range(0, 60, 10))
    for q, found in got.items():
        near = unit @ unit[q]
        near[q] = -2
        assert np.allclose([s for *_, s in sorted(found)], np.sort(near)[::-1][:5], atol=1e-6)

