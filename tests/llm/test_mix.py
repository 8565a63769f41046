import random

import pytest
from helpers import documents

from plinth.llm import mix
from plinth.llm.mix import mix_sources, mixed, solve_rates


def targets(sizes):
    """Share by share: what is over twice a source's size goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def test_targets_are_reshared(spark):
    rng = random.Random(4)
    for case in ({"a": 100, "b": 1000, None: 900}, {f"s{i:03}": int(1 + rng.paretovariate(0.7) * 50) for i in range(200)}, {"a": 0, None: 0}):
        found = mix.targets(spark.createDataFrame([(s, n, 1) for s, n in case.items()], "source string, size long, n long"))
        wanted = targets(case)
        assert {r["source"]: r["target"] for r in found.collect()} == pytest.approx(wanted)


def test_rates_solve_the_dual(spark):
    """Brute force by bisection of each source's multiplier."""
    import math

    rng = random.Random(5)
    histogram = [(s, size, rng.randrange(1, 9)) for s in ("a", "b", None) for size in rng.sample(range(1, 500), 40)]
    stats = {s: (sum(z * n for t, z, n in histogram if t == s), sum(n for t, _, n in histogram if t == s)) for s in ("a", "b", None)}
    wanted = {"a": 0.3 * stats["a"][0], "b": 1.9 * stats["b"][0], None: stats[None][0] * 1.0}
    got = solve_rates(spark.createDataFrame(histogram, "source string, size long, n long"), stats, wanted)
    for s in stats:
        scale = stats[s][0] / stats[s][1]
        took = lambda x: sum(n * z * 2 / (1 + math.exp(-max(-700, min(700, x * z / scale)))) for t, z, n in histogram if t == s)  # noqa: B023, E731
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if took(mid) < wanted[s] else (low, mid)
        assert took(got[s]) == pytest.approx(wanted[s], rel=1e-6) and got[s] == pytest.approx(low, abs=1e-4)


def test_reshared_by_hand():
    got = targets({"a": 100, "b": 1000, None: 900})
    assert got["a"] == 200  # its share, 3 of 6 parts of 3000, is over twice its size
    # of the 2800 left, 2 of 3 parts are over twice the size of the last, which leaves 1000
    assert got[None] == 1800 and got["b"] == pytest.approx(1000)
    assert sum(targets({"a": 1, "b": 1, "c": 10**6}).values()) == pytest.approx(1.5 * (10**6 + 2))


def rows(seed=2):
    rng = random.Random(seed)
    made = [(i, "w " * rng.choice([0, 1, 3, 20, 200, rng.randrange(1, 900)]), "en", rng.choice(["hot", "hot", "hot", "web", "z", None, "ü"])) for i in range(900)]
    return [*made, (5000, None, None, None), (5001, "\x0b\x0c \t", "en", "z"), (5002, "a b c", "en", "z"), (5003, "w " * 40_000, "en", "hot"), made[0], made[0], (None, "a b", None, "nulls")]


def test_mix(spark):
    docs = documents(spark, rows())
    found, name = mix_sources(docs)
    assert found.columns == [*docs.columns, name]
    got = found.select("doc_id", "source", f"{name}.*").collect()
    assert len(got) == len(rows())
    sizes, took, target = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    assert {r["doc_id"]: r["size"] for r in got}[5002] == 2 and {r["doc_id"]: r["size"] for r in got}[5001] == 0
    wanted = targets(sizes)
    for source, size in sizes.items():
        assert next(r["source_size"] for r in got if r["source"] == source) == size
        assert target[source] == pytest.approx(wanted[source])
        assert abs(took[source] - wanted[source]) <= max(2, 0.002 * wanted[source])
    again = mix_sources(docs)[0].select("doc_id", "source", f"{name}.*")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixed(docs).count() == sum(r["copies"] for r in got)


def test_empty_and_wordless(spark):
    assert mix_sources(documents(spark, []))[0].count() == 0
    found, name = mix_sources(documents(spark, [(1, None, None, None), (2, "", "en", "a")]))
    assert [r[0] for r in found.select(f"{name}.size").collect()] == [0, 0]


def test_many_sources_go_in_groups(spark, monkeypatch):
    docs = documents(spark, rows())
    whole, name = mix_sources(docs)
    monkeypatch.setattr(mix, "MAX_SOURCES", 2)
    parted, other = mix_sources(docs)
    assert parted.columns == whole.columns and other == name
    compare = lambda df: sorted(map(tuple, df.select("doc_id", "source", f"{name}.*").collect()), key=repr)
    assert compare(parted) == compare(whole)
