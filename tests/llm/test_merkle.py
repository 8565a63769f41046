import hashlib
import random
import zlib

import pytest
from helpers import LOWER, documents, write_tables

from plinth.llm.merkle import folded, manifest, op13_merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes, fan):
    """The root and, for each node, its siblings level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k in range(len(nodes)):
            run = at[k] // fan * fan
            paths[k].append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + fan])))
            at[k] //= fan
        level = [h(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], paths


def brute(rows, fan=8):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, h(*map(field, r))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for g in langs:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(tree([x[1] for x in groups[g]], fan))
    root, upper = tree([t[0] for t in trees], fan)
    out = []
    for g, (subroot, paths), above in zip(langs, trees, upper, strict=True):
        for (r, leaf), path in zip(groups[g], paths, strict=True):
            steps = path + above
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = h(*map(field, (*r[:4], r[4].translate(LOWER))))
            for before, after in steps:
                now = h(before, now, after)
            out.append((r[0], leaf, subroot, root, h(*[x + y for x, y in steps]), now, now == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, f"s{i % 3}", rng.choice(["en"] * 8 + ["de", "fr", "pt", "zh", "日本", "é", "", "x", "y"]), i, f"Text Ünd {i}") for i in range(700)]
    out += [(1000, None, None, None, None), (1001, "s", None, 4, ""), (None, "s", "en", 4, "No Id"), (5, "s", "en", 4, "again 5"), (5, "s", "en", 4, "again 5"), (2000, "s", "only", 1, "A"), (2001, "s", "en", 10**6, "Long " * 200_000)]
    return out


def test_equals_brute_force(spark, rows, tmp_path):
    found = op13_merkle(spark, write_tables(tmp_path, documents=spark.createDataFrame(rows, SCHEMA))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
    assert {r["verified"] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_tree_sizes(spark, n, tmp_path):
    rows = [(i, "s", "en", i, "t") for i in range(n)]
    found = op13_merkle(spark, write_tables(tmp_path, documents=spark.createDataFrame(rows, SCHEMA))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_other_columns_group_and_fan(spark):
    rows = [(i, f"t{i}", None if i % 5 == 0 else "en", f"s{i % 2}") for i in range(30)]
    found = manifest(documents(spark, rows), ("doc_id", "text"), "source", "doc_id", fan=3)
    one = found.select("*", folded(found.leaf, found.steps).alias("again")).collect()
    assert len(one) == 30 and all(r["again"] == r["root"] for r in one)
    want = tree([tree([h(field(i), field(f"t{i}")) for i in range(s, 30, 2)], 3)[0] for s in (0, 1)], 3)[0]
    assert {r["root"] for r in one} == {want}
    assert manifest(documents(spark, rows).limit(0), ("doc_id", "text")).count() == 0
