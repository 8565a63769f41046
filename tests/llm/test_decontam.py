import hashlib
import random

import pytest
from helpers import documents, random_text, words

from plinth.llm.decontam import decontaminate, find_contamination, items_digest


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                own = windows.get(tuple(w[i : i + m]))
                if own is not None:
                    hit.update(range(i, i + m))
                    found |= own
        items_of = sorted(x for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(items_of), items_of, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(1)
    items = [(i, random_text(rng, rng.choice([1, 3, 9, 10, 11, 40]), 400)) for i in range(30)]
    items += [(100, None), (101, ""), (102, "..."), (None, random_text(rng, 12, 400)), (5, items[4][1])]
    rows = [(i, random_text(rng, rng.randrange(0, 60), 400), "en", "s") for i in range(60)]
    for i in range(40):
        part = (items[i % 30][1] or "").split()
        cut = part[: rng.randrange(1, len(part) + 1)]
        rows.append((100 + i, f"{random_text(rng, 7)} {' , '.join(cut).upper()} {random_text(rng, 5)}", "en", "s"))
    long = random_text(rng, 30_000, 5000)
    rows += [(900, long, "en", "s"), (901, f"{long} {items[5][1]} {long}", "en", "s"), (902, None, None, None), (903, "", "", ""), (None, items[5][1], "en", "s"), (904, items[33][1], "en", "s")]
    rows += [rows[65], rows[65]]
    return rows, items


@pytest.mark.parametrize("broadcast_windows", [300_000, 0])
def test_equals_brute_force(spark, case, broadcast_windows):
    rows, items = case
    found, name = find_contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=broadcast_windows)
    got = found.select("doc_id", f"{name}.n_words", f"{name}.n_hit", f"{name}.n_items", f"{name}.items", f"{name}.contaminated").collect()
    assert sorted(((*r[:4], list(r[4]), r[5]) for r in got), key=repr) == brute(rows, items)


@pytest.mark.parametrize("broadcast_windows", [300_000, 0])
def test_empty_tables_and_columns(spark, case, broadcast_windows):
    rows, items = case
    docs, none = documents(spark, rows), spark.createDataFrame([], "item_id long, text string")
    kept = decontaminate(docs, none, broadcast_windows=broadcast_windows)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert decontaminate(docs.limit(0), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=broadcast_windows).count() == 0


@pytest.mark.parametrize("broadcast_windows", [300_000, 0])
def test_long_words_of_two_letters_do_not_collide(spark, broadcast_windows):
    """Two Thue-Morse words, each the complement of the other: any polynomial hash modulo a power of two gives both the same value."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    rest = "some words that stand around a long one here"
    rows = [(1, f"{one} {rest}", "en", "s"), (2, f"{two} {rest}", "en", "s")]
    found, name = find_contamination(documents(spark, rows), spark.createDataFrame([(7, f"{one} {rest}")], "item_id long, text string"), broadcast_windows=broadcast_windows)
    assert {(r["doc_id"], r["n_hit"]) for r in found.select("doc_id", f"{name}.n_hit").collect()} == {(1, 10), (2, 0)}


@pytest.mark.parametrize("broadcast_windows", [300_000, 0])
def test_item_ids_of_any_type(spark, broadcast_windows):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "s"), (2, "none of it", "en", "s")]
    items = spark.createDataFrame([("q-1", text), ("q-10", f"{text} eleven"), ("q-1", "ten words that stand nowhere else in this whole test"), (None, text)], "item_id string, text string")
    found, name = find_contamination(documents(spark, rows), items, broadcast_windows=broadcast_windows)
    assert {(r["doc_id"], r["n_items"], tuple(r["items"])) for r in found.select("doc_id", f"{name}.*").collect()} == {(1, 2, ("q-1", "q-10")), (2, 0, ())}
    digest = found.select(items_digest(found[name]["items"]).alias("x")).where(f"{name}.n_hit > 0").first()["x"]
    assert digest == hashlib.sha256(b"q-1,q-10").hexdigest()
