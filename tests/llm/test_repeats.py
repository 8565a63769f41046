import hashlib
import random
from collections import Counter

from helpers import documents, random_text

from plinth.llm import repeats
from plinth.llm.repeats import remove_repeats


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, *_), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, length, gram):
    found, name = remove_repeats(documents(spark, rows), length, gram)
    got = found.select("doc_id", f"{name}.n_bytes", f"{name}.n_removed", f"{name}.n_spans", f"{name}.kept_sha256", f"{name}.kept").collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == brute(rows, length)
    assert all(hashlib.sha256(r[5]).hexdigest() == r[4] for r in got)


def test_overlapping_and_periodic_strings(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))), "en", "s") for i in range(40)]
    rows += [(100, "a" * 300, "en", "s"), (101, "ab" * 100, "en", "s"), (102, "a" * 41, "en", "s"), (103, None, None, None), (104, "", "", ""), (None, "xyz" * 20, None, None)]
    check(spark, rows, 24, 12)


def test_shared_passages_and_copies(spark):
    rng = random.Random(4)
    passages = [random_text(rng, 30, 4000) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [random_text(rng, rng.randrange(0, 25), 4000)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 80)
            parts += [p[a : a + rng.randrange(20, 150)], random_text(rng, rng.randrange(0, 10), 4000)]
        rows.append((i, " ".join(parts), "en", "s"))
    rows += [rows[0], rows[1], rows[1], (200, random_text(rng, 20_000, 9000) + passages[0], "en", "s")]
    check(spark, rows, 64, 32)


def test_production_length(spark):
    rng = random.Random(5)
    shared = random_text(rng, 150, 9000)
    rows = [(i, f"{random_text(rng, 50, 9000)}{shared[i : 500 + 3 * i]}{random_text(rng, 50, 9000)}é", "en", "s") for i in range(12)]
    check(spark, rows, 400, 200)


def test_empty_table(spark):
    assert remove_repeats(documents(spark, []))[0].count() == 0


def digests(found, name):
    return sorted((tuple(r) for r in found.select("doc_id", f"{name}.n_bytes", f"{name}.n_removed", f"{name}.n_spans", f"{name}.kept_sha256").collect()), key=repr)


def edged(rng, n):
    """Texts of passages whose copies differ in a letter here and there, and repeated rows."""
    passages = [random_text(rng, 60, 4000) for _ in range(5)]
    rows = []
    for i in range(n):
        text = list(f"{random_text(rng, rng.randrange(0, 9), 4000)} {rng.choice(passages)} {random_text(rng, 3, 4000)}")
        for at in range(rng.randrange(200), len(text), 150):
            text[at] = rng.choice("xyz")
        rows.append((i, "".join(text), "en", "s"))
    return rows + rows[:5] * 2


def test_rounds_write_no_tables_where_buckets_are_small(spark, monkeypatch):
    written, through_disk = [], repeats.through_disk
    monkeypatch.setattr(repeats, "through_disk", lambda df: written.append(df) or through_disk(df))
    check(spark, edged(random.Random(6), 60), 64, 32)
    assert len(written) <= 8


def test_buckets_in_a_task_and_by_joins(spark):
    rows = edged(random.Random(7), 60)
    for most in (1, 12):
        assert digests(*remove_repeats(documents(spark, rows), 64, 32, most=most)) == brute(rows, 64)


def test_buckets_and_texts_over_many_batches(spark):
    rng = random.Random(8)
    rows = edged(rng, 300) + [(1000 + i, random_text(rng, 2), "en", "s") for i in range(3000)]
    name, found = "spark.sql.execution.arrow.maxRecordsPerBatch", documents(spark, rows).coalesce(1)
    before = spark.conf.get(name)
    try:
        for size in ("7", "5000"):
            spark.conf.set(name, size)
            assert digests(*remove_repeats(found, 64, 32)) == brute(rows, 64)
    finally:
        spark.conf.set(name, before)
