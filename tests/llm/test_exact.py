import hashlib
import random
import re

import pytest
from helpers import documents
from pyspark.sql import functions as F

from plinth.llm.common import through_disk
from plinth.llm.exact import drop_exact_duplicates, exact_groups, frequent


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    hot = [(i, "one  very\tcommon line\n", "en", "s") for i in range(300, 0, -1)]
    some = [(1000 + i, f"text {i // 3}{' ' * (i % 3 + 1)}end", "en", "s") for i in range(200)]
    odd = [(2000, None, None, None), (2001, "", "en", "s"), (2002, " ", "en", "s"), (2003, " ", "en", "s"), (2004, "\t\n\x0b\x0c\r ", "en", "s"), (2005, "a b", "en", "s"), (2006, " a b", "en", "s"), (2007, "A b", "en", "s"), (None, "a b", "en", "s"), (None, "alone", "en", "s"), (None, "alone", "en", "s")]
    long = "long words " * 100_000
    rows = hot + some + odd + [(3000, long, "en", "s"), (2999, long.replace(" ", "  "), "en", "s"), (3000, long, "en", "s"), (1, "one very common line ", "en", "s")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("share", [1 / 1000, 0.1, 0.9])
def test_equals_brute_force(spark, rows, share):
    got = exact_groups(documents(spark, rows).repartition(7), share=share).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_one_document_of_each_group_stays_with_its_columns(spark, rows):
    docs = documents(spark, rows)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == sorted((x[0] for x in brute(rows) if x[3]), key=repr)


def test_frequent_digests_are_always_found(spark):
    """Many more digests than counters; each frequent one is spread over all parts and stands just over its share."""
    rows = spark.range(0, 120_000, 1, 12).select(F.when(F.col("id") % 60 < 3, F.col("id") % 60).otherwise(F.col("id") + 1000).alias("x"))
    rows = through_disk(rows.select(F.unhex(F.sha2(F.col("x").cast("string"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    marks = {r[0] for r in frequent(rows, 1 / 64).collect()}
    wanted = {r[0] for r in spark.range(3).select(F.xxhash64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))).collect()}
    assert wanted <= marks and len(marks) <= 64


def test_empty_table_and_string_ids(spark, rows):
    assert exact_groups(documents(spark, rows).limit(0)).count() == 0
    assert drop_exact_duplicates(documents(spark, rows).limit(0)).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "name string, body string")
    assert {(r["name"], r["keep_id"]) for r in exact_groups(named, "name", "body").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
