import duckdb
import numpy as np
import pytest
from helpers import SMALL, words

import corpus_pipeline
from plinth.llm import queries
from plinth.llm.common import shared_dir


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage, documents first."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark)
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(frame):
    return sorted(r[0] for r in frame.select("doc_id").collect())


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_id_drops_only_texts_without_letters(stages):
    gone = set(ids(stages[0])) - set(ids(stages[1]))
    assert gone == {r["doc_id"] for r in stages[0].collect() if not any(c.isalpha() for c in r["text"] or "")}


def test_near_duplicates_keep_one_of_each_class(stages):
    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = [shingles(r["text"]) for r in stages[2].collect()]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(kept) for b in kept[:i] if a and b)
    gone = set(ids(stages[1])) - set(ids(stages[2]))
    every = {r["doc_id"]: shingles(r["text"]) for r in stages[1].collect()}
    assert all(any(j != i and len(every[i] & b) >= 0.8 * len(every[i] | b) for j, b in every.items()) for i in gone)


def test_decontamination_drops_what_shares_a_window(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    lengths = {len(x) for x in windows}
    clean = [r["doc_id"] for r in stages[2].collect() if not any(tuple(w[i : i + n]) in windows for w in [words(r["text"])] for n in lengths for i in range(len(w) - n + 1))]
    assert ids(stages[3]) == sorted(clean)


def test_mix_takes_each_document_at_most_twice(stages):
    before, after = ids(stages[3]), ids(stages[4])
    assert set(after) <= set(before) and all(after.count(i) <= 2 for i in set(after))


def test_packing_holds_every_document(stages):
    rows = stages[5].collect()
    starts = sorted(d for r in rows for d, o in zip(r["doc_ids"], r["doc_offsets"], strict=True) if o == 0)
    assert starts == ids(stages[4])
    assert all(len(np.frombuffer(r["input_ids"], "<u2")) == 2048 for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    asked = con.execute(queries.ORACLES[name])
    columns = [x[0] for x in asked.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SMALL).select(columns).collect())) == sorted(asked.fetchall())
