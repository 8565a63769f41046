from itertools import product

import numpy as np
from helpers import documents
from pyspark.sql import functions as F

from plinth.llm.langid import identify, keep_identified, op9_language_id, train, viterbi

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = op9_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    rows = found.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(1)
    first = np.array([0, 4, 4, 9, 10])
    scores = rng.normal(size=(10, 3)) * 4
    labels = viterbi(scores, first, 3.0)
    for a, z in zip(first[:-1], first[1:], strict=True):
        cost = lambda p, a=a: sum(scores[a + i, x] for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(product(range(3), repeat=int(z - a)), key=cost)
        assert np.isclose(cost(tuple(labels[a:z])), cost(best))


def test_mixed_texts_have_spans(spark):
    labelled = documents(spark, [(1, "the house and the garden with the old tree " * 30, "en", "s"), (2, "das haus und der garten mit dem alten baum " * 30, "de", "s"), (3, "дом и сад со старым деревом " * 30, "ru", "s"), (4, "the", None, "s")])
    mixed = documents(spark, [(1, "the house and the garden " * 4 + "das haus und der garten " * 3 + "дом и сад " * 3, None, "s")])
    found, name = identify(mixed, train(labelled), spans=True)
    row = found.select(f"{name}.*").first()
    assert row["lang"] == "en" and [s["lang"] for s in row["spans"]] == ["en", "de", "ru"]
    assert sum(s["n_words"] for s in row["spans"]) == 20 + 15 + 9


def test_texts_without_letters_and_empty_tables(spark):
    rows = [(1, None, "en", None), (2, "", "en", "a"), (3, "123 !? ", "en", "a"), (4, "— · €", "en", "a"), (5, "the house", "en", "a"), (5, "the house", "en", "a"), (6, "the house " * 40_000, "en", "a"), (None, "garden", None, None)]
    docs = documents(spark, rows)
    found, name = identify(docs, train(docs))
    got = {r[0]: (r[1], r[2]) for r in found.select("doc_id", f"{name}.lang", f"{name}.score").collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4)) and got[5][0] == got[6][0] == got[None][0] == "en"
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert keep_identified(docs.limit(0)).count() == 0
    nothing, name = identify(docs, train(docs.where(F.lit(False))))
    assert {r[0] for r in nothing.select(f"{name}.lang").collect()} == {"und"}
