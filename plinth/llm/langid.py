"""Language identification: script ranges, per-word scores, and Viterbi over each text.

Training counts, for every language, the hashed byte trigrams around each letter byte and the scripts of its words (by
the ranges of UTF-8 lead bytes), over all labelled rows given; the counts are summed by Spark and the model is a fixed
number of buckets per language. A word's score for a language is the sum of its log probabilities; a language
in which the word's script (almost) never occurs is no candidate. Viterbi then labels the words of a text, paying SWITCH for each
change of language, which gives spans of mixed-language text; texts of a batch go through it side by side.

The predicted language has the most letter bytes (ties: the first by name); the score is its share of them. A
text that is null or has no letter is `und` with score 0, and so is every text if nothing is learned.

Cases: rows whose language is null teach nothing. Repeated rows count, and are predicted, each time. Words are runs of
letters: digits and punctuation take no part. Texts of any length are labelled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, fresh, table, text_chunks

BUCKETS, SWITCH, SMOOTH = 1 << 17, 12.0, 0.5
#: A script is a candidate of a language if this share of the language's words has it.
SCRIPT_SHARE = 1e-4
#: Score of a word for a language without its script.
NOT_A_CANDIDATE = -60.0
#: First UTF-8 lead byte of each script range (ASCII, Latin, Greek, Cyrillic, Hebrew, Arabic, other two-byte, Indic and South-East Asian, other E1, punctuation, kana and CJK signs, Han, Hangul, private and forms, four-byte).
SCRIPT_FROM = (0x00, 0xC2, 0xCD, 0xD0, 0xD6, 0xD8, 0xDC, 0xE0, 0xE1, 0xE2, 0xE3, 0xE4, 0xEA, 0xEE, 0xF0)

_SCRIPT = np.searchsorted(np.array(SCRIPT_FROM), np.arange(256), "right") - 1
_SCRIPT[_SCRIPT == 1] = 0  # Latin words mix plain and accented letters
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _features(data: np.ndarray, offsets: np.ndarray):
    """Bucket of each letter byte, first letter of each word, script of each word, first word of each document."""
    padded = np.full(len(data) + 2, 32, np.uint8)
    padded[1:-1] = _LETTER[data]
    letter = padded[1:-1] != 32
    first = letter & (padded[:-2] == 32)
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = letter[cuts]
    before, after = padded[:-2].astype(np.uint32), padded[2:].astype(np.uint32)
    before[cuts] = 32
    after[cuts[cuts > 0] - 1] = 32
    at = np.flatnonzero(letter)
    grams = (before[at] << np.uint32(16)) | (padded[1:-1][at].astype(np.uint32) << np.uint32(8)) | after[at]
    grams = ((grams * np.uint32(2654435761)) >> np.uint32(15)).astype(np.int32)
    start = np.flatnonzero(first)
    return grams, np.searchsorted(at, start), _SCRIPT[data[start]], np.searchsorted(start, offsets), np.searchsorted(at, offsets)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (bucket, language) and candidates (script, language)."""
    n_scripts = len(SCRIPT_FROM)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, _, data, offsets in text_chunks(batch, "text"):
                grams, _, scripts, words_of, letters_of = _features(data, offsets)
                for d, lang in enumerate(langs[a : a + len(offsets) - 1]):
                    own = counts.setdefault(lang, np.zeros(BUCKETS + n_scripts, np.int64))
                    mine = grams[letters_of[d] : letters_of[d + 1]]
                    np.add.at(own, mine, 1) if len(mine) < 4096 else own.__iadd__(np.bincount(mine, minlength=len(own)))
                    np.add.at(own, BUCKETS + scripts[words_of[d] : words_of[d + 1]], 1)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    model = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS + scripts rows a language
    names = model["lang"].to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((BUCKETS + n_scripts, len(languages)))
    index = {x: i for i, x in enumerate(languages)}
    counts[model["bucket"].to_numpy(), np.array([index[x] for x in names], np.int64)] = model["n"].to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    logp = np.log(grams + SMOOTH) - np.log(grams.sum(axis=0) + SMOOTH * BUCKETS)
    return languages, logp.astype(np.float32), scripts > SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word; first: index of each document's first word. Documents advance side by side."""
    lengths = np.diff(first)
    by_length = np.argsort(-lengths, kind="stable")
    start, lengths = first[:-1][by_length], lengths[by_length]
    n_labels = scores.shape[1]
    stays, best_before = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int8 if n_labels < 128 else np.int32)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
    last = np.zeros((len(start), n_labels), scores.dtype)
    if steps:
        last[: active[0]] = scores[start[: active[0]]]
    for t in range(1, steps):
        n = active[t]
        at, before = start[:n] + t, last[:n]
        best = before.argmax(axis=1)
        turn = before[np.arange(n), best][:, None] - switch
        stay = before >= turn
        stays[at] = stay
        best_before[at] = best
        last[:n] = scores[at] + np.where(stay, before, turn)
    labels = np.zeros(len(scores), best_before.dtype)
    state = last.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = np.where(stays[at, state[:n]], state[:n], best_before[at])
    return labels


def identify(documents: DataFrame, model, text_col: str = "text", switch: float = SWITCH, spans: bool = False) -> tuple[DataFrame, str]:
    """documents with a struct column (lang, score, spans), and its name; spans (first word, words, language) only if asked for."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", span_type)])

    def of_batch(batch: pa.RecordBatch) -> pa.Array:
        languages, logp, candidates = sent.value
        scores, letters, firsts, seen, total = [], [], [np.zeros(1, np.int64)], [], 0
        for a, z, data, offsets in text_chunks(batch, text_col):
            grams, start, scripts, words_of, letters_of = _features(data, offsets)
            if languages and len(start):
                parts = []
                for w in range(0, len(start), 1 << 17):  # in parts: a row of float per letter and language
                    own = np.r_[start[w : w + (1 << 17)], start[w + (1 << 17)] if w + (1 << 17) < len(start) else len(grams)]
                    parts.append(np.add.reduceat(logp[grams[own[0] : own[-1]]], own[:-1] - own[0], axis=0))
                scored = np.concatenate(parts)
                allowed = candidates[scripts]
                scored[~allowed & allowed.any(axis=1)[:, None]] += NOT_A_CANDIDATE
                scores.append(scored)
            letters.append(np.diff(np.r_[start, len(grams)]))
            firsts.append(words_of[1:] + total)
            total += len(start)
            plain = np.zeros(len(data) + 1, np.int64)
            np.cumsum((_LETTER[data] != 32) & (data < 128), out=plain[1:])
            has = plain[offsets[1:]] > plain[offsets[:-1]]
            for d in np.flatnonzero(~has & (letters_of[1:] > letters_of[:-1])).tolist():
                has[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
            seen.append(has)
        if not languages or not scores:
            return pa.array([{"lang": "und", "score": 0.0, "spans": [] if spans else None}] * batch.num_rows, kind)
        first, n_languages = np.concatenate(firsts), len(languages)
        labels = viterbi(np.concatenate(scores), first, switch).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        share = np.bincount(doc * n_languages + labels, np.concatenate(letters), batch.num_rows * n_languages).reshape(-1, n_languages)
        best, sums = share.argmax(axis=1), share.sum(axis=1)
        known = np.concatenate(seen) & (sums > 0)
        lang = [languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        score = np.where(known, share[np.arange(len(best)), best] / np.maximum(sums, 1), 0.0)
        found = [None] * batch.num_rows
        if spans:
            for d in range(batch.num_rows):
                own = labels[first[d] : first[d + 1]]
                turn = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
                found[d] = [{"first_word": int(f), "n_words": int(n), "lang": languages[own[f]]} for f, n in zip(turn, np.diff(np.r_[turn, len(own)]), strict=True)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(found, span_type)], fields=list(kind))

    name = fresh(documents, "language")
    return annotate(documents, of_batch, name, "struct<lang:string,score:double,spans:array<struct<first_word:bigint,n_words:bigint,lang:string>>>"), name


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def keep_identified(documents: DataFrame, model=None) -> DataFrame:
    """The documents with a language; texts that are null or have no letter go."""
    found, name = identify(documents, train(documents) if model is None else model)
    return found.where(F.col(f"{name}.lang") != "und").drop(name)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found, name = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(f"{name}.lang").alias("lang_pred"), F.col(f"{name}.score").alias("score"))
