"""Benchmark decontamination by winnowing.

A window is n consecutive words of a benchmark item (the whole item if it has fewer words, but some). Of each window,
only the smallest k-gram hash is kept as its fingerprint. A document's windows are fingerprinted in the same way, so a
shared window always has the same fingerprint on both sides: no shared span of n words can be missed. Fingerprints
that meet are extended to the whole window, whose words must agree.

Up to broadcast_windows benchmark windows (counted first) are sent to the executors and the corpus is read once with no
shuffle; beyond that, the fingerprints are joined by shuffle and give the same rows. There, words agree if two
64-bit hashes of other bases and other codes do; words of over 64 bytes go into both as halves of a BLAKE2 digest.

Cases: null and empty texts have no words and no hits. Repeated document rows each get their row. Items that share a
window are all counted. Item ids keep their type, whatever it is. Null item ids are left out of the list of items but their windows count as hits. An empty
benchmark contaminates nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import LOWER, annotate, fresh, gram_hashes, prefix_hash, signed, sliding_min, span_hash, table, text_chunks, through_disk, word_hashes, words

WINDOW, GRAM = 10, 5
#: Benchmark windows up to which they are broadcast. A Python worker holds about 700 bytes for one of ten words, so at most some 70 MB.
BROADCAST_WINDOWS = 100_000

_LAST = np.uint64(2**64 - 1)


def _fingerprints(hashes: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest k-gram hash of each n words by the window's first word, and whether the window is of one document."""
    k = min(k, n)
    grams, _ = gram_hashes(hashes, first, k)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    _, whole = gram_hashes(hashes, first, n)
    return sliding_min(grams, n - k + 1), whole


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, k: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per window of every item: item, n, fp, h, h2 (another hash), words (lower-cased, joined by spaces)."""

    def run(batches):
        for batch in batches:
            ids, kind = batch.column("item").to_pylist(), batch.column("item").type
            for a, z, data, offsets in text_chunks(batch, "text"):
                start, end, first = words(data, offsets)
                hashes, other, low = word_hashes(data, start, end), word_hashes(data, start, end, True), LOWER[data].tobytes()
                rows = []
                for d in range(z - a):
                    f, l = int(first[d]), int(first[d + 1])
                    if f == l:
                        continue
                    m = min(n, l - f)
                    own = np.array([0, l - f])
                    fp, _ = _fingerprints(hashes[f:l], own, m, k)
                    h, _ = gram_hashes(hashes[f:l], own, m)
                    h2, _ = gram_hashes(other[f:l], own, m, True)
                    rows += [(ids[a + d], m, int(p), int(q), int(r), " ".join(low[start[j] : end[j]].decode("utf-8", "replace") for j in range(f + i, f + i + m))) for i, (p, q, r) in enumerate(zip(signed(fp), signed(h), signed(h2), strict=True))]
                for at in range(0, len(rows), 50_000):
                    item, m, fp, h, h2, text = zip(*rows[at : at + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(item, kind), pa.array(m, pa.int32()), pa.array(fp, pa.int64()), pa.array(h, pa.int64()), pa.array(h2, pa.int64()), pa.array(text, pa.string())], ["item", "n", "fp", "h", "h2", "words"])

    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    return items.mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, n int, fp long, h long, h2 long, words string")


def items_digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(items.cast("array<string>")), ","), 256)


def _result(kind: str) -> str:
    return f"struct<n_words:bigint,n_hit:bigint,n_items:bigint,items:array<{kind}>,contaminated:boolean>"


def _by_broadcast(documents: DataFrame, windows: list, kind: str, k: int, text_col: str, name: str) -> DataFrame:
    known: dict[int, dict[int, dict[str, set]]] = {}
    prints: dict[int, set[int]] = {}
    for item, n, fp, h, _, text in windows:
        known.setdefault(n, {}).setdefault(h, {}).setdefault(text, set()).update(() if item is None else (item,))
        prints.setdefault(n, set()).add(fp)
    sent = documents.sparkSession.sparkContext.broadcast((known, {n: np.sort(np.array(list(x), np.int64)) for n, x in prints.items()}))

    def among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
        return sorted_values[at] == values

    def of_batch(batch: pa.RecordBatch) -> pa.Array:
        known, prints = sent.value
        out = []
        for a, z, data, offsets in text_chunks(batch, text_col):
            start, end, first = words(data, offsets)
            hashes = word_hashes(data, start, end)
            covered, found = np.zeros(len(start) + 1, np.int32), {}
            low = None
            sums = prefix_hash(hashes)
            for n, sorted_prints in prints.items():
                fp, whole = _fingerprints(hashes, first, n, k)
                if not len(fp):
                    continue
                turn = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]])  # neighbours mostly share their fingerprint
                hit = np.repeat(among(sorted_prints, signed(fp[turn])), np.diff(np.r_[turn, len(fp)])) & whole
                at = np.flatnonzero(hit)
                if len(at) and low is None:
                    low = LOWER[data].tobytes()
                for i, h in zip(at.tolist(), signed(span_hash(sums, at, at + n)).tolist(), strict=True):
                    if h in known[n]:
                        items = known[n][h].get(" ".join(low[start[j] : end[j]].decode("utf-8", "replace") for j in range(i, i + n)))
                        if items is not None:
                            covered[i] += 1
                            covered[i + n] -= 1
                            found.setdefault(int(np.searchsorted(first, i, "right")) - 1, set()).update(items)
            sums_hit = np.r_[0, np.cumsum(np.cumsum(covered[:-1]) > 0)]
            n_hit = sums_hit[first[1:]] - sums_hit[first[:-1]]
            for d, (n_words, hit) in enumerate(zip(np.diff(first).tolist(), n_hit.tolist(), strict=True)):
                items = sorted(found.get(d, ()))
                out.append({"n_words": n_words, "n_hit": hit, "n_items": len(items), "items": items, "contaminated": hit > 0})
        return pa.array(out, to_arrow_type(schema))

    schema = StructType.fromDDL(f"x {_result(kind)}")["x"].dataType
    return annotate(documents, of_batch, name, _result(kind))


def _by_shuffle(documents: DataFrame, windows: DataFrame, lengths: list[int], kind: str, k: int, text_col: str, name: str) -> DataFrame:
    row = fresh(documents, "row")
    numbered = through_disk(documents.withColumn(row, F.monotonically_increasing_id()))

    def run(batches):
        for batch in batches:
            rows = np.array(batch.column("row").to_pylist(), np.int64)
            for a, z, data, offsets in text_chunks(batch, "text"):
                start, end, first = words(data, offsets)
                hashes, counts = word_hashes(data, start, end), np.diff(first)
                sums, others = prefix_hash(hashes), prefix_hash(word_hashes(data, start, end, True), True)
                yield pa.RecordBatch.from_arrays([pa.array(rows[a:z]), pa.array(counts), pa.nulls(z - a, pa.int32()), pa.nulls(z - a, pa.int64()), pa.nulls(z - a, pa.int64()), pa.nulls(z - a, pa.list_(pa.int64())), pa.nulls(z - a, pa.list_(pa.int64()))], ["row", "n_words", "n", "fp", "start", "hs", "h2s"])
                for n in lengths:
                    fp, whole = _fingerprints(hashes, first, n, k)
                    at = np.flatnonzero(whole)
                    if not len(at):
                        continue
                    doc = np.searchsorted(first, at, "right") - 1
                    turn = np.flatnonzero(np.r_[True, (fp[at[1:]] != fp[at[:-1]]) | (doc[1:] != doc[:-1])])
                    lists = [pa.ListArray.from_arrays(pa.array(np.r_[turn, len(at)], pa.int32()), pa.array(signed(span_hash(x, at, at + n, other)))) for x, other in ((sums, False), (others, True))]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[a + doc[turn]]), pa.nulls(len(turn), pa.int64()), pa.array(np.full(len(turn), n, np.int32)), pa.array(signed(fp[at[turn]])), pa.array((at - first[doc])[turn]), *lists], ["row", "n_words", "n", "fp", "start", "hs", "h2s"])

    made = through_disk(numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "row long, n_words long, n int, fp long, start long, hs array<long>, h2s array<long>"))
    near = made.where("fp is not null").join(through_disk(windows.select("n", "fp").distinct()), ["n", "fp"], "left_semi")
    spans = near.select("row", "n", "fp", "start", F.posexplode(F.arrays_zip("hs", "h2s")).alias("i", "w")).select("row", "n", "fp", (F.col("start") + F.col("i")).alias("start"), F.col("w.hs").alias("h"), F.col("w.h2s").alias("h2"))
    hits = through_disk(spans.join(windows.select("n", "fp", "h", "h2", "item").distinct(), ["n", "fp", "h", "h2"]).select("row", "n", "start", "item"))
    by_start = Window.partitionBy("row").orderBy("start", "stop")
    ends = hits.select("row", "start", (F.col("start") + F.col("n")).alias("stop")).distinct().withColumn("before", F.coalesce(F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n_hit = ends.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("n_hit"))
    items = hits.where("item is not null").select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = made.where("n_words is not null").select("row", "n_words").join(n_hit, "row", "left").join(items, "row", "left")
    none = F.array().cast(f"array<{kind}>")
    result = F.struct("n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
    return numbered.join(found.select(F.col("row").alias(row), result.alias(name)), row).drop(row)


def find_contamination(documents: DataFrame, benchmark: DataFrame, n: int = WINDOW, k: int = GRAM, text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, str]:
    """documents with a struct column (n_words, n_hit, n_items, items, contaminated), and that column's name."""
    name = fresh(documents, "contamination")
    windows = through_disk(benchmark_windows(benchmark, n, k))
    kind = windows.schema["item"].dataType.simpleString()
    sizes = windows.groupBy("n").count().collect()  # at most n rows
    if sum(x["count"] for x in sizes) <= broadcast_windows:
        return _by_broadcast(documents, [tuple(x) for x in windows.collect()], kind, k, text_col, name), name
    return _by_shuffle(documents, windows, [x["n"] for x in sizes], kind, k, text_col, name), name


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    found, name = find_contamination(documents, benchmark, **options)
    return found.where(~F.col(f"{name}.contaminated")).drop(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", f"{name}.n_words", f"{name}.n_hit", f"{name}.n_items", items_digest(F.col(f"{name}.items")).alias("items_sha256"), f"{name}.contaminated")
