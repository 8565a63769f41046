"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample: the distinct vectors with the n_pivots smallest hashes. A vector is represented by its
`depth` nearest pivots in order of nearness. The index is a table, written once: the rows are dealt by hash into blocks of about BLOCK_ROWS, and a block has
its vectors and its inverted files, one row per pivot, with the vectors that have the pivot among their nearest, each with the pivot's rank.
Search brings the queries to the blocks: every block gets each query once (rows / BLOCK_ROWS of them; the index itself is not copied), reads its own entries first and then answers the queries as they stream in, so a task holds one block and
one batch of queries. It walks the files of the query's own pivots, and so gets the footrule distance of the two truncated orders (a
pivot that is missing stands at rank `depth`): each shared pivot lowers it by 2 * (depth - max(rank, rank')). The
nearest `share` of a block by footrule are reranked by exact cosine in double precision, and only the k best per query and block travel on.

Every row is indexed. The share holds recall where neighbours are hardly nearer than other rows, as in the random vectors of the test tables
(recall 0.9 and more at 50,000 rows of 64 numbers); work is in proportion to queries times rows, of which the walk takes depth * depth / n_pivots
steps a pair and the exact measure the share. Vectors with clear neighbours allow a smaller one. Equal
vectors share one entry per block, so copies cannot crowd others out of the candidates.

Cases: null, empty and zero vectors, those with null or non-finite components, and null ids take no part. Ids are whole numbers (cast to long; what does not cast counts as null). Vectors
of different length never meet. Very large and very small vectors are scaled by a power of two first, which changes no cosine and lets no square overflow or vanish. Equal ids are rows of their own. Ties go to the smaller id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import groups, table, through_disk

N_PIVOTS, DEPTH, SHARE, BLOCK_ROWS = 512, 32, 0.15, 8192
#: Fewest candidates of a block that are reranked.
LEAST = 100
FOUND = "query_id long, rank int, vec_id long, score double"
#: A block's vectors (kind 1: slot of equal vectors, row, id, vec) and inverted files (kind 2: slot is the pivot, who and ranks).
ENTRIES = "block int, kind int, slot int, row long, id long, vec array<double>, who binary, ranks binary"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vector: Column) -> Column:
    """A vector whose largest component is far from 1, divided by a power of two near it: exact, and of the same direction."""
    top = F.array_max(F.transform(vector, F.abs))
    return F.when(top.between(1e-100, 1e100), vector).otherwise(F.transform(vector, lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(top)))))


def _matrix(column, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _orders(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = (vectors / _norms(vectors)[:, None]) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :depth]


class Index:
    """The entries of all blocks of one dimension; its vectors (row, id, vec) and pivots."""

    def __init__(self, entries: DataFrame, vectors: DataFrame, blocks: int, pivots: np.ndarray, depth: int):
        self.entries, self.vectors, self.blocks, self.pivots, self.depth = entries, vectors, blocks, pivots, depth


def _entries(group: pa.Table, pivots: np.ndarray, depth: int):
    """The entries of one block: its vectors in the order of their ids, then a file per pivot."""
    block, vectors, rows, ids = group["block"][0].as_py(), _matrix(group["vec"]), group["row"].to_numpy(), group["id"].to_numpy()
    _, own, slot = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    n, orders = len(rows), _orders(vectors[own], pivots, depth)
    for at in range(0, n, 1024):
        m = min(1024, n - at)
        yield [pa.array(np.full(m, block, np.int32)), pa.array(np.full(m, 1, np.int32)), pa.array(slot[at : at + m].astype(np.int32)), pa.array(rows[at : at + m]), pa.array(ids[at : at + m]), group["vec"].slice(at, m).combine_chunks(), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())]
    post = np.argsort(orders.ravel(), kind="stable")
    who, ranks = (post // orders.shape[1]).astype(np.int32), (post % orders.shape[1]).astype(np.int16)
    file = np.searchsorted(orders.ravel()[post], np.arange(len(pivots) + 1))
    some = np.flatnonzero(np.diff(file))
    m = len(some)
    cut = lambda x: pa.array([x[file[p] : file[p + 1]].tobytes() for p in some], pa.binary())
    yield [pa.array(np.full(m, block, np.int32)), pa.array(np.full(m, 2, np.int32)), pa.array(some.astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.float64())), cut(who), cut(ranks)]


def build_index(vectors: DataFrame, n_pivots: int = N_PIVOTS, depth: int = DEPTH, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> list[Index]:
    """One index per vector length."""
    rows = vectors.select(F.expr(f"try_cast(`{id_col}` AS bigint)").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = rows.withColumn("vec", scaled(F.col("vec")))
    rows = through_disk(rows.withColumn("dim", F.size("vec")).withColumn("h", F.xxhash64("vec")).withColumn("row", F.monotonically_increasing_id()))
    built = []
    for dim, n in sorted(tuple(r) for r in rows.groupBy("dim").count().collect()):  # a row per vector length
        own = rows.where(F.col("dim") == dim)
        chosen = [r["h"] for r in own.select("h").distinct().orderBy("h").limit(n_pivots).collect()]
        sample = own.where(F.col("h").isin(chosen)).groupBy("h").agg(F.first("vec").alias("vec")).collect()
        pivots = np.array([r["vec"] for r in sorted(sample, key=lambda r: r["h"])], np.float64)
        pivots /= _norms(pivots)[:, None]
        deep, blocks = min(depth, len(pivots)), max(1, ceil(n / block_rows))
        sent = vectors.sparkSession.sparkContext.broadcast(pivots)

        def run(batches, sent=sent, deep=deep):
            for group in groups(batches, ["block"]):
                for columns in _entries(group, sent.value, deep):
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ENTRIES.split(", ")])

        dealt = own.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "id", "row", "vec")
        entries = through_disk(dealt.repartition(blocks, "block").sortWithinPartitions("block", "id", "row").mapInArrow(run, ENTRIES))
        built.append(Index(entries, own.select("row", "id", "vec"), blocks, pivots, deep))
    return built


class _Block:
    """A block that is ready for queries."""

    def __init__(self, entries: pa.Table):
        kind = entries["kind"].to_numpy()
        own, files = (entries.take(pa.array(np.flatnonzero(kind == x))) for x in (1, 2))
        self.slot, self.rows, self.ids = own["slot"].to_numpy(), own["row"].to_numpy(), own["id"].to_numpy()  # in the order of ids
        self.members = np.argsort(self.slot, kind="stable")  # copies stay in the order of their ids
        self.n = int(self.slot.max()) + 1
        self.starts = np.searchsorted(self.slot[self.members], np.arange(self.n + 1))
        self.unique = _matrix(own["vec"].combine_chunks().take(pa.array(self.members[self.starts[:-1]])))
        self.norms = _norms(self.unique)
        self.posted = {p: (np.frombuffer(w, np.int32), np.frombuffer(r, np.int16)) for p, w, r in zip(files["slot"].to_pylist(), files["who"].to_pylist(), files["ranks"].to_pylist(), strict=True)}


def _search(block: _Block, asked: pa.RecordBatch, pivots: np.ndarray, depth: int, k: int, share: float):
    """The k best rows of a block for each query: query rows, ids and scores."""
    queries = _matrix(asked.column("vec"))
    most = min(block.n, max(LEAST, ceil(share * block.n)))
    out_row, out_id, out_score = [], [], []
    for query_row, query, order in zip(asked.column("row").to_pylist(), queries, _orders(queries, pivots, depth).tolist(), strict=True):
        near = np.zeros(block.n, np.int32)
        for r, p in enumerate(order):
            if p in block.posted:
                who, rank = block.posted[p]
                near[who] += depth - np.maximum(rank, r)
        candidates = np.argpartition(-near, most - 1)[:most] if most < block.n else np.arange(block.n)
        scores = (block.unique[candidates] * query).sum(axis=1) / (block.norms[candidates] * np.sqrt((query * query).sum()))
        at = max(0, len(scores) - k - 1)
        good = scores >= np.partition(scores, at)[at]
        best = []
        for c, s in zip(candidates[good].tolist(), scores[good].tolist(), strict=True):
            same = block.members[block.starts[c] : min(block.starts[c] + k + 1, block.starts[c + 1])]
            best += [(-s, int(block.ids[m])) for m in same if block.rows[m] != query_row]
        best = sorted(best)[:k]
        out_row += [query_row] * len(best)
        out_id += [b for _, b in best]
        out_score += [-s for s, _ in best]
    return out_row, out_id, out_score


def search(index: Index, is_query: Column, k: int = 5, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score for the indexed rows on which is_query (over id) holds."""
    queries = index.vectors.where(is_query)
    sent = index.entries.sparkSession.sparkContext.broadcast(index.pivots)

    def run(batches, sent=sent, depth=index.depth):
        held, ready, at = [], None, None
        for batch in batches:
            block, asked = batch.column("block").to_numpy(), batch.column("kind").to_numpy() == 0
            turns = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (asked[1:] != asked[:-1])]) if len(block) else []
            for a, z in zip(turns, np.r_[turns[1:], len(block)].astype(int), strict=True):
                if block[a] != at:
                    held, ready, at = [], None, block[a]
                if not asked[a]:
                    held.append(batch.slice(a, z - a))
                elif held:
                    ready = ready or _Block(pa.Table.from_batches(held))
                    row, vec, score = _search(ready, batch.slice(a, z - a), sent.value, depth, k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], ["row", "vec_id", "score"])

    none = lambda kind: F.lit(None).cast(kind)
    to_all = F.explode(F.sequence(F.lit(0), F.lit(index.blocks - 1)))
    asked = queries.select(to_all.alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("slot"), "row", "id", "vec", none("binary").alias("who"), none("binary").alias("ranks"))
    met = index.entries.unionByName(asked).repartition(index.blocks, "block").sortWithinPartitions("block", F.desc("kind"), "id", "row")  # a block's entries, then its queries
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    top = met.mapInArrow(run, "row long, vec_id long, score double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(queries.select("row", F.col("id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, share: float = SHARE, **options) -> DataFrame:
    found = [search(x, is_query, k, share) for x in build_index(vectors, **options)]  # one per vector length
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], FOUND)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
