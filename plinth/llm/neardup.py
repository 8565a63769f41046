"""N-gram Jaccard join by MinHash prefixes at one depth (banding in place of an LSH forest; the README says why), with exact verification.

Texts are sets of hashed SHINGLE-word shingles (a text of fewer words, but some, is one shingle). Equal texts are one class with a count. There are TREES
signatures of minhash values; two texts meet in a tree if the first `depth` values agree. The depth is the largest, MOST_DEPTH at most, at which the predicted recall of a pair at the threshold, 1 - (1 - threshold**depth)**TREES, reaches
RECALL; it is the same for all texts, and signatures are computed only that deep. The texts of a prefix are tied to the smallest of them, so prefixes of
any number of texts give a row per text; prefixes that share texts make a candidate cluster.

Verification is exact and loses no pair of a cluster: its texts are dealt into blocks of about BLOCK, and each pair of blocks is compared in a
task of its own, with a length filter and overlap counts on sorted shingles. Only a spanning forest of the links and
each text's number of links come back, never the pairs. Connected links are a near-duplicate class.

Cases: null, empty and word-less texts are classes of their own without links. Repeated rows are copies of each other. The representative of a
class has the smallest id, nulls last, ties by the text's digest. A hot group of copies costs one text. Near copies of one text cost work with the
square of their number, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, groups, mix, prefix_hash, signed, span_hash, table, text_chunks, through_disk, word_hashes, words

SHINGLE, THRESHOLD, TREES, MOST_DEPTH, RECALL, BLOCK = 5, 0.8, 16, 8, 0.999, 256


def depth_for(threshold: float, trees: int, most: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree with the wanted probability."""
    depth = most
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all documents, and where each document's begin (one entry more than documents)."""
    start, end, first = words(data, offsets)
    sums, count = prefix_hash(word_hashes(data, start, end)), np.diff(first)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.r_[0, np.cumsum(own)]
    doc = np.repeat(np.arange(len(own)), own)
    at = np.arange(bounds[-1]) - bounds[:-1][doc] + first[:-1][doc]
    return span_hash(sums, at, at + np.minimum(count[doc], n)), bounds


def forest_nodes(hashes: np.ndarray, bounds: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The trie node of every document that has shingles (rows) in every tree (columns)."""
    factors = np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, (trees, depth), dtype=np.uint64) | np.uint64(1)
    salts = factors[::-1, ::-1].copy()
    begin = bounds[:-1][np.diff(bounds) > 0]
    nodes = np.zeros((len(begin), trees), np.uint64)
    for t in range(trees):
        for j in range(depth):
            smallest = np.minimum.reduceat((hashes * factors[t, j]) >> np.uint64(32), begin)
            nodes[:, t] = mix(nodes[:, t] + smallest + salts[t, j])
    return nodes


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).alias("doc_id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("key"), text.alias("text"))


def text_classes(keyed: DataFrame, trees: int, depth: int) -> DataFrame:
    """One row per different text with words: id, key, copies, first (smallest doc_id), nodes."""

    def run(batches):
        for batch in batches:
            for a, z, data, offsets in text_chunks(batch, "text"):
                hashes, bounds = shingles(data, offsets)
                some = np.flatnonzero(np.diff(bounds) > 0)
                if len(some):
                    nodes = forest_nodes(hashes, bounds, trees, depth)
                    rows = pa.array(a + some)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array([x.tobytes() for x in signed(nodes)], pa.binary())], ["doc_id", "key", "nodes"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    made = keyed.mapInArrow(run, f"doc_id {kind}, key binary, nodes binary")
    return made.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.first("nodes").alias("nodes")).withColumn("id", F.monotonically_increasing_id())


def star_edges(classes: DataFrame, trees: int) -> DataFrame:
    """(a, b): each member of a trie node and the node's smallest member."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy()
                nodes = np.frombuffer(b"".join(batch.column("nodes").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.repeat(ids, trees))], ["node", "a"])

    posted = classes.select("id", "nodes").mapInArrow(run, "node long, a long")
    centres = posted.groupBy("node").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return posted.join(centres, "node").where("a > b").select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (its smallest id) of every end of an edge (a, b). Each round points nodes to their smallest neighbour, jumps twice along the pointers and contracts the edges; what is settled leaves the edge table."""
    edges, labels = through_disk(edges), None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a")).toDF("id", "near")
        up = through_disk(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("up")))
        for _ in range(2):
            above = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("id", F.col("top").alias("up"))
        up = through_disk(up)
        step = up.select(F.col("id").alias("component"), "up")
        labels = up.select("id", F.col("up").alias("component")) if labels is None else labels.join(step, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        labels = through_disk(labels)
        ends = edges.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").where("x <> y")
        edges = through_disk(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _compare(group: pa.Table, threshold: float):
    """Links of one pair of blocks: a spanning forest (a, b) and, for each id, how many documents it is linked to."""
    ids, first = np.unique(group["id"].to_numpy(), return_index=True)
    group = group.take(pa.array(first))
    block, copies = group["block"].to_numpy(), group["copies"].to_numpy()
    sets = [np.frombuffer(x, np.int64) for x in group["set"].to_pylist()]
    across = int(group["low"][0].as_py()) != int(group["high"][0].as_py())
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    links, parent, forest = np.zeros(len(ids), np.int64), list(range(len(ids))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    joined, bounds = np.concatenate([sets[i] for i in order]), np.r_[0, np.cumsum(sizes[order])]
    for k, i in enumerate(order[:-1]):
        most = np.searchsorted(sizes[order], sizes[i] / threshold + 1e-9, "right")  # longer sets cannot reach it
        if most <= k + 1:
            continue
        rest = joined[bounds[k + 1] : bounds[most]]
        own = sets[i]
        at = np.searchsorted(own, rest)
        at[at == len(own)] = 0
        shared = np.add.reduceat((own[at] == rest).astype(np.int64), bounds[k + 1 : most] - bounds[k + 1])
        others = order[k + 1 : most]
        linked = shared >= threshold * (sizes[i] + sizes[others] - shared) - 1e-9
        if across:
            linked &= block[others] != block[i]
        for j in others[linked].tolist():
            links[i] += copies[j]
            links[j] += copies[i]
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                forest.append((int(ids[i]), int(ids[j])))
    return forest, [(int(x), int(n)) for x, n in zip(ids, links, strict=True) if n]


def verified_links(keyed: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (a, b, null) of the link forest and (a, null, n) of link counts."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("n"))
    wanted = classes.select("key", "id", "copies").join(clusters, "id").join(sizes, "component").select("key", "id", "copies", "component", F.ceil(F.col("n") / block).cast("int").alias("blocks"))

    def sets(batches):
        before = None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            fresh_rows = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else before)]  # not the copies of the text before
            before = keys[-1] if keys else before
            batch = batch.take(pa.array(fresh_rows, pa.int64()))
            for a, z, data, offsets in text_chunks(batch, "text"):
                hashes, bounds = shingles(data, offsets)
                made = [np.unique(signed(hashes[bounds[d] : bounds[d + 1]])).tobytes() for d in range(z - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, z - a) for x in ("id", "copies", "component", "blocks")), pa.array(made, pa.binary())], ["id", "copies", "component", "blocks", "set"])

    made = keyed.select("key", "text").join(wanted, "key").mapInArrow(sets, "id long, copies long, component long, blocks int, set binary")
    dealt = made.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["component", "low", "high"]
    dealt = dealt.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "copies", "block", "set")

    def compare(batches):
        for group in groups(batches, unit):
            forest, counts = _compare(group, threshold)
            rows = [(a, b, None) for a, b in forest] + [(a, None, n) for a, n in counts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["a", "b", "n"])

    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(compare, "a long, b long, n long")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, most_depth: int = MOST_DEPTH, recall: float = RECALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text with words: key, copies, representative (class_key, class_id) and n_links of each of its documents."""
    keyed = _keyed(documents, id_col, text_col)
    classes = through_disk(text_classes(keyed, trees, depth_for(threshold, trees, most_depth, recall)))
    clusters = components(through_disk(star_edges(classes, trees)))
    found = through_disk(verified_links(keyed, classes, clusters, threshold, block))
    groups = components(found.where("b is not null").select("a", "b"))
    links = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    named = classes.join(groups, "id", "left").join(links, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("last"), F.col("first").alias("class_id"), F.col("key").alias("class_key"))).alias("head"))
    return through_disk(named.join(heads, "component").select("key", "copies", "head.class_id", "head.class_key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))


def with_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, str]:
    """documents with a struct column (class_id, n_links, kept): kept is true for the representative of a class (all rows that tie for it)."""
    found = near_duplicates(documents, id_col=id_col, text_col=text_col, **options)
    key, name = fresh(documents, "key"), fresh(documents, "near")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = found.select(F.col("key").alias(key), F.struct("class_id", "n_links", (F.col("key") == F.col("class_key")).alias("kept")).alias(name))
    joined = documents.withColumn(key, F.unhex(F.substring(F.sha2(text, 256), 1, 32))).join(own, key, "left")
    alone = F.struct(F.col(id_col).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    mine = F.struct(F.col(f"{name}.class_id").alias("class_id"), F.col(f"{name}.n_links").alias("n_links"), (F.col(f"{name}.kept") & F.col(id_col).eqNullSafe(F.col(f"{name}.class_id"))).alias("kept"))
    return joined.withColumn(name, F.when(F.col(name).isNull(), alone).otherwise(mine)).drop(key), name


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with its own columns; texts without words stay."""
    found, name = with_classes(documents, id_col, text_col, **options)
    some = F.coalesce(F.length(text_col), F.lit(0)) > 0
    kept = through_disk(found.where(f"{name}.kept"))
    ties = kept.where(some).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")
    kept = kept.drop(name)
    if ties.isEmpty():
        return kept
    return kept.where(some).dropDuplicates([id_col, text_col]).union(kept.where(~some))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = with_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", f"{name}.class_id", f"{name}.n_links")
