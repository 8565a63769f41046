"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after each run of blanks is made one space; the digest (SHA-256 of the normalised
text) stands for the text from there on. A Misra-Gries summary finds the frequent digests: every part of the table keeps a
bounded number of counters (Spark's frequent-items sketch, a Misra-Gries variant that merges), parts merge in two
steps, and any digest of more than `share` of the rows is among what comes out. Those candidates are verified by an exact
count. The winners, at most 1 / share of them, are broadcast, and their rows find the row that stays on the map side. All
other digests have few rows each and are shuffled as usual. So a text that holds a third of the table never meets in one task.

Texts are read and hashed once; what is written, counted and shuffled are (id, row, digest).

Cases: null text is empty, so it equals texts of blanks cut to nothing only if they are empty too (blanks alone are one space). Null ids
come after all others: they stay only where a group has no other. Of rows with the same text and id, one stays, by the order
in which the rows are read. An empty table gives no rows. Columns beside id and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, through_disk

#: Share of the rows from which a digest is certainly treated as frequent; at most 1 / SHARE digests are broadcast.
SHARE = 1 / 1000
#: Parts in which the first summaries merge, before they merge into one.
FAN = 256
BLANKS = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 of a text in which every run of blanks is one space; null is empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " "), 256))


def frequent(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """mark (a hash of digest) of all digests with more than share of the rows (row, digest), and of some others; at most 1 / share marks.

    A summary of m counters misses no value of more than about 7 / m of the rows; it has 8 / share of them."""
    most, counters = math.ceil(1 / share), math.ceil(8 / share)
    part = (F.shiftright("row", 33) % FAN).alias("part")  # by the partition that a row was read in
    parts = rows.select(part, F.xxhash64("digest").alias("mark")).groupBy("part").agg(F.expr(f"approx_top_k_accumulate(mark, {counters})").alias("summary"))
    # grouped, for a task without rows must give no summary: an empty one cannot be merged
    top = parts.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {counters}), {most})").alias("top"))
    return top.select(F.explode("top").alias("x")).select(F.col("x.item").alias("mark"))


def _grouped(rows: DataFrame, share: float) -> DataFrame:
    """rows (id, row, digest), written before, with keep (a struct with id and row of the row that stays) and size."""
    own = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    marked = rows.withColumn("mark", F.xxhash64("digest")).join(F.broadcast(frequent(rows, share)), "mark", "left_semi")
    winners = through_disk(marked.groupBy("digest").agg(F.min(own).alias("keep"), F.count("*").alias("size")).where("size > 1"))
    heavy = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("digest", "id", "row", F.min(own).over(same).alias("keep"), F.count("*").over(same).alias("size"))
    return heavy.select("digest", "id", "row", "keep", "size").unionByName(rest)


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256."""
    rows = through_disk(documents.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_digest(F.col(text_col)).alias("digest")))
    return _grouped(rows, share).select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The documents that stay, with their own columns."""
    row = fresh(documents, "row")
    numbered = through_disk(documents.withColumn(row, F.monotonically_increasing_id()))
    rows = through_disk(numbered.select(F.col(id_col).alias("id"), F.col(row).alias("row"), text_digest(F.col(text_col)).alias("digest")))
    gone = _grouped(rows, share).where(F.col("row") != F.col("keep.row")).select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*documents.columns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256, row_number() OVER () AS r FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, r)
"""
