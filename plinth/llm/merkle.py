"""A Merkle manifest of a data set: a hash per row, a tree per group, a tree over the groups' roots, and a proof per row.

H is the lower-case hex SHA-256 of its inputs, concatenated; digests go in as hex text. A leaf is H of a row's fields, each
"-" if null, else its UTF-8 byte count, ":" and the value. In each group the leaves stand in the order of their ids; while
several nodes remain, every `fan` consecutive ones (the last run may have fewer, even one) become their H. What remains is
the group's subroot. The subroots in the order of their groups, null first, give the root in the same way.

Levels are windows: nodes are partitioned by (group, parent index), and a collect_list over the full frame in the order of the
nodes gives each node its whole run: the parent's preimage and the node's siblings. One node of a run stands for the parent
on the next level. Proofs come from above: a parent hands its steps to its children, so that each level is joined once and
the tables shrink by `fan` from level to level.

Positions in a group are not counted in one task: rows are dealt by ranges of (group, id), numbered within their partition,
and the counts of the partitions before are added. A group may hold any share of the rows.

Cases: null ids come first in their group, null groups before others. Ties of ids stand by leaf; rows that are equal in every field have equal
leaves, so their order does not show. A group of one leaf is its own subroot, one group's subroot the root; the proof is
then H of nothing. Empty and null texts differ ("0:" and "-"). An empty table gives no rows. Further columns are not part of the leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, table, through_disk

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(x) for x in fields]), 256)


def numbered(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows, which have a column g, with idx (from 0, by keys within g) and size (rows of g). keys begin with what orders the groups and have no ties."""
    ranged = through_disk(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    each = ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("g", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("g")).alias("size"))
    return ranged.join(through_disk(starts), ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _in_runs(nodes: DataFrame, fan: int) -> DataFrame:
    """nodes (g, size, idx, node) of groups with several nodes, with run (the parent's idx) and members (all nodes of the run, in order)."""
    run = F.floor(F.col("idx") / fan).alias("run")
    whole = Window.partitionBy("g", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.where("size > 1").select("*", run).withColumn("members", F.collect_list("node").over(whole))


def _levels(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """nodes and the levels above them; a group is on all levels up to that where one node of it remains."""
    levels, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        parents = _in_runs(levels[-1], fan).where(F.col("idx") % fan == 0)  # one row of each run
        levels.append(through_disk(parents.select("g", F.ceil(F.col("size") / fan).alias("size"), F.col("run").alias("idx"), F.sha2(F.concat_ws("", "members"), 256).alias("node"))))
        most = -(-most // fan)
    return levels


def _proofs(levels: list[DataFrame], tops: DataFrame, fan: int) -> DataFrame:
    """The rows of the lowest level with steps, from each node to where the steps of tops end. tops: a row per group with g, steps and whatever else its rows get. A step is the siblings before a node and those after it."""
    found = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        made = level.where("size = 1").join(tops, "g")
        if found is not None:
            own = (F.col("idx") % fan).cast("int")
            step = F.struct(F.array_join(F.slice("members", F.lit(1), own), "").alias("before"), F.array_join(F.slice("members", own + 2, F.lit(fan)), "").alias("after"))
            above = found.select(F.col("idx").alias("run"), *tops.columns).withColumnRenamed("steps", "upper")
            made = made.unionByName(_in_runs(level, fan).join(above, ["g", "run"]).withColumn("steps", F.concat(F.array(step), "upper")).select(*made.columns))
        found = through_disk(made) if k else made
    return found


def with_proofs(leaves: DataFrame, group: Column, order: list[Column], fan: int = FAN) -> DataFrame:
    """leaves (any columns, with one named leaf) with steps (from the leaf to the root), subroot and root. order: the columns by which the leaves of a group ascend."""
    names = [c for c in leaves.columns if c != "leaf"]
    rows = leaves.select(F.struct(*names).alias("own") if names else F.lit(None).alias("own"), F.struct(*order).alias("order"), group.alias("of"), field(group).alias("g"), F.col("leaf").alias("node"), F.monotonically_increasing_id().alias("row"))
    levels = _levels(numbered(through_disk(rows), [F.col("of").asc_nulls_first(), F.col("order"), F.col("node"), F.col("row")]), fan)
    of = levels[0].where("idx = 0").select("g", "of")  # a row per group
    last = levels[0].select("g", "size", "node")
    for level in levels[1:]:
        last = last.unionByName(level.select("g", "size", "node"))
    subroots = last.where("size = 1").join(of, "g").select(F.lit("").alias("g"), F.col("g").alias("group"), "of", "node")
    upper = _levels(numbered(through_disk(subroots), [F.col("of").asc_nulls_first(), F.col("group")]), fan)
    root = upper[-1].where("size = 1").select("g", F.col("node").alias("root"), F.array().cast(STEPS).alias("steps"))
    tops = through_disk(_proofs(upper, root, fan).select(F.col("group").alias("g"), F.col("node").alias("subroot"), "root", "steps"))
    return _proofs(levels, tops, fan).select(*[F.col(f"own.{c}").alias(c) for c in names], F.col("node").alias("leaf"), "steps", "subroot", "root")


def folded(start: Column, steps: Column) -> Column:
    """The root that start and the siblings of the steps give."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings_digest(steps: Column) -> Column:
    """H of all siblings, level by level from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", order_col: str = "doc_id", fan: int = FAN) -> DataFrame:
    """A row per row: order_col, leaf, steps, subroot, root."""
    leaves = rows.select(F.col(order_col), F.col(group_col).alias("_group"), leaf([F.col(c) for c in fields]).alias("leaf"))
    return with_proofs(leaves, F.col("_group"), [F.col(order_col)], fan).drop("_group")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, proofs and the root of documents; then every leaf is folded anew, a third of them from texts that were lower-cased."""
    fields = [F.col(c) for c in FIELDS]
    changed = leaf([*fields[:-1], lower_ascii(F.col("text"))])
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    whole = leaf(fields)
    leaves = table(spark, sf_dir, "documents").select("doc_id", "lang", whole.alias("leaf"), F.when(tampered, changed).otherwise(whole).alias("now"))
    proofs = with_proofs(leaves, F.col("lang"), [F.col("doc_id")])
    root = folded(F.col("now"), F.col("steps"))
    return proofs.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("steps")).alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _h(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


_FIELDS_SQL = " || ".join(_h(c) for c in FIELDS[:-1])
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "xor(4294967295::BIGINT, list_reduce([ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')], lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(a, b)), 4294967295::BIGINT))"
_UP = "SELECT level + 1, g, idx // 8, (any_value(size) + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM {0} WHERE size > 1 GROUP BY level, g, idx // 8"
_RUNS = "SELECT level, g, idx // 8 AS run, list(node ORDER BY idx) AS members FROM {0} WHERE size > 1 GROUP BY level, g, idx // 8"
_FOLD = "SELECT f.level + 1, f.doc, f.g, f.idx // 8, sha256(array_to_string(members[:f.idx % 8], '') || f.h || array_to_string(members[f.idx % 8 + 2:], '')), f.sides || array_to_string(members[:f.idx % 8], '') || array_to_string(members[f.idx % 8 + 2:], '') FROM {0} f JOIN {1} r ON r.level = f.level AND r.g = f.g AND r.run = f.idx // 8"
ORACLE = f"""
WITH RECURSIVE hashed AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, lang, {_h("lang")} AS g, sha256({_FIELDS_SQL} || {_h("text")}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({_FIELDS_SQL} || {_h(_LOW)}) ELSE sha256({_FIELDS_SQL} || {_h("text")}) END AS now
  FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, doc) - 1 AS idx, count(*) OVER (PARTITION BY g) AS size FROM hashed),
nodes AS (SELECT 0 AS level, g, idx, size, leaf AS node FROM leaves UNION ALL {_UP.format("nodes")}),
runs AS MATERIALIZED ({_RUNS.format("nodes")}),
walk AS (SELECT 0 AS level, doc, g, idx, now AS h, '' AS sides FROM leaves UNION ALL {_FOLD.format("walk", "runs")}),
walked AS MATERIALIZED (SELECT doc, g, h, sides FROM walk QUALIFY row_number() OVER (PARTITION BY doc ORDER BY level DESC) = 1),
subroots AS MATERIALIZED (
  SELECT n.g AS own, n.node, row_number() OVER (ORDER BY l.lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS size
  FROM nodes n JOIN (SELECT DISTINCT g, lang FROM leaves) l ON l.g = n.g WHERE n.size = 1),
tops AS (SELECT 0 AS level, '' AS g, idx, size, node FROM subroots UNION ALL {_UP.format("tops")}),
topruns AS MATERIALIZED ({_RUNS.format("tops")}),
climb AS (SELECT 0 AS level, w.doc, '' AS g, s.idx, w.h, w.sides FROM walked w JOIN subroots s ON s.own = w.g UNION ALL {_FOLD.format("climb", "topruns")}),
climbed AS MATERIALIZED (SELECT doc, h, sides FROM climb QUALIFY row_number() OVER (PARTITION BY doc ORDER BY level DESC) = 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, t.node AS root, sha256(c.sides) AS proof_sha256, c.h AS folded_root, c.h = t.node AS verified
FROM leaves l JOIN climbed c ON c.doc = l.doc JOIN subroots s ON s.own = l.g CROSS JOIN (SELECT node FROM tops WHERE size = 1) t
"""
