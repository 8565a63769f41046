"""Mixing sources to target weights by entropy balancing.

Each source s has a target T_s of words. Document rates w solve: closest to one copy each in bounded entropy (rates
between 0 and 2), subject to sum(w * size) = T_s. The dual is convex, with one multiplier a source, and its solution
tilts documents exponentially by size: w = 2 / (1 + exp(-lambda_s * size / mean_s)). Newton iterations on the dual sum the
constraint and its derivative over all documents in Spark, from the counts of (source, size); a bracket keeps them safe.

Rates are rounded into copies 0, 1 or 2 by systematic rounding: in cells of about CELL documents of a source, ordered by
size, a document gets its fraction's copy where the running sum of fractions passes a half. What a source then still
lacks or has too much is mended: first within one cell of it, by copies of the largest documents whose running sum stays within the gap,
then by a few single copies, the largest that fits each time. Reruns agree.

Targets: sources in code point order, null last, have weights 3, 1, 2, repeating, and share SHARE of all words; a target
stops at MOST times its source's words and the excess is shared again.

Sources are ranked, and their targets found, in Spark. Only a row per source reaches the driver, and of at most MAX_SOURCES at
once: more sources are mixed in groups of that many, which do not touch each other once the targets stand.

Cases: null and empty texts have size 0 and are taken 0 times their 0 words; null is a source of its own. Repeated rows are rounded
each on their own; rows that agree in size and id are alike, so which of them gets a copy does not show. An empty table gives no rows.
Columns of any other name stay as they are.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import placed
from .common import fresh, table, through_disk

WEIGHTS, SHARE, MOST, CELL, MAX_SOURCES = (3.0, 1.0, 2.0), 1.5, 2.0, 4096, 100_000
#: Changed copies up to which they are broadcast (16 bytes each); beyond, they are joined by shuffle.
ROUNDS, MENDS, BROADCAST_CHANGES = 60, 6, 1_000_000


def word_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(counted: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """counted: source, size, n. source, total, n, place (from 1) and target of every source.

    The targets are least(unit * weight, most * total) for the one unit at which they add up to the share of all words: each round the sources that the
    last unit has filled up leave the sum, which raises the unit, until no more fill up."""
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n"))
    ranked = placed(totals, [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = through_disk(ranked.withColumn("weight", weight))
    unit, filled = 0.0, -1
    while True:
        full = F.lit(unit) * F.col("weight") > most * F.col("total")
        r = ranked.agg(F.sum("total").alias("all"), F.count_if(full).alias("filled"), F.sum(F.when(full, most * F.col("total"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if r["filled"] == filled or not r["weights"]:
            break
        filled, unit = r["filled"], (share * r["all"] - (r["taken"] or 0.0)) / r["weights"]
    full = F.lit(unit) * F.col("weight") > most * F.col("total")
    return ranked.select("source", "total", "n", "place", F.when(full, most * F.col("total")).otherwise(F.lit(unit) * F.col("weight")).alias("target"))


def solve_rates(histogram: DataFrame, stats: dict, wanted: dict, most: float = MOST, rounds: int = ROUNDS) -> dict:
    """lambda of every source whose target lies strictly between nothing and everything."""
    spark = histogram.sparkSession
    state = {s: [0.0, -1.0, 1.0, False, False] for s, (total, _) in stats.items() if 0 < wanted[s] < most * total}  # lambda, bracket, is either end proven
    scale = {s: total / n for s, (total, n) in stats.items()}
    todo = set(state)
    for _ in range(rounds):
        if not todo:
            break
        now = spark.createDataFrame([(s, scale[s], state[s][0]) for s in todo], "source string, scale double, tilt double")
        z = F.col("size") / F.col("scale")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * z))))
        sums = histogram.join(F.broadcast(now), histogram["source"].eqNullSafe(now["source"])).groupBy(now["source"]).agg(F.sum(most * p * F.col("size") * F.col("n")).alias("took"), F.sum(most * p * (1 - p) * z * F.col("size") * F.col("n")).alias("slope"))
        for r in sums.collect():
            s, gap = r["source"], r["took"] - wanted[r["source"]]
            x = state[s]
            if abs(gap) <= 1e-8 * wanted[s]:
                todo.discard(s)
                continue
            side = 2 if gap > 0 else 1
            x[side], x[side + 2] = x[0], True
            step = x[0] - gap / r["slope"] if r["slope"] > 0 else float("nan")
            for end, sign in ((1, -1), (2, 1)):  # widen an end that is not proven yet
                if not x[end + 2] and sign * (step if step == step else sign * 1e300) > sign * x[end]:
                    x[end] = x[0] + sign * max(1.0, 4 * abs(x[0]))
            x[0] = step if step == step and x[1] < step < x[2] else (x[1] + x[2]) / 2
    return {s: x[0] for s, x in state.items()}


def mix_sources(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> tuple[DataFrame, str]:
    """documents with a struct column (size, source_size, target, copies), and its name. copies * size is what the mix takes; size_col: sizes that are counted already."""
    name, size, key = fresh(documents, "mix"), fresh(documents, "size"), fresh(documents, "row")
    sized = documents.withColumn(size, F.col(size_col) if size_col else word_size(F.col(text_col)))
    counted = through_disk(sized.groupBy(F.col(source_col).cast("string").alias("source"), F.col(size).alias("size")).agg(F.count("*").alias("n")))
    wanted = through_disk(targets(counted))
    groups = max(1, ceil(wanted.count() / MAX_SOURCES))
    if groups == 1:
        return _mixed_group(documents, sized, counted, wanted, name, size, key, id_col, source_col), name
    group, out = fresh(sized, "group"), []
    renamed = wanted.select(F.col("source").alias(f"{group}_source"), (F.col("place") % groups).alias(group))
    own = lambda df, column: through_disk(df.join(renamed, F.col(column).cast("string").eqNullSafe(F.col(f"{group}_source"))).drop(f"{group}_source"))
    sized, counted = own(sized, source_col), own(counted, "source")
    for g in range(groups):
        one = F.col(group) == g
        out.append(_mixed_group(documents, sized.where(one).drop(group), counted.where(one).drop(group), wanted.where(F.col("place") % groups == g), name, size, key, id_col, source_col))
    return reduce(DataFrame.union, out), name


def _mixed_group(documents: DataFrame, sized: DataFrame, counted: DataFrame, targeted: DataFrame, name: str, size: str, key: str, id_col: str, source_col: str) -> DataFrame:
    """The mix of at most MAX_SOURCES sources."""
    spark = documents.sparkSession
    rows = targeted.collect()
    stats, wanted = {r["source"]: (r["total"], r["n"]) for r in rows}, {r["source"]: r["target"] for r in rows}
    tilt = solve_rates(counted, stats, wanted)
    full = lambda s: stats[s][0] > 0 and wanted[s] >= MOST * stats[s][0]
    plan = spark.createDataFrame(
        [(s, total, wanted[s], total / n or 1.0, tilt.get(s), MOST if full(s) else 0.0, ceil(n / CELL)) for s, (total, n) in stats.items()],
        "m_source string, source_size long, target double, scale double, tilt double, fixed double, cells int",
    )
    renamed = {c: fresh(sized, c) for c in plan.columns}
    plan = plan.select([F.col(c).alias(n) for c, n in renamed.items()])
    m = {c: F.col(n) for c, n in renamed.items()}
    rate = F.when(m["tilt"].isNull(), m["fixed"]).otherwise(MOST / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), m["tilt"] * F.col(size) / m["scale"])))))
    work = sized.join(F.broadcast(plan), F.col(source_col).cast("string").eqNullSafe(m["m_source"]))
    t = {x: fresh(work, x) for x in ("rate", "order", "cell", "upto", "copies")}
    part = F.col(t["rate"]) - F.floor(t["rate"])
    cells = Window.partitionBy(source_col, t["cell"]).orderBy(size, t["order"], id_col)
    work = work.withColumn(t["rate"], rate).withColumn(t["order"], F.xxhash64(F.col(id_col), F.col(size)))
    work = work.withColumn(t["cell"], F.pmod(F.col(t["order"]), m["cells"])).withColumn(t["upto"], F.sum(part).over(cells.rowsBetween(Window.unboundedPreceding, 0)))
    extra = F.floor(F.col(t["upto"]) + 0.5) - F.floor(F.col(t["upto"]) - part + 0.5)
    work = work.withColumn(t["copies"], F.least(F.lit(int(MOST)), F.floor(t["rate"]) + F.greatest(F.lit(0), F.least(F.lit(1), extra))).cast("long"))
    result = F.struct(F.col(size).alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), F.col(t["copies"]).alias("copies"))
    rounded = through_disk(work.select(*documents.columns, result.alias(name), F.struct(F.monotonically_increasing_id().alias("key"), F.col(t["cell"]).alias("cell")).alias(key)))
    rows = rounded.select(F.col(source_col).cast("string").alias("source"), F.col(f"{name}.size").alias("size"), F.col(f"{name}.copies").alias("copies"), f"{key}.key", f"{key}.cell", F.xxhash64(id_col).alias("order"))
    changes = through_disk(_cell_mends(rows, wanted))
    singles = _single_mends(rows.join(changes, "key", "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))), wanted)
    changes = changes.union(spark.createDataFrame(singles, changes.schema)).groupBy("key").agg(F.sum("change").alias("change"))  # at most MENDS of them a source
    if changes.count() <= BROADCAST_CHANGES:
        changes = F.broadcast(changes)
    moved = {c: fresh(rounded, c) for c in ("key", "change")}
    changes = changes.select([F.col(c).alias(n) for c, n in moved.items()])
    mended = rounded.join(changes, F.col(f"{key}.key") == F.col(moved["key"]), "left")
    copies = F.col(f"{name}.copies") + F.coalesce(F.col(moved["change"]), F.lit(0))
    return mended.withColumn(name, F.col(name).withField("copies", copies)).select(*documents.columns, name)


def _gaps(rows: DataFrame, wanted: dict) -> dict:
    took = {r["source"]: r["took"] for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("took")).collect()}  # a row per source
    return {s: wanted[s] - x for s, x in took.items() if abs(wanted[s] - x) >= 1}


def _fitting(rows: DataFrame, gaps: dict) -> DataFrame:
    """The rows one copy of which, more or less, narrows the gap of their source."""
    now = F.broadcast(rows.sparkSession.createDataFrame(list(gaps.items()), "g_source string, gap double"))
    fits = F.when(F.col("gap") > 0, F.col("copies") < int(MOST)).otherwise(F.col("copies") > 0) & (F.col("size") <= F.abs("gap")) & (F.col("size") > 0)
    return rows.join(now, rows["source"].eqNullSafe(now["g_source"])).where(fits)


def _cell_mends(rows: DataFrame, wanted: dict) -> DataFrame:
    """key and change (1 or -1) of documents in the first cell of each source, about CELL of them."""
    upto = F.sum("size").over(Window.partitionBy("source").orderBy(F.col("size").desc(), "order", "key").rowsBetween(Window.unboundedPreceding, 0))
    found = _fitting(rows.where("cell = 0"), _gaps(rows, wanted)).withColumn("upto", upto)
    return found.where(F.col("upto") <= F.abs("gap")).select("key", F.signum("gap").cast("long").alias("change"))


def _single_mends(rows: DataFrame, wanted: dict) -> list[tuple[int, int]]:
    gaps, changes = _gaps(rows, wanted), []
    for _ in range(MENDS):
        if not gaps:
            break
        fresh_rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(changes, "key long, change long").select("key")), "key", "left_anti") if changes else rows  # at most MENDS a source
        best = _fitting(fresh_rows, gaps).groupBy("g_source").agg(F.max(F.struct("size", (-F.col("key")).alias("k"))).alias("best")).collect()
        left = {}
        for r in best:
            sign = 1 if gaps[r["g_source"]] > 0 else -1
            changes.append((-r["best"]["k"], sign))
            left[r["g_source"]] = gaps[r["g_source"]] - sign * r["best"]["size"]
        gaps = {s: g for s, g in left.items() if abs(g) >= 1}
    return changes


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as its copies, with its own columns. Only ids, sources and sizes are sorted and rounded; the documents are joined to their copies once."""
    row, words, copies = (fresh(documents, x) for x in ("row", "words", "copies"))
    numbered = through_disk(documents.withColumn(row, F.monotonically_increasing_id()))
    found, name = mix_sources(numbered.select(row, id_col, source_col, word_size(F.col(text_col)).alias(words)), id_col, source_col=source_col, size_col=words)
    taken = found.select(row, F.col(f"{name}.copies").alias(copies)).where(F.col(copies) > 0)
    return numbered.join(taken, row).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*documents.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", word_size(F.col("text")).alias("words"))
    found, name = mix_sources(documents, size_col="words")
    return found.select("doc_id", f"{name}.size", f"{name}.source_size", f"{name}.target", (F.col(f"{name}.copies") * F.col(f"{name}.size")).alias("taken"))
