"""Evaluation metrics. Undefined metrics (nothing to divide by) are null."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import materialize
from .relational import running_sums


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count("*").alias("n"))


def class_iou(matrix: DataFrame) -> DataFrame:
    """Per class, what both say over what either says; each cell counts for the one or two classes it belongs to."""
    sides = F.array_distinct(F.array("truth", "said"))
    cells = matrix.select(F.explode(sides).alias("class"), "truth", "said", "n")
    both = F.sum(F.when(F.col("truth") == F.col("said"), F.col("n")).otherwise(0))
    return cells.groupBy("class").agg((both / F.sum("n")).alias("iou"))


def pixel_accuracy(matrix: DataFrame) -> DataFrame:
    return matrix.agg((F.sum(F.when(F.col("truth") == F.col("said"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def _resamples(df: DataFrame, key: str, columns: Sequence[str], statistic, n_boot: int, seed: int, alpha: float) -> DataFrame:
    """Percentile interval of a mean, from value counts: a resample of n values is a multinomial over the distinct values, so a task gets a group's histogram and not its rows."""
    counted = df.groupBy(F.col(key).alias("key"), *columns).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(columns), kind="stable")
        value, n = statistic(pdf), pdf["n"].to_numpy()
        total = int(n.sum())
        rng = np.random.default_rng(seed)
        means = np.array([rng.multinomial(total, n / total) @ value for _ in range(n_boot)]) / total
        low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "mean": [float(n @ value) / total], "low": [low], "high": [high]})

    return counted.groupBy("key").applyInPandas(run, f"key {counted.schema['key'].dataType.simpleString()}, mean double, low double, high double")


def bootstrap_interval(df: DataFrame, key: str, value: str, n_boot: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    return _resamples(df.where(F.col(value).isNotNull()), key, [value], lambda p: p[value].to_numpy(float), n_boot, seed, alpha)


def paired_bootstrap(df: DataFrame, key: str, a: str, b: str, n_boot: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Interval of mean(a - b), pairs being drawn together."""
    paired = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, (F.col(a) - F.col(b)).alias("gap"))
    return _resamples(paired, key, ["gap"], lambda p: p["gap"].to_numpy(float), n_boot, seed, alpha)


def _parts(rows: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """One row per key and part of the range sort: named aggregates over it."""
    return materialize(rows.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__part").alias("__at")).agg(*[x.alias(n) for n, x in sums.items()]))


def _with_parts(rows: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    same = F.col("__part") == F.col("__at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(parts, same).drop("__at", *[f"__of_{k}" for k in keys])


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hit: str) -> DataFrame:
    """keys, hit, __k (rank), __tp (hits so far) and __total of all rows. The range sort over keys and order is written once; its parts are ranked on their own and what lies before them is added, so a key's rows are not one task's."""
    one = F.coalesce(F.col(hit).cast("int"), F.lit(0))
    rows = df.orderBy(*keys, *order).select(*keys, hit, F.monotonically_increasing_id().alias("__row"))
    rows = materialize(rows.withColumn("__part", F.shiftright("__row", 33)))
    of = Window.partitionBy(*[f"__of_{k}" for k in keys])
    before = of.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    parts = _parts(rows, keys, __n=F.count("*"), __hits=F.sum(one))
    parts = parts.withColumns({"__n0": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__tp0": F.coalesce(F.sum("__hits").over(before), F.lit(0)), "__total": F.sum("__hits").over(of)}).drop("__n", "__hits")
    upto = Window.partitionBy(*keys, "__part").orderBy("__row")
    ranked = _with_parts(rows, parts, keys).withColumns({"__k": F.col("__n0") + F.row_number().over(upto), "__tp": F.col("__tp0") + F.sum(one).over(upto.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.drop("__n0", "__tp0")


def average_precision(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hit: str) -> DataFrame:
    """All-point interpolated: the precision envelope is a running maximum from the end, over the rows of a part and the maxima of the parts behind it."""
    ranked = materialize(_ranked(df, keys, order, hit).withColumn("__p", F.col("__tp") / F.col("__k")))
    behind = Window.partitionBy(*[f"__of_{k}" for k in keys]).orderBy(F.col("__at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = _parts(ranked, keys, __best=F.max("__p")).withColumn("__best", F.max("__best").over(behind))
    after = Window.partitionBy(*keys, "__part").orderBy(F.col("__row").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = _with_parts(ranked, parts, keys).withColumn("__envelope", F.greatest(F.max("__p").over(after), "__best"))
    return ranked.groupBy(*keys).agg((F.sum(F.when(F.col(hit), F.col("__envelope")).otherwise(0.0)) / F.nullif(F.max("__total"), F.lit(0))).alias("ap"))


def precision_recall(df: DataFrame, keys: Sequence[str], said: Column, truth: Column) -> DataFrame:
    both = F.count_if(said & truth)
    return df.groupBy(*keys).agg((both / F.nullif(F.count_if(said), F.lit(0))).alias("precision"), (both / F.nullif(F.count_if(truth), F.lit(0))).alias("recall"))


def retrieval_metrics(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hit: str, k: int) -> DataFrame:
    """Queries without a relevant result are left out."""
    near = F.sum(F.when(F.col("__k") <= k, F.col(hit).cast("int")).otherwise(0))
    total = F.max("__total")
    return _ranked(df, keys, order, hit).where("__total > 0").groupBy(*keys).agg(
        (near / total).alias(f"recall_at_{k}"), (near / k).alias(f"precision_at_{k}"), (F.sum(F.when(F.col(hit), F.col("__tp") / F.col("__k")).otherwise(0.0)) / total).alias("ap"))


def weighted_vote(votes: DataFrame, point: str, klass: str, weight: str, least: float, share: float, unknown: object) -> DataFrame:
    """The class with the most weight (ties: the lowest), unknown below a least weight or share."""
    sums = votes.groupBy(point, klass).agg(F.sum(weight).alias("__w"))
    best = sums.groupBy(point).agg(F.max(F.struct(F.col("__w").alias("w"), (-F.col(klass)).alias("k"))).alias("__b"), F.sum("__w").alias("__total"))
    sure = (F.col("__b.w") >= least) & (F.try_divide("__b.w", "__total") >= share)
    return best.select(point, F.when(sure, -F.col("__b.k")).otherwise(unknown).alias(klass))


def counts_by(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(kind, value, n) of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in columns.items()]))
    return df.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def search_scores(results: DataFrame, kind: str, q: str, order: Sequence[Column], hit: str) -> DataFrame:
    ranked = results.withColumn("__k", F.row_number().over(Window.partitionBy(kind, q).orderBy(*order)))
    each = ranked.groupBy(kind, q).agg(F.bool_or(F.col(hit) & (F.col("__k") == 1)).alias("t1"), F.bool_or(F.col(hit) & (F.col("__k") <= 5)).alias("t5"))
    return each.groupBy(kind).agg(F.count("*").alias("queries"), (F.count_if("t1") / F.count("*")).alias("top1"), (F.count_if("t5") / F.count("*")).alias("top5"))


def calibrate_threshold(scores: DataFrame, score: str, good: str) -> DataFrame:
    """The threshold (score >= t) of best balanced accuracy, the lowest on ties. Counts per distinct score come first, so the running sums see no raw rows."""
    counts = scores.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(good)).alias("p"), F.count_if(~F.col(good)).alias("n"))
    summed = running_sums(counts, [F.col("threshold").desc()], {"tp": "p", "fp": "n"})
    summed = summed.crossJoin(F.broadcast(counts.agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))))  # one row
    return summed.withColumn("balanced", F.round((F.col("tp") / F.nullif("pp", F.lit(0)) + 1 - F.col("fp") / F.nullif("nn", F.lit(0))) / 2, 9)).orderBy(F.col("balanced").desc(), "threshold").limit(1)


def jaccard(a: Column, b: Column) -> Column:
    return F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0))
