"""Relational building blocks that Spark SQL has no single call for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graphs import materialize


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order (`DISTINCT ON`)."""
    rank = "__rank"
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def placed(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Every row with its number from 1 in a total order over the whole table. The range sort is written once and its parts are counted, so no task holds more than a part."""
    rows = materialize(df.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()))
    rows = rows.withColumns({"__part": F.shiftright("__row", 33), "__row": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(counts), "__part").select(*df.columns, (F.col("__before") + F.col("__row") + 1).alias(name))


def in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, rows: int = 50_000) -> DataFrame:
    """What run makes of many whole groups at once: it gets their rows, group by group and each in the order asked, and where the groups begin. For groups of a few rows, of which a call for each would cost more than its work. A task holds some `rows` rows, or its largest group."""

    def begins(held: pa.Table) -> np.ndarray:
        new = np.zeros(held.num_rows, bool)
        for k in keys:
            code = held.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.r_[0, np.flatnonzero(new)]

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    made = lambda held: pa.RecordBatch.from_pandas(run(held.to_pandas(), begins(held)), kinds, preserve_index=False)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < rows:
                continue
            held = pa.concat_tables(waiting)
            cut = int(begins(held)[-1])  # the last group may go on in the next batch
            if cut:
                yield made(held.slice(0, cut))
            waiting, size = [held.slice(cut)], 0  # as many rows again before the next look
        if waiting and (held := pa.concat_tables(waiting)).num_rows:
            yield made(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(parts, schema)


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """df with the running sum of each column in sums (new name: column) in a total order over the whole table, and no window over all of it: parts of the range sort are summed on their own, and the sums of the parts before are added."""
    rows = materialize(df.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    parts = rows.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    upto = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(F.broadcast(parts), "__part").select(*df.columns, *[(F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"__{n}")).alias(n) for n, c in sums.items()])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the exact percentiles of value at the shares, interpolated; null without a value. Equal values are counted first, and running sums over the range-sorted counts tell which of them lie at the places asked, so no task holds the values of a key."""
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(value).alias("__n"))
    ranked = materialize(running_sums(counts, [*[F.col(k) for k in keys], F.col("__v")], {"__upto": "__n"}))
    of = ranked.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(F.sum("__n").alias("__all"), F.max("__upto").alias("__end"))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    both = ranked.join(of, reduce(and_, same)) if keys else ranked.crossJoin(F.broadcast(of))  # one row
    upto = F.col("__upto") - F.col("__end") + F.col("__all")  # within the key
    at = {name: share * (F.col("__all") - 1) for name, share in shares.items()}
    holds = lambda place: (place >= upto - F.col("__n")) & (place < upto)
    ends = {f"__{end}_{name}": F.max(F.when(holds(cut(place)), F.col("__v"))) for name, place in at.items() for end, cut in (("low", F.floor), ("high", F.ceil))}
    found = both.groupBy(*keys).agg(F.max("__all").alias("__all"), *[v.alias(n) for n, v in ends.items()])
    low, high = (lambda name: F.col(f"__low_{name}")), (lambda name: F.col(f"__high_{name}"))
    between = lambda name, place: (F.ceil(place) - place) * low(name) + (place - F.floor(place)) * high(name)
    return found.select(*keys, *[F.when(low(name) == high(name), low(name)).otherwise(between(name, place)).alias(name) for name, place in at.items()])


def lateral_first(outer: DataFrame, inner: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Each outer row with the first inner row of its key, or nulls: the inner side is ranked once, not once per outer row."""
    return outer.join(first_per_key(inner, keys, order), list(keys), "left")


def lateral_aggregate(outer: DataFrame, inner: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], zero: Sequence[str] = ()) -> DataFrame:
    """Each outer row with aggregates over its inner rows; the columns in zero are 0 where there are none."""
    found = outer.join(inner.groupBy(*keys).agg(*aggregates), list(keys), "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def exists_flag(outer: DataFrame, inner: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """EXISTS as a column: one distinct key row per match, so no outer row is multiplied."""
    return outer.join(inner.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def zero_filled_counts(df: DataFrame, column: str, domain: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per value of a closed domain, 0 for values that never occur."""
    values = df.sparkSession.createDataFrame([(x,) for x in domain], f"{column} string")
    return values.join(df.groupBy(column).agg(F.count("*").alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last write wins by key: the row with the highest version of both tables."""
    return first_per_key(old.unionByName(new), keys, [F.col(version).desc()])


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old, and the first new row of each key that old does not have."""
    return old.unionByName(new.join(old, list(keys), "left_anti").dropDuplicates(list(keys)))


def update_from(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: columns take the matching change's value where it has one. changes has one row a key."""
    renamed = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = target.join(renamed, list(keys), "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def next_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """A copy of the latest row of each key under the following version number (INSERT ... SELECT)."""
    return first_per_key(df, keys, [F.col(version).desc()]).withColumn(version, F.col(version) + 1)


def merge_top(parts: Sequence[DataFrame], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of several ordered lists, of each of which the first n are enough."""
    merged = parts[0].orderBy(*order).limit(n)
    for part in parts[1:]:
        merged = merged.unionByName(part.orderBy(*order).limit(n))
    return merged.orderBy(*order).limit(n)


def clamp_limit(asked: int | None, default: int, most: int) -> int:
    return max(1, min(most, default if asked is None else asked))


def interval_join(points: DataFrame, events: DataFrame, key: str, at: str, event_at: str, reach: float) -> DataFrame:
    """Pairs of the same key with |at - event_at| <= reach: equal or neighbouring buckets of width reach, then the exact test."""
    left = points.withColumn("__bucket", F.explode(F.array(*[F.floor(F.col(at) / reach) + d for d in (-1, 0, 1)])))
    right = events.withColumn("__bucket", F.floor(F.col(event_at) / reach))
    return left.join(right, [key, "__bucket"]).where(F.abs(F.col(at) - F.col(event_at)) <= reach).drop("__bucket")


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Callable[[Callable[[str], Column]], Column], name: str = "segment") -> DataFrame:
    """Gaps and islands: breaks(previous) says from a row and its predecessor's columns whether a new segment starts."""
    window = Window.partitionBy(*keys).orderBy(*order)
    flag = F.coalesce(breaks(lambda c: F.lag(c).over(window)), F.lit(True)).cast("int")
    return df.withColumn("__break", flag).withColumn(name, F.sum("__break").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def json_boolean(variant: Column, path: str) -> Column:
    """A JSON boolean, null for anything else: the string "true" is no boolean."""
    value = F.try_variant_get(variant, path, "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(variant, path, "boolean"))


def changed_besides(old: str, new: str, columns: Sequence[str], ignored: Sequence[str]) -> Column:
    """Whether two versions of a row (struct columns) differ in a column that is not ignored, nulls being equal."""
    kept = [c for c in columns if c not in ignored]
    return ~F.struct(*[F.col(f"{old}.{c}").alias(c) for c in kept]).eqNullSafe(F.struct(*[F.col(f"{new}.{c}").alias(c) for c in kept]))
