"""Quality checks of batch ML data sets: identity, leakage, references, balance, fingerprints and admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import in_polygon

#: Hex digits of one lane of a fingerprint; four lanes use 60 of a digest's 64 digits.
LANE_DIGITS, LANES = 15, 4
EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9]+[.][A-Za-z]+"


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with the number of rows after the first. Null is an id like any other."""
    return df.groupBy(key).agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def repeated_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content a row with a smaller key has, with that key. Digests are reduced before the join, so a large group of copies is one row of its right side."""
    digested = df.where(F.col(content).isNotNull()).select(key, F.sha2(content, 256).alias("digest"))
    first = digested.groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return digested.join(first, "digest").where(F.col(key) > F.col("first")).select(key, "first")


def leaking_groups(df: DataFrame, group: Column, split: Column) -> DataFrame:
    """Groups that stand in more than one split, with those splits."""
    found = df.select(group.alias("group"), split.alias("split")).where("group IS NOT NULL")
    return found.groupBy("group").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def missing_references(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key no parent has."""
    return child.join(parent.select(key), key, "left_anti")


def box_inside(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column, slack: float = 1.0) -> Column:
    """Whether a box has an extent and lies in its image, up to slack pixels."""
    low = (x >= -slack) & (y >= -slack)
    return low & (width > 0) & (height > 0) & (x + width <= image_width + slack) & (y + height <= image_height + slack)


def class_balance(df: DataFrame, split: Column, label: str, classes: Sequence[str]) -> DataFrame:
    """Per split: a count for each class of the manifest, the number of absent classes, and the largest over the smallest present count."""
    counted = df.select(split.alias("split"), F.col(label).alias("label")).groupBy("split").pivot("label", list(classes)).count()
    counts = [F.coalesce(F.col(c), F.lit(0)) for c in classes]
    out = counted.select("split", *[n.alias(f"n_{c}") for n, c in zip(counts, classes, strict=True)])
    each = F.array(*[F.col(f"n_{c}") for c in classes])
    present = F.filter(each, lambda n: n > 0)
    return out.withColumns({"absent": F.size(F.filter(each, lambda n: n == 0)).cast("long"), "ratio": F.array_max(present) / F.array_min(present)})


def fingerprint(df: DataFrame, *columns: Column) -> DataFrame:
    """A digest of the rows as a multiset, in one mergeable aggregate: lanes of each row's SHA-256 are added, so neither order nor partitioning matters and nothing is sorted or gathered."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)
    lane = lambda i: F.sum(F.conv(F.substring("row", 1 + i * LANE_DIGITS, LANE_DIGITS), 16, 10).cast("decimal(20,0)"))
    sums = df.select(row.alias("row")).agg(F.count("*").alias("n"), *[F.coalesce(lane(i), F.lit(0)).cast("string").alias(f"lane{i}") for i in range(LANES)])
    return sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[f"lane{i}" for i in range(LANES)]), 256).alias("fingerprint"))


def locked(found: DataFrame, expected: str) -> DataFrame:
    """The fingerprint with whether it equals the one that a lock names."""
    return found.withColumn("locked", F.col("fingerprint") == F.lit(expected))


def admitted_groups(df: DataFrame, key: str, vouched: Column) -> DataFrame:
    """Groups all of whose rows are vouched for; an unknown verdict counts against the group."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(vouched, F.lit(False))).alias("admitted"))


def without_pii(df: DataFrame, text: str) -> DataFrame:
    """The accessor of stages after the privacy gate: rows whose text names an address never reach them; null has none."""
    return df.where(~F.coalesce(F.col(text).rlike(EMAIL), F.lit(False)))


def selected_by_share(df: DataFrame, key: str, area: str, wanted: Column, banned: Column, low: float, high: float) -> DataFrame:
    """Keys without a banned segment whose wanted segments cover a share of the area within [low, high]."""
    share = F.sum(F.when(wanted, F.col(area)).otherwise(0.0)) / F.nullif(F.sum(area), F.lit(0.0))
    grouped = df.groupBy(key).agg(share.alias("share"), F.bool_or(F.coalesce(banned, F.lit(True))).alias("banned"))
    return grouped.where(~F.col("banned") & F.col("share").between(low, high)).select(key, "share")


def missing_outputs(df: DataFrame, key: str, kind: str, required: Sequence[str]) -> DataFrame:
    """Per run, the required kinds of output that it has not made, in the order of the contract."""
    made = df.groupBy(key).agg(F.collect_set(kind).alias("made"))
    return made.select(key, F.array_except(F.array(*map(F.lit, required)), "made").alias("missing"))


def next_stage(stages: Column, done: Column) -> Column:
    """The stage after done, null after the last; nothing done yet means the first."""
    return F.when(done.isNull(), F.get(stages, F.lit(0))).when(F.array_position(stages, done) > 0, F.get(stages, F.array_position(stages, done).cast("int")))


#: The stages of a full run, of a re-scan of one region, of one room and of a stitch of rooms, in order.
FULL = ["INPUT_VALIDATION", "FFMPEG_PREPROCESS", "FRAME_QUALITY_FILTER", "PRIVACY_PREPROCESS", "POSE_ESTIMATION", "SPLAT_RECONSTRUCTION", "SEMANTIC_SEGMENTATION", "GEOMETRIC_CLEANUP", "PLANE_FITTING", "ARTIFACT_GENERATION", "SEMANTIC_INDEXING", "NAVIGATION_BAKING"]
INCREMENTAL = ["INPUT_VALIDATION", "FFMPEG_PREPROCESS", "FRAME_QUALITY_FILTER", "PRIVACY_PREPROCESS", "POSE_ESTIMATION", "SPLAT_RECONSTRUCTION", "SEMANTIC_SEGMENTATION", "GEOMETRIC_CLEANUP", "REGION_ALIGNMENT", "REGION_SPLICE", "PLANE_FITTING", "ARTIFACT_GENERATION", "SEMANTIC_INDEXING", "NAVIGATION_BAKING"]
ROOM = ["INPUT_VALIDATION", "FFMPEG_PREPROCESS", "FRAME_QUALITY_FILTER", "PRIVACY_PREPROCESS", "POSE_ESTIMATION", "SPLAT_RECONSTRUCTION", "SEMANTIC_SEGMENTATION", "GEOMETRIC_CLEANUP", "PLANE_FITTING", "ARTIFACT_GENERATION"]
STITCH = ["ROOM_REGISTRATION", "ROOM_STITCH", "PLANE_FITTING", "ARTIFACT_GENERATION", "NAVIGATION_BAKING"]


def stage_plan(kind: Column, privacy: Column, navigation: Column) -> Column:
    """The stages of a run of kind FULL, INCREMENTAL, ROOM or STITCH (null for others): without the privacy stage where it was disabled, and, of a re-scan, without navigation where the parent has none."""
    plans = {"FULL": FULL, "INCREMENTAL": INCREMENTAL, "ROOM": ROOM, "STITCH": STITCH}
    every = F.coalesce(*[F.when(kind == name, F.array(*map(F.lit, stages))) for name, stages in plans.items()])
    return F.filter(every, lambda s: (privacy | (s != "PRIVACY_PREPROCESS")) & (navigation | (kind != "INCREMENTAL") | (s != "NAVIGATION_BAKING")))


def supersede_in_region(points: DataFrame, regions: DataFrame, cell: float = 2.0) -> DataFrame:
    """points: id, floor, source, deleted, x, y; regions: floor, version, ring (array of x, y). The points with superseded_by: the version of the smallest region of their floor that holds them, if they were detected and are not deleted; rings of fewer than three corners hold nothing.

    Regions cover the cells of their bounding box (cell: metres), and points meet the regions of their own cell only."""
    side = lambda f, a: F.floor(f(F.transform("ring", lambda v: v[a])) / cell).cast("long")
    rings = regions.where(F.size("ring") >= 3).select("floor", "version", "ring", F.explode(F.sequence(side(F.array_min, "x"), side(F.array_max, "x"))).alias("cx"))
    rings = rings.withColumn("cy", F.explode(F.sequence(side(F.array_min, "y"), side(F.array_max, "y"))))
    live = points.where("source = 'AUTO_DETECTED' AND NOT deleted").select("id", "floor", "x", "y", *[F.floor(F.col(a) / cell).cast("long").alias(f"c{a}") for a in "xy"])
    hit = live.join(rings, ["floor", "cx", "cy"]).where(in_polygon(F.col("x"), F.col("y"), F.col("ring"))).groupBy("id").agg(F.min("version").alias("superseded_by"))
    return points.join(hit, "id", "left")


#: What a rate card may hold.
CARD_FIELDS, CARD_KINDS, MOST_RATE, MOST_SOURCE = ("currency", "workerClasses", "storagePerGbMonth"), ("CLOUD_LIST_PRICE", "CLOUD_CONTRACT_RATE", "LOCAL_HARDWARE"), 1_000_000, 300


def rate_card_problem(card: Column) -> Column:
    """Why a rate card (JSON text) is invalid: the first of NOT_JSON, UNKNOWN_FIELD, CURRENCY, WORKER_CLASSES, CLASS_NAME, KIND, RATE, SOURCE; null if it is valid or blank."""
    rate, name = "struct<hourly:string,rate:string,kind:string,source:string>", r"^[A-Za-z0-9._:-]{1,100}$"
    fields, doc = F.json_object_keys(card), F.from_json(card, f"currency string, workerClasses map<string,{rate}>, storagePerGbMonth {rate}")
    classes = doc["workerClasses"]
    entries = F.map_values(classes)
    number = lambda v: v.try_cast("double")
    bad_rate = lambda v: ~F.coalesce(number(v).between(0, MOST_RATE), F.lit(False))
    bad_source = lambda s: ~F.coalesce(F.length(F.trim(s)).between(1, MOST_SOURCE), F.lit(False))
    storage = doc["storagePerGbMonth"]
    tests = {
        "NOT_JSON": fields.isNull(),
        "UNKNOWN_FIELD": F.size(F.array_except(fields, F.array(*map(F.lit, CARD_FIELDS)))) > 0,
        "CURRENCY": ~F.coalesce(F.regexp_like(doc["currency"], F.lit("^[A-Z]{3}$")), F.lit(False)),
        "WORKER_CLASSES": F.coalesce(F.size(F.map_keys(classes)), F.lit(0)) < 1,
        "CLASS_NAME": F.exists(F.map_keys(classes), lambda k: ~F.regexp_like(k, F.lit(name))),
        "KIND": F.exists(entries, lambda r: ~F.coalesce(r["kind"].isin(*CARD_KINDS), F.lit(False))),
        "RATE": F.exists(entries, lambda r: bad_rate(r["hourly"])) | (storage.isNotNull() & bad_rate(storage["rate"])),
        "SOURCE": F.exists(entries, lambda r: bad_source(r["source"])) | (storage.isNotNull() & bad_source(storage["source"])),
    }
    problem = F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()])
    return F.when(F.trim(F.coalesce(card, F.lit(""))) != "", problem)
