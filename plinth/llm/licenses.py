"""License scans: base phrases, and an exact set-similarity join of texts with license notices, in DataFrame functions only.

A text block is a window of words, wherever lines break: for a template of n words, every run of ceil(n / THRESHOLD)
words of the text, so up to a quarter more words (comment leaders, insertions) may stand between. A block meets a template when its
set of words holds at least THRESHOLD of the template's distinct words; `need` is their least number.

The join: template words get one global order, rarest first, by how many documents of the corpus have them. A block that meets a template T
must hold a word of its prefix, the first |T| - need + 1 words in that order (prefix filter). So places of prefix words in the
texts, (text, place, word), meet the prefixes of all templates, (template, word), on the word. Around each place, only as many words as a block of
that template can hold are looked at (length filter); overlapping stretches are joined into one. A stretch goes on if it holds at
least `need` places of the template's words (positional filter). What passes is counted exactly, and in time that is linear in its length: a place of a
template word adds one to the blocks that begin behind the word's place before it, and end behind the place; running sums over these
beginnings and ends are the distinct words of every block. So every block at the threshold is found, and a notice of a thousand words costs
what its words cost. Templates are a table, joined on words; the plan does not grow with them and no word comes to the driver. Up to
MOST_SENT words of the templates are broadcast (counted first); beyond, Spark shuffles by word. Equal texts share their result, by digest.

Cases: null text is empty. Repeated rows each get their row. Texts without words have n_words 0, no labels, null first
and last word and score 0. Base phrases and blocks both cross line breaks. Template words further apart than a window do not meet, however
long the line. Templates without words never match. No templates, or an empty table, leave the base phrases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, table, through_disk

THRESHOLD = 0.8
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License notices by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved"),
]
#: Rows of template words up to which they are broadcast, and words up to which texts are looked through for them one by one.
MOST_SENT, MOST_LOOKED_UP = 100_000, 1_000
#: More words than a text has.
MOST_WORDS = 1 << 30


def word_array(low: Column) -> Column:
    """The words of a lower-cased text, with an empty string before or after them where it does not begin or end with a word."""
    return F.split(low, NON_WORD)


def _digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _sent(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    return F.broadcast(df) if len(df.take(MOST_SENT + 1)) <= MOST_SENT else df


def ranked_templates(documents: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """templates (label, notice) by their distinct words: template, label, word, rank (from 0, rarest first), n (distinct words), need, width (words of a block)."""
    all_words = F.filter(word_array(lower_ascii(F.coalesce(F.col("notice"), F.lit("")))), lambda w: w != "")
    own = templates.select(F.monotonically_increasing_id().alias("template"), "label", all_words.alias("all")).where(F.size("all") > 0)
    sized = own.withColumn("distinct", F.array_distinct("all")).withColumn("n", F.size("distinct"))
    sized = sized.select("template", "label", "n", F.greatest(F.lit(1), F.ceil(threshold * F.col("n") - 1e-9).cast("int")).alias("need"), F.ceil(F.size("all") / max(threshold, 0.1) - 1e-9).cast("int").alias("width"), F.explode("distinct").alias("word"))
    each = through_disk(sized)
    vocabulary = through_disk(each.select("word").distinct())
    seen = documents.select(F.explode(F.array_distinct(word_array(lower_ascii(_text(text_col))))).alias("word")).join(_sent(vocabulary), "word", "left_semi")
    counts = seen.groupBy("word").agg(F.count("*").alias("seen"))
    order = Window.partitionBy("template").orderBy(F.coalesce("seen", F.lit(0)), "word")
    return through_disk(each.join(counts, "word", "left").withColumn("rank", F.row_number().over(order) - 1).drop("seen"))


def matched_texts(documents: DataFrame, ranked: DataFrame, text_col: str = "text") -> DataFrame:
    """key (digest of the text), labels (distinct) and score (the largest containment) of the texts in which a block meets a template."""
    prefixes = through_disk(ranked.where("rank <= n - need").select("word", "template", "width"))
    rare = through_disk(prefixes.select("word").distinct())
    tokens = documents.select(_text(text_col).alias("text")).withColumn("tokens", word_array(lower_ascii(F.col("text"))))
    if len(rare.take(MOST_LOOKED_UP + 1)) <= MOST_LOOKED_UP:  # most texts go before their words become rows; they would find no partner below either
        tokens = tokens.where(F.arrays_overlap("tokens", rare.agg(F.collect_list("word").alias("words")).scalar()))
    texts = through_disk(tokens.select(F.monotonically_increasing_id().alias("row"), _digest(F.col("text")).alias("key"), "tokens"))

    places = texts.select("row", F.posexplode("tokens").alias("at", "word")).join(_sent(prefixes), "word")
    in_turn = Window.partitionBy("row", "template").orderBy("at")
    apart = F.coalesce(F.col("at") - F.lag("at").over(in_turn) >= 2 * F.col("width"), F.lit(True))
    stretches = places.withColumn("apart", apart).withColumn("stretch", F.sum(F.col("apart").cast("int")).over(in_turn)).groupBy("row", "template", "stretch", "width").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    low = F.greatest(F.lit(0), F.col("low") - F.col("width") + 1)
    around = texts.join(stretches, "row").select("row", "key", "template", "stretch", low.alias("low"), F.posexplode(F.slice("tokens", low + 1, F.col("high") - low + F.col("width"))).alias("i", "word"))
    known = ranked.select("template", "word", "label", "n", "need", "width")
    hits = around.join(_sent(known), ["template", "word"]).withColumn("at", F.col("low") + F.col("i"))
    one = ["row", "key", "template", "stretch", "label", "n", "need"]
    enough = F.count("*").over(Window.partitionBy("row", "template", "stretch")) >= F.col("need")
    before = F.lag("at").over(Window.partitionBy("row", "template", "stretch", "word").orderBy("at"))
    first = F.greatest(F.col("at") - F.col("width"), F.coalesce(before, F.lit(-MOST_WORDS))) + 1  # the earliest block that counts this place
    turns = hits.withColumn("enough", enough).where("enough").withColumn("first", first).select(*one, F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("one")), F.struct((F.col("at") + 1).alias("at"), F.lit(-1).alias("one")))).alias("turn"))
    running = F.sum("turn.one").over(Window.partitionBy("row", "template", "stretch").orderBy("turn.at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    best = turns.select(*one, running.alias("shared")).groupBy("row", "key", "template", "label", "n", "need").agg(F.max("shared").alias("most")).where("most >= need")
    return best.groupBy("key").agg(F.collect_set("label").alias("labels"), F.max(F.col("most") / F.col("n")).alias("score"))


def scan_licenses(documents: DataFrame, templates=None, phrases=None, threshold: float = THRESHOLD, text_col: str = "text") -> tuple[DataFrame, str]:
    """documents with a struct column (n_words, n_base, first_word, last_word, base_labels, labels, score), and its name. templates: (label, notice) pairs or a DataFrame of them."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    if not isinstance(templates, DataFrame):
        templates = documents.sparkSession.createDataFrame(list(templates), "label string, notice string")
    matched = through_disk(matched_texts(documents, ranked_templates(documents, templates, threshold, text_col), text_col))
    name, low, tokens, key, hit = (fresh(documents, x) for x in ("licenses", "low", "tokens", "key", "hit"))
    df = documents.withColumn(low, lower_ascii(_text(text_col))).withColumn(tokens, word_array(F.col(low)))
    lead = F.when(F.get(F.col(tokens), 0) == "", 1).otherwise(0)

    def places(phrase: str) -> Column:
        parts = phrase.split()
        at = lambda i: reduce(lambda a, b: a & b, [F.get(F.col(tokens), i + j) == w for j, w in enumerate(parts)])
        found = F.array_compact(F.transform(F.col(tokens), lambda w, i: F.when((w == parts[0]) & at(i), i - lead)))
        # only a text that has its last word as a substring can hold the phrase; the others skip the arrays
        return F.when(F.contains(F.col(low), F.lit(parts[-1])), found).otherwise(F.array().cast("array<int>"))

    found = [(label, places(phrase)) for phrase, label in phrases.items()]
    a, key_text = fresh(documents, "found"), _text(text_col)
    df = df.withColumn(a, F.array(*[p for _, p in found]) if found else F.array().cast("array<array<int>>"))
    base = F.array_compact(F.array(*[F.when(F.size(F.get(F.col(a), i)) > 0, label) for i, (label, _) in enumerate(found)])) if found else F.array().cast("array<string>")
    every = F.flatten(F.col(a))
    ends = F.when(F.get(F.col(tokens), F.size(tokens) - 1) == "", 1).otherwise(0)
    own = F.struct(
        F.greatest(F.lit(0), F.size(tokens) - lead - ends).cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        base.alias("base"),
    )
    # the arrays end here, so that the join moves the documents' own columns and a few numbers
    df = df.withColumn(name, own).withColumn(key, _digest(key_text)).drop(low, tokens, a)
    df = df.join(matched.select(F.col("key").alias(key), F.struct("labels", "score").alias(hit)), key, "left")
    x = lambda field: F.col(f"{name}.{field}")
    labels = F.array_union(x("base"), F.coalesce(F.col(f"{hit}.labels"), F.array().cast("array<string>")))
    score = F.when(x("n_base") > 0, 1.0).otherwise(F.coalesce(F.col(f"{hit}.score"), F.lit(0.0)))
    result = F.struct(x("n_words"), x("n_base"), x("first_word"), x("last_word"), F.array_join(F.array_sort(F.array_distinct(x("base"))), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), score.alias("score"))
    return df.withColumn(name, result).select(*documents.columns, name), name


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", f"{name}.*")
