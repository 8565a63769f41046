"""Hybrid search over points of interest: query reading on the driver (one string), everything about the points in Spark."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Synonym groups; the first entry names the group.
SYNONYMS = [
    ["stairs", "staircase", "stairway", "stairwell", "steps", "stair"],
    ["elevator", "lift", "elevators", "lifts"],
    ["escalator", "escalators", "moving stairs"],
    ["restroom", "toilet", "toilets", "restrooms", "bathroom", "bathrooms", "washroom", "lavatory", "wc", "loo"],
    ["entrance", "entry", "way in", "front door", "entrances"],
    ["exit", "way out", "exits"],
    ["emergency exit", "fire exit", "emergency door"],
    ["reception", "reception desk", "front desk", "check-in", "check in"],
    ["information desk", "info desk", "help desk", "information point", "information kiosk"],
    ["sofa", "couch", "settee", "loveseat", "sofas", "couches"],
    ["chair", "chairs"],
    ["table", "tables"],
    ["bench", "benches"],
    ["plant", "plants", "houseplant", "potted plant"],
    ["cafe", "coffee shop", "coffee bar", "cafeteria"],
    ["atm", "cash machine", "cashpoint", "cash point"],
    ["cloakroom", "coat check", "coatroom", "cloak room"],
    ["first aid", "first aid station", "first aid kit", "medical station"],
    ["water fountain", "drinking fountain", "drinking water"],
    ["meeting room", "conference room", "meeting rooms"],
    ["fire extinguisher", "extinguisher"],
    ["trash can", "bin", "rubbish bin", "garbage can", "waste bin"],
    ["parking", "car park", "parking lot"],
]
#: Phrases that ask for the nearest place, and for an accessible one.
NEAREST = ["closest", "nearest", "nearby", "near me", "close by", "closest to me", "nearest to me", "near here", "around here"]
ACCESSIBLE = ["wheelchair accessible", "wheelchair friendly", "wheelchair access", "accessible for wheelchairs", "accessible by wheelchair", "for wheelchairs", "for wheelchair users", "step free", "barrier free", "disabled access", "handicap accessible", "accessible"]
#: Phrases around the subject of a request.
LEADING = ["where is", "where s", "wheres", "where are", "where can i find", "where do i find", "where can i get", "how do i get to", "how can i get to", "how to get to", "take me to", "navigate to", "directions to", "guide me to", "get me to", "go to", "show me", "find me", "find", "locate", "search for", "look for", "looking for", "i need", "i want", "i m looking for", "im looking for", "is there", "are there", "the", "a", "an", "some", "any", "my", "to"]
TRAILING = ["please", "here", "in here", "in this building", "located", "pls"]
#: Words that are never corrected and never corrected into, beside those of the phrases above.
FUNCTION_WORDS = ["and", "or", "of", "for", "with", "in", "on", "at", "near", "from", "me", "is", "are", "can"]
PROTECTED = sorted({w for phrases in (NEAREST, ACCESSIBLE, LEADING, TRAILING, FUNCTION_WORDS) for p in phrases for w in p.split(" ")})
#: Fixed values of the ranking.
MARGIN, LEAST_PEERS, LEXICAL_MIN, LEXICAL_WEIGHT, EVIDENCE_WEIGHT, CANDIDATES, FOLD_METRES, LOW_CONFIDENCE, FALLBACK_MIN = 0.078, 8, 0.5, 0.05, 0.05, 200, 0.75, 0.5, 0.2


def _plain(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text).lower()))


_MEMBERS = {_plain(m): [_plain(x) for x in group] for group in SYNONYMS for m in group}


@dataclass
class Request:
    normalized: str
    subject: str
    terms: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    nearest: bool = False
    accessible: bool = False
    typed: str = ""
    corrections: dict[str, str] = field(default_factory=dict)


def interpret(query: str, correct: Callable[[list[str]], dict[str, str]] | None = None, inflect: Callable[[str], list[str]] | None = None) -> Request:
    """Reads one query string: modifiers out, request phrases off both ends, misspelt words corrected, synonyms and inflections of what is left.

    correct: corrections of words, where there are any; inflect: the singular and plural forms of a word that the venue uses."""
    normalized = _plain(query)
    rest, flags = f" {normalized} ", []
    for phrases in (NEAREST, ACCESSIBLE):
        hit = False
        for p in sorted(phrases, key=lambda x: (-len(x), x)):
            if f" {p} " in rest:
                hit, rest = True, rest.replace(f" {p} ", " ")
        flags.append(hit)
    rest = rest.strip()
    changed = True
    while changed:
        changed = False
        for p in sorted(LEADING, key=lambda x: (-len(x), x)):
            if rest.startswith(f"{p} "):
                rest, changed = rest[len(p) + 1 :], True
        for p in sorted(TRAILING, key=lambda x: (-len(x), x)):
            if rest.endswith(f" {p}"):
                rest, changed = rest[: -len(p) - 1], True
    typed = rest or normalized
    fixes = correct(typed.split(" ")) if correct else {}
    subject = " ".join(fixes.get(w, w) for w in typed.split(" "))
    terms, groups, left = [subject, typed], [], f" {subject} "
    for member in sorted(_MEMBERS, key=lambda m: (-len(m), m)):  # a phrase within a longer one that was found is not its own
        if f" {member} " in left:
            group = _MEMBERS[member]
            if group[0] not in groups:
                groups.append(group[0])
            terms += [f" {subject} ".replace(f" {member} ", f" {other} ").strip() for other in group]
            left = left.replace(f" {member} ", " ")
    terms += inflect(subject) if inflect else []
    return Request(normalized, subject, list(dict.fromkeys(terms)), groups, *flags, typed, fixes)


def read_requests(asked: DataFrame, column: str) -> DataFrame:
    """The same reading for a table of queries, without spelling: normalized, nearest, accessible and subject of each row."""
    text = F.concat(F.lit(" "), F.col("normalized"), F.lit(" "))
    for phrases in (NEAREST, ACCESSIBLE):
        text = F.regexp_replace(text, rf"(?<= )(?:{'|'.join(sorted(phrases, key=lambda p: (-len(p), p)))})(?= )", " ")
    plain = F.trim(F.regexp_replace(text, " +", " "))
    lead, trail = ("|".join(sorted(x, key=lambda p: (-len(p), p))) for x in (LEADING, TRAILING))
    subject = F.regexp_replace(F.regexp_replace(plain, rf"^(?:(?:{lead}) )+", ""), rf"(?: (?:{trail}))+$", "")
    read = asked.withColumn("normalized", T.normalize(F.col(column))).withColumn("subject", subject)
    return read.withColumn("subject", F.when(F.col("subject") == "", F.col("normalized")).otherwise(F.col("subject"))).withColumns({"nearest": asks_nearest(F.col("normalized")), "accessible": asks_accessible(F.col("normalized"))})


def _group_map(of: str) -> Column:
    """Literal map from a member to its group's name or to all its members: 23 small groups."""
    pairs = []
    for member, group in _MEMBERS.items():
        pairs += [F.lit(member), F.lit(group[0]) if of == "name" else F.array(*map(F.lit, group))]
    return F.create_map(*pairs)


def expand_synonyms(term: Column) -> Column:
    """All members of the term's group, or the term alone."""
    return F.coalesce(_group_map("members")[term], F.array(term))


def synonym_group(label: Column) -> Column:
    """The group of a label: as a whole, else by its last word."""
    names = _group_map("name")
    return F.coalesce(names[label], names[F.element_at(F.split(label, " "), -1)])


def asks_nearest(text: Column) -> Column:
    return T.contains_any(text, NEAREST)


def asks_accessible(text: Column) -> Column:
    return T.contains_any(text, ACCESSIBLE)


def correct_spelling(asked: DataFrame, column: str, dictionary: DataFrame, word: str) -> DataFrame:
    """Each asked word with its correction: the one dictionary word nearest within 1 edit (5 to 7 letters) or 2 (8 or more).

    Never corrected are dictionary words, their singulars and plurals, protected words and words with digits; never corrected into are protected words and words under 4 letters.

    Deleting up to two letters of either side maps words within two edits to a shared key (a swap costs one deletion on each side), so the
    candidates come from an equi-join; the exact distance follows."""
    cut = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substr(w, i + 1))))

    def keys(w: Column) -> Column:
        once = cut(w)
        return F.array_distinct(F.concat(F.array(w), once, F.flatten(F.transform(once, lambda x: F.when(F.length(x) > 0, cut(x)).otherwise(F.array().cast("array<string>"))))))

    words = dictionary.select(F.col(word).alias("w")).distinct()
    typed = asked.select(F.col(column).alias("asked")).distinct()
    a = F.col("asked")
    forms = F.array_compact(F.array(a, F.concat(a, F.lit("s")), F.concat(a, F.lit("es")), F.when(a.endswith("s") & (F.length(a) > 3), F.substr(a, F.lit(1), F.length(a) - 1)), F.when(a.endswith("es") & (F.length(a) > 4), F.substr(a, F.lit(1), F.length(a) - 2))))
    known = typed.withColumn("w", F.explode(forms)).join(words, "w", "left_semi").select("asked")
    unknown = typed.join(known, "asked", "left_anti").where((F.length("asked") >= 5) & ~a.isin(PROTECTED) & ~F.regexp_like("asked", F.lit(r"\d")))
    pairs = unknown.withColumn("k", F.explode(keys(F.col("asked")))).join(words.where((F.length("w") >= 4) & ~F.col("w").isin(PROTECTED)).withColumn("k", F.explode(keys(F.col("w")))), "k").select("asked", "w").distinct()
    near = pairs.withColumn("edits", T.osa_distance(F.col("asked"), F.col("w"))).where(F.col("edits") <= F.when(F.length("asked") >= 8, 2).otherwise(1))
    least = near.groupBy("asked").agg(F.min("edits").alias("least"))
    best = near.join(least, "asked").where("edits = least").groupBy("asked").agg(F.min("w").alias("w"), F.count("*").alias("n")).where("n = 1")
    return typed.join(best, "asked", "left").select("asked", F.coalesce("w", "asked").alias("corrected"))


def score_points(points: DataFrame, text_query: Sequence[float] | None, terms: Sequence[str], label_vectors: Sequence[Sequence[float]] = (), in_filter: Column | None = None) -> DataFrame:
    """points: id, label, category, tags, embedding, image_embedding, confidence, views. Adds similarity, lexical, tier, evidence, score and relevant.

    The mean similarity is over distinct vectors of all points in scope: in_filter removes points only after it is taken."""
    vector = F.array(*[F.lit(float(x)) for x in text_query]) if text_query is not None else F.lit(None).cast("array<double>")
    similarity = V.cosine_similarity(F.col("embedding"), vector)
    scope = points.withColumn("similarity", similarity)
    stats = scope.where("embedding IS NOT NULL").select("embedding", "similarity").dropDuplicates(["embedding"]).agg(F.avg("similarity").alias("mean"), F.count("*").alias("peers"))
    document = F.concat_ws(" ", "label", "category", F.concat_ws(" ", "tags"))
    accepted = F.array(*[F.lit(t) for t in terms])
    lexical = T.strict_word_similarity(list(terms), document)
    weak = F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(False))
    exact = F.array_contains(accepted, T.normalize(F.col("label"))) | F.array_contains(accepted, T.normalize(F.col("category")))
    tagged = F.coalesce(F.arrays_overlap(accepted, F.transform("tags", T.normalize)), F.lit(False))
    evidence = F.coalesce(F.col("confidence"), F.lit(1.0)) * F.when(F.coalesce("views", F.lit(3)) >= 3, 1.0).when(F.col("views") == 2, 0.75).otherwise(0.5)
    image = F.lit(None).cast("double")
    best_label = F.lit(None).cast("double")
    if label_vectors and text_query is not None:
        image = V.cosine_similarity(F.col("image_embedding"), vector)
        best_label = F.array_max(F.transform(F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in label_vectors]), lambda v: V.cosine_similarity(F.col("image_embedding"), v)))
    scored = scope.crossJoin(F.broadcast(stats)).withColumns({
        "lexical": lexical, "evidence": evidence, "tier": F.when(weak, 0).when(exact, 2).when(tagged, 1).otherwise(0),
        "by_text": F.coalesce((F.col("peers") >= LEAST_PEERS) & (F.col("similarity") - F.col("mean") >= MARGIN), F.lit(False)),
        "by_image": F.coalesce((image >= best_label) & F.lit(len(label_vectors) >= 2) & ~weak, F.lit(False)),
        "unjudged": F.col("similarity").isNotNull() & (F.col("peers") < LEAST_PEERS)})
    scored = scored.withColumn("by_lexical", F.col("lexical") >= LEXICAL_MIN).withColumn("score", F.col("similarity") + LEXICAL_WEIGHT * F.col("lexical") + EVIDENCE_WEIGHT * (F.col("evidence") - 1))
    scored = scored.withColumn("relevant", F.col("by_text") | F.col("by_image") | F.col("by_lexical") | F.col("unjudged"))
    return scored if in_filter is None else scored.where(in_filter)


def matched_by(synonym: Column | None = None) -> Column:
    by_synonym = F.lit(False) if synonym is None else synonym
    return F.when(F.col("by_text") & F.col("by_image"), "TEXT_AND_IMAGE").when(F.col("by_text"), "TEXT").when(F.col("by_image"), "IMAGE").when(by_synonym, "SYNONYM").when(F.col("by_lexical"), "LEXICAL")


RANKING = ["tier", "score", "lexical", "similarity", "evidence"]


def ranked(scored: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    order = [*(F.col(c).desc_nulls_last() for c in RANKING), F.col("id")]
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over at most `limit` rows


def fold_duplicates(results: DataFrame, metres: float = FOLD_METRES) -> DataFrame:
    """Keeps, in rank order, a detected result unless a kept one of its floor and group lies within `metres`. results: at most the candidate limit."""
    schema = results.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"], kind="stable")
        kept: list[tuple[float, float]] = []
        keep = []
        for foldable, x, y in zip(pdf["foldable"], pdf["x"], pdf["y"], strict=True):
            near = bool(foldable) and any((x - a) ** 2 + (y - b) ** 2 <= metres**2 for a, b in kept)
            keep.append(not near)
            if not near and foldable:
                kept.append((x, y))
        return pdf[keep]

    return results.groupBy("floor", "fold_group").applyInPandas(run, schema)


def vocabulary(points: DataFrame) -> DataFrame:
    """word: the words of all labels, categories and tags."""
    return points.select(F.explode(F.split(T.normalize(F.concat_ws(" ", "label", "category", F.concat_ws(" ", "tags"))), " ")).alias("word")).where("word <> ''").distinct()


def read_request(points: DataFrame, query: str) -> Request:
    """interpret() with the spelling and the inflections of the venue's own words; only words of five letters and more ask the venue."""
    spark, words = points.sparkSession, vocabulary(points)

    def correct(asked: list[str]) -> dict[str, str]:
        doubtful = [(w,) for w in set(asked) if len(w) >= 5 and w not in PROTECTED]
        if not doubtful:
            return {}
        synonyms = spark.createDataFrame([(w,) for m in _MEMBERS for w in m.split(" ")], "word string")
        found = correct_spelling(spark.createDataFrame(doubtful, "asked string"), "asked", words.union(synonyms), "word")
        return {r["asked"]: r["corrected"] for r in found.where("asked <> corrected").collect()}  # of one query's words

    def inflect(subject: str) -> list[str]:
        if " " in subject or not subject:
            return []
        forms = [f"{subject}s", f"{subject}es", *([subject[:-1]] if subject.endswith("s") and len(subject) > 3 else []), *([subject[:-2]] if subject.endswith("es") and len(subject) > 4 else [])]
        have = {r["word"] for r in words.where(F.col("word").isin(forms)).collect()}  # at most four
        return [x for x in forms if x in have]

    return interpret(query, correct, inflect)


def hybrid_search(points: DataFrame, query: str, text_query: Sequence[float] | None, top_k: int = 10, accessible_column: str | None = None, label_vectors: Sequence[Sequence[float]] = (), position: tuple[float, float] | None = None) -> DataFrame:
    """The ranked answer to one query: relevant points, best first. points: id, label, category, tags, embedding, image_embedding, confidence, views and, to be folded or ordered by nearness, floor, x, y.

    The request is read with the venue's spelling and inflections. Without a vector, and if nothing is relevant, trigrams of the label decide (matched_by LEXICAL).
    Detected results of one kind on one spot are folded into the best. A request for the nearest orders the candidates by their distance to `position`."""
    top_k = max(1, min(50, top_k))
    request = read_request(points, query)
    keep = F.col(accessible_column).isNull() | F.col(accessible_column) if request.accessible and accessible_column else None
    scored = score_points(points, text_query, request.terms, label_vectors, keep)
    synonyms = [t for t in request.terms if t not in (request.subject, request.typed)]
    by_synonym = T.contains_any(T.normalize(F.concat_ws(" ", "label", "category")), synonyms) if synonyms else None
    found = ranked(scored.where("relevant")).withColumn("matched_by", matched_by(by_synonym))
    if text_query is None:
        similar = T.trigram_similarity(F.lit(request.subject), F.col("label"))
        lexical = scored.withColumn("similarity", similar).where((similar > FALLBACK_MIN) | F.contains(F.lower("label"), F.lit(request.subject)))
        found = ranked(lexical.withColumn("score", F.col("similarity"))).withColumn("matched_by", F.lit("LEXICAL"))
    if {"floor", "x", "y"} <= set(points.columns):
        kind = F.coalesce(synonym_group(T.normalize(F.col("label"))), T.merge_key(F.col("label")))
        found = fold_duplicates(found.withColumn("fold_group", kind).withColumn("foldable", F.col("confidence").isNotNull())).drop("fold_group", "foldable")
        if request.nearest and position is not None:
            found = found.withColumn("distance", F.hypot(F.col("x") - position[0], F.col("y") - position[1]))
            return found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("distance").asc_nulls_last(), "rank", "id"))).where(F.col("rank") <= top_k)  # over the candidates
    return found.withColumn("rank", F.row_number().over(Window.orderBy("rank", "id"))).where(F.col("rank") <= top_k)


def lexical_fallback(points: DataFrame, term: str, least: float = FALLBACK_MIN) -> DataFrame:
    """Without an embedding: trigram similarity of the label, or containment in it."""
    similarity = T.trigram_similarity(F.lit(term), F.col("label"))
    contained = F.contains(F.lower("label"), F.lit(term.lower()))
    return points.withColumn("similarity", similarity).where((F.col("similarity") > least) | contained).orderBy(F.desc("similarity"), "id")
