"""Text expressions: normalising, trigrams, edit distance."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalize(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(StringType())  # a type object: the module loads before any session
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC with curly quotes made straight; Spark has no such function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).replace("’", "'").replace("‘", "'").replace("“", '"').replace("”", '"'))


def merge_key(label: Column) -> Column:
    """Labels that differ in case and spacing only are one."""
    return F.regexp_replace(F.trim(F.lower(label)), r"\s+", " ")


def word_trigrams(text: Column) -> Column:
    """The set of three-grams of each word, lower-cased and padded with two blanks before and one after."""
    words = F.filter(F.split(normalize(text), " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all three-grams; 0 if neither has any."""
    x, y = word_trigrams(a), word_trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def _grams(words: list[str]) -> set[str]:
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def _best_run(own: set[str], words: list[str]) -> float:
    best = 0.0
    for i in range(len(words)):
        run: set[str] = set()
        for w in words[i:]:
            run |= _grams([w])
            best = max(best, len(own & run) / len(own | run))
    return best


def strict_word_similarity(terms: list[str] | str, text: Column) -> Column:
    """The best similarity of any of the terms with a run of whole words of text: one Arrow call per batch, each different text read once."""
    wanted = [_grams(re.findall(r"[^\W_]+", x.lower())) for x in ([terms] if isinstance(terms, str) else terms)]
    wanted = [x for x in wanted if x]

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        found = {x: max((_best_run(own, re.findall(r"[^\W_]+", x.lower())) for own in wanted), default=0.0) for x in texts.dropna().unique()}
        return texts.map(found).fillna(0.0)

    return run(text)


def _osa(a: str, b: str, most: int) -> int | None:
    """Optimal string alignment distance: a swap of neighbours counts one; None beyond `most`."""
    if abs(len(a) - len(b)) > most:
        return None
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > most:
            return None
        before, row = row, now
    return row[-1] if row[-1] <= most else None


def osa_distance(a: Column, b: Column, most: int = 2) -> Column:
    """Null beyond most. Spark's levenshtein counts a swap as two, hence the Arrow UDF; call it behind a filter on lengths."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _osa(p, q, most) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def strip_phrases(text: Column, phrases: list[str]) -> Column:
    """Leading and trailing phrases go, the longest first, until none is left."""
    ordered = "|".join(sorted(phrases, key=lambda p: (-len(p), p)))
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"^(?:(?:{ordered})(?: |$))+", ""), rf"(?:(?:^| )(?:{ordered}))+$", ""))


def ordered_distinct(phrases: Column) -> Column:
    """Phrases without repeats in any case, the first spelling kept."""
    empty = F.array().cast("array<string>")
    return F.aggregate(phrases, empty, lambda seen, p: F.when(F.exists(seen, lambda s: F.lower(s) == F.lower(p)), seen).otherwise(F.array_append(seen, p)))


def is_inflection(a: Column, b: Column) -> Column:
    """The same word, one perhaps with s or es."""
    return (a == b) | F.concat(a, F.lit("s")).eqNullSafe(b) | F.concat(a, F.lit("es")).eqNullSafe(b) | F.concat(b, F.lit("s")).eqNullSafe(a) | F.concat(b, F.lit("es")).eqNullSafe(a)


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whole-word containment, by padding with blanks."""
    return reduce(lambda p, q: p | q, [F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {x} ")) for x in phrases])


def hash_share(seed: str, group: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of sha256(seed:group): the same for a group wherever it is computed."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), group), 256), 1, 12)
    return F.conv(head, 16, 10).cast("double") / float(16**12)


def split_of(seed: str, group: Column, train: float = 0.70, validation: float = 0.15) -> Column:
    share = hash_share(seed, group)
    return F.when(share < train, "train").when(share < train + validation, "val").otherwise("test")


