"""Plain Python versions of what several tests need, and small tables."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"

#: Columns that operators might want for themselves.
CLASHES = "key string, row long, near string, n long, size string, copies long, cell int, language string, contamination string, repeats string, mix string, licenses string, low string"
CLASH_VALUES = ("k", 1, "x", 2, "s", 3, 4, "l", "c", "r", "m", "w", "o")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, rows):
    """rows: (doc_id, text, lang, source), with clashing columns after them."""
    return spark.createDataFrame([(*r, *CLASH_VALUES) for r in rows], f"doc_id long, text string, lang string, source string, {CLASHES}")


def random_text(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"{rng.choice('aBcdÉ')}{rng.randrange(vocabulary)}" for _ in range(n))


def write_tables(tmp_path, **frames):
    for name, frame in frames.items():
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
