import random
import textwrap
import time

from helpers import documents, random_text, words

from plinth.llm import licenses
from plinth.llm.licenses import PHRASES, TEMPLATES, scan_licenses


def brute(rows, threshold=0.8):
    out = []
    for doc_id, text, *_ in rows:
        w, starts, base, labels, best = words(text), [], set(), set(), 0.0
        for phrase, label in PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += at
            if at:
                base.add(label)
        for line in (text or "").split("\n"):
            own = set(words(line))
            for label, notice in TEMPLATES:
                n = set(notice.split())
                shared = len(n & own) / len(n)
                if shared >= threshold - 1e-9:
                    labels.add(label)
                    best = max(best, shared)
        out.append((doc_id, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if starts else best))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, random_text(rng, rng.randrange(0, 30)), "en", "s") for i in range(30)]
    for i in range(120):
        label, notice = TEMPLATES[i % len(TEMPLATES)]
        w = notice.split()
        for _ in range(rng.randrange(0, 5)):
            w.pop(rng.randrange(len(w))) if len(w) > 1 else None
        rng.shuffle(w)
        rows.append((100 + i, f"{random_text(rng, 4)}\n{' - '.join(w).upper()} {random_text(rng, 3)}\n{random_text(rng, 5)}", "en", "s"))
    rows += [(900, "MIT\nLicense; mit license mit, license", "en", "s"), (901, None, None, None), (902, "", "", ""), (903, "general public license " * 5000, "en", "s"), (904, "smit license apache licenses", "en", "s"), (None, "Apache  License", None, None), (900, "mit", "en", "s")]
    found, name = scan_licenses(documents(spark, rows))
    got = found.select("doc_id", f"{name}.n_words", f"{name}.n_base", f"{name}.first_word", f"{name}.last_word", f"{name}.base_labels", f"{name}.labels", f"{name}.score").collect()
    assert sorted((tuple(r[:7]) for r in got), key=repr) == [x[:7] for x in brute(rows)]
    scores, wanted = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in got), sorted((x[0] is None, x[0] or 0, x[7]) for x in brute(rows))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(scores, wanted, strict=True))


def test_empty_table(spark):
    assert scan_licenses(documents(spark, []))[0].count() == 0


def labels(spark, texts):
    found, name = scan_licenses(documents(spark, [(i, x, "en", "s") for i, x in enumerate(texts)]))
    return [(r["labels"], r["score"]) for r in found.select("doc_id", f"{name}.labels", f"{name}.score").orderBy("doc_id").collect()]


def test_wrapped_notices_are_found(spark):
    rng = random.Random(9)
    for leader in ("", "# ", " * ", "REM "):
        texts = [f"{random_text(rng, 30)}\n\n{textwrap.fill(notice.capitalize(), 72, initial_indent=leader, subsequent_indent=leader)}\n\n{random_text(rng, 30)}" for _, notice in TEMPLATES]
        for (label, _), (found, score) in zip(TEMPLATES, labels(spark, texts), strict=True):
            assert label in found.split(",") and score == 1.0


def test_scattered_words_of_a_long_line_are_no_notice(spark):
    rng = random.Random(10)
    far = lambda notice: " ".join(f"{w} {random_text(rng, 40)}" for w in notice.split())
    assert labels(spark, [far(notice) for _, notice in TEMPLATES]) == [("", 0.0)] * len(TEMPLATES)


def test_windows_equal_brute_force(spark):
    rng = random.Random(11)
    pool = sorted({w for _, notice in TEMPLATES for w in notice.split()})
    texts = []
    for i in range(200):
        w = TEMPLATES[i % len(TEMPLATES)][1].split()
        for _ in range(rng.randrange(0, 8)):
            w.insert(rng.randrange(len(w) + 1), rng.choice([*pool, "x1", "x2", "x3"]))
        for _ in range(rng.randrange(0, 4)):
            w.pop(rng.randrange(len(w)))
        texts.append("".join(x + rng.choice(" \n") for x in [*rng.choices(pool, k=5), *w, *rng.choices(pool, k=5)]))
    for text, (found, score) in zip(texts, labels(spark, texts), strict=True):
        w, wanted, best = words(text), {label for phrase, label in PHRASES.items() if f" {phrase} " in f" {' '.join(words(text))} "}, 0.0
        best = 1.0 if wanted else 0.0
        for label, notice in TEMPLATES:
            n, width = set(notice.split()), -(-len(notice.split()) * 5 // 4)
            shared = max(len(n & set(w[i : i + width])) for i in range(len(w))) / len(n)
            if shared >= 0.8 - 1e-9:
                wanted.add(label)
                best = max(best, shared)
        assert (found, round(score, 9)) == (",".join(sorted(wanted)), round(best, 9))


def test_hundreds_of_templates_with_wrapped_notices(spark):
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(400)]
    templates = [(f"l{i}", " ".join(rng.choices(pool, k=rng.randrange(3, 60)))) for i in range(300)] + [("none", "..."), ("none", "")]
    texts = []
    for i in range(90):
        w = templates[rng.randrange(300)][1].split()
        for _ in range(rng.randrange(0, 1 + len(w) // 4)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        texts.append(textwrap.fill(" ".join([*rng.choices(pool, k=rng.randrange(40)), *w, *rng.choices(pool, k=rng.randrange(40))]), 60, initial_indent="# ", subsequent_indent="# "))
    texts += ["", None, texts[0], " ".join(rng.choices(pool, k=3000))]
    frame = spark.createDataFrame(templates, "label string, notice string")
    found, name = scan_licenses(documents(spark, [(i, x, "en", "s") for i, x in enumerate(texts)]), frame, {})
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in found.select("doc_id", f"{name}.labels", f"{name}.score").collect()}
    for i, text in enumerate(texts):
        w, wanted, best = words(text), set(), 0.0
        for label, notice in templates[:300]:
            n, width = set(notice.split()), -(-len(notice.split()) * 5 // 4)
            shared = max((len(n & set(w[j : j + width])) for j in range(len(w))), default=0) / len(n)
            if shared >= 0.8 - 1e-9:
                wanted.add(label)
                best = max(best, shared)
        assert got[i] == (",".join(sorted(wanted)), round(best, 9))


def test_the_plan_does_not_grow_with_the_templates(spark):
    docs = documents(spark, [(1, "a b c", "en", "s")])
    nodes = [scan_licenses(docs, [(f"l{i}", f"word{i} other{i} third{i}") for i in range(n)])[0]._jdf.queryExecution().optimizedPlan().treeString().count("\n") for n in (2, 200)]
    assert nodes[0] == nodes[1]


def test_notices_of_a_thousand_words(spark):
    """Full license texts are long: the cost of one that is really there may only grow with its words."""
    rng = random.Random(13)
    common, pool = [f"c{i}" for i in range(50)], [f"w{i}" for i in range(20_000)]
    templates = [(f"l{i}", " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(pool) for _ in range(1000))) for i in range(5)] + [("short", "all rights reserved")]
    texts, wanted = [], []
    for i in range(200):
        label, notice = templates[i % 5]
        w = notice.split()
        for _ in range(rng.choice([0, 50, 400])):
            w[rng.randrange(1000)] = rng.choice(pool)
        texts.append(" ".join([*rng.choices([*pool, *common], k=1500), *w, *rng.choices([*pool, *common], k=1500)]))
        own, n, best = words(texts[-1]), set(notice.split()), 0
        counts, here = {}, 0
        for j, x in enumerate(own):  # a plain sliding count
            if x in n:
                counts[x] = counts.get(x, 0) + 1
                here += counts[x] == 1
            if j >= 1250 and own[j - 1250] in n:
                counts[own[j - 1250]] -= 1
                here -= counts[own[j - 1250]] == 0
            best = max(best, here)
        wanted.append((label, round(best / len(n), 9)) if best >= 0.8 * len(n) - 1e-9 else ("", 0.0))
    docs = documents(spark, [(i, x, "en", "s") for i, x in enumerate(texts)])
    began = time.monotonic()
    found, name = scan_licenses(docs, spark.createDataFrame(templates, "label string, notice string"), {})
    got = [(r["labels"], round(r["score"], 9)) for r in found.select("doc_id", f"{name}.labels", f"{name}.score").orderBy("doc_id").collect()]
    assert time.monotonic() - began < 60
    assert got == wanted and {x for x, _ in wanted} == {"", "l0", "l1", "l2", "l3", "l4"}


def test_many_template_words_are_joined_by_shuffle(spark, monkeypatch):
    texts = ["x all rights reserved y", "licensed under the apache license version 2 0", "rights all of it reserved", None]
    wanted = labels(spark, texts)
    for name in ("MOST_SENT", "MOST_LOOKED_UP"):
        monkeypatch.setattr(licenses, name, 0)
    assert labels(spark, texts) == wanted
