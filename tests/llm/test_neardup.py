import random

from helpers import documents, random_text, words

from plinth.llm.neardup import depth_for, drop_near_duplicates, with_classes


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    near = [[bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b) - 1e-12 for b in sets] for a in sets]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near[i][j]:
                parent[root(i)] = root(j)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(root(i), []).append(r[0])
    smallest = {k: min(v, key=lambda x: (x is None, x or 0)) for k, v in first.items()}
    return sorted(((r[0], smallest[root(i)], sum(near[i]) - near[i][i]) for i, r in enumerate(rows)), key=repr)


def case():
    rng = random.Random(7)
    base = [random_text(rng, rng.randrange(30, 120), 3000).split() for _ in range(15)]
    rows = [(i, " ".join(b), "en", "s") for i, b in enumerate(base)]
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w), "en", "s"))
    rows += [(300, "one two", "en", "s"), (301, "One  TWO!", "en", "s"), (302, "one", None, None), (303, None, None, None), (304, "", None, None), (305, "", None, None), (306, "...", None, None)]
    return [*rows, (400, rows[0][1], "en", "s"), (401, rows[0][1], "en", "s"), (402, random_text(rng, 20_000), "en", "s")]


def test_classes_and_links_equal_brute_force(spark):
    rows = case()
    # a small block makes several block pairs; short signatures would lose links, so the recall is the production one
    found, name = with_classes(documents(spark, rows), block=4)
    assert sorted((tuple(r) for r in found.select("doc_id", f"{name}.class_id", f"{name}.n_links").collect()), key=repr) == brute(rows)


def test_one_document_of_each_class_stays(spark):
    rows = case()
    docs = documents(spark, rows)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted({c for _, c, _ in brute(rows)})


def test_repeated_rows_and_null_ids(spark):
    text = random_text(random.Random(1), 30)
    docs = documents(spark, [(None, text, None, None), (None, text, None, None), (7, text, None, None), (7, text, None, None), (8, None, None, None), (None, "w x y", None, None)])
    kept = sorted((r[0] for r in drop_near_duplicates(docs).select("doc_id").collect()), key=repr)
    assert kept == sorted([7, 8, None], key=repr)


def test_empty_table_and_depth(spark):
    assert drop_near_duplicates(documents(spark, [])).count() == 0
    depth = depth_for(0.8, 16, 8, 0.999)
    assert 1 - (1 - 0.8**depth) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 16
