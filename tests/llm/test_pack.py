import base64
import random

import numpy as np
import tiktoken
from helpers import documents, random_text

from plinth.llm.pack import END_TOKEN, PATTERN, TOKENIZER, RoomTree, _parts, best_fit, pack_tokens


def encoding():
    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_best_fit_equals_a_linear_search():
    rng = random.Random(2)
    lengths = np.array([rng.randrange(1, 33) for _ in range(300)])
    room, bins = [], []
    for p in np.argsort(-lengths, kind="stable").tolist():
        fits = [r for r in room if r >= lengths[p]]
        b = room.index(min(fits)) if fits else len(room)
        if not fits:
            room.append(32)
            bins.append([])
        room[b] -= int(lengths[p])
        bins[b].append(p)
    got = best_fit(lengths, 32)
    assert len(got) == len(bins) and sorted(p for b in got for p in b) == list(range(300))
    assert sorted(int(lengths[b].sum()) for b in got) == sorted(int(lengths[b].sum()) for b in bins)  # which of equal rooms is taken does not matter


def test_room_tree():
    tree = RoomTree(10)
    assert tree.at_least(0) == -1
    tree.add(3), tree.add(10)
    assert (tree.at_least(1), tree.at_least(4), tree.at_least(10)) == (3, 10, 10)


def test_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, random_text(rng, rng.randrange(0, 120)), "en", "s") for i in range(80)]
    rows += [(500, None, None, None), (501, "", "en", "s"), (502, "<|endoftext|> é\U0001f600", "en", "s"), (503, random_text(rng, 9000), "en", "s"), (504, "x" * 250_000, "en", "s"), (505, "word " * 60_000, "en", "s")]
    out = pack_tokens(documents(spark, rows), seq_len=128, block_tokens=5000).collect()
    assert len({r["pack_id"] for r in out}) == len(out)
    pieces = {}
    for r in out:
        ids = np.frombuffer(r["input_ids"], "<u2")
        ends = r["cu_seqlens"]
        assert len(ids) == 128 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 128 and r["position_resets"] == ends[:-1]
        assert (ids[r["n_tokens"] :] == END_TOKEN).all()
        for d, o, a, z in zip(r["doc_ids"], r["doc_offsets"], ends, ends[1:], strict=False):
            pieces.setdefault(d, []).append((o, ids[a:z].tolist()))
    enc = encoding()
    assert set(pieces) == {r[0] for r in rows}
    for doc_id, text, *_ in rows:
        joined, at = [], 0
        for o, ids in sorted(pieces[doc_id]):
            assert o == at
            joined, at = joined + ids, at + len(ids)
        assert joined[-1] == END_TOKEN and enc.decode(joined[:-1]) == (text or "")
        assert joined[:-1] == enc.encode_ordinary(text or "")


def test_parts_give_the_ids_of_the_whole():
    rng, enc = random.Random(6), encoding()
    for n in (1, 7, 50, 400):
        text = "".join(rng.choice(["ab", "1", " ", "  ", "\n", ".", "'s", "é", "\t ", "x", "\u00a0"]) for _ in range(n))
        for cut in (1, 3, 10, 50):
            parts = _parts(text, cut)
            assert "".join(parts) == text and [t for x in parts for t in enc.encode_ordinary(x)] == enc.encode_ordinary(text)


def test_repeats_null_ids_and_empty_table(spark):
    out = pack_tokens(documents(spark, [(1, "a b", None, None)] * 3 + [(None, "c", None, None)])).collect()
    assert sorted((d for r in out for d in r["doc_ids"]), key=repr) == sorted([1, 1, 1, None], key=repr)
    assert pack_tokens(documents(spark, [])).count() == 0
