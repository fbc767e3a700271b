"""Passages among edited copies and partial overlaps, by windows rather than nearest rows."""

import random

import pytest

from fabulagraph.llm import suffixes


def copies(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(150), 5):
            w[k] = word()
        rows.append((i, " ".join(w)))
    for i in range(150, 250):  # partial overlaps
        k = rng.randrange(90)
        rows.append((i, " ".join([word() for _ in range(9)] + base[k : k + rng.randint(48, 60)] + [word() for _ in range(9)])))
    return rows


@pytest.mark.parametrize("rows", [suffixes.ROWS, 64])
def test_edited_copies(spark, make, rows):
    docs = copies()
    want = suffixes.brute_force(docs)
    got = {i: set() for i, _ in docs}
    for r in suffixes.matches(make(docs).select("doc_id", "text"), rows=rows).collect():
        assert r.partner != r.doc_id
        got[r.doc_id].update(range(r.first, r.end))
    assert got == want


def test_op8_finds_what_nearest_rows_miss(make):
    docs = copies(8)
    want = suffixes.brute_force(docs)
    got = {r.doc_id: r for r in suffixes.op8(make(docs)).collect()}
    assert {i: {x for s in got[i].spans.split(",") if s for x in range(*map(int, s.split(":")))} for i, _ in docs} == want
    assert all(got[i].n_repeated == len(want[i]) for i, _ in docs)


def decoys(seed):
    """Two documents share 50 words around a gram; others share what follows it, or what precedes it."""
    rng = random.Random(seed)
    word = lambda n: [f"d{rng.randrange(10**6)}" for _ in range(n)]
    left, gram, right, x, y = word(21), word(8), word(21), word(30), word(30)
    rows = [(0, x + left + gram + right + y), (1, word(30) + left + gram + right + word(30))]
    rows += [(10 + i, word(30) + gram + right + y) for i in range(12)]
    rows += [(30 + i, x + left + gram + word(30)) for i in range(12)]
    return [(i, " ".join(w)) for i, w in rows]


def test_decoys(spark, make):
    docs = [(1000 * s + i, t) for s in range(50) for i, t in decoys(s)]
    want = suffixes.brute_force(docs)
    assert all(len(want[1000 * s + 1]) >= 50 for s in range(50))
    got = {r.doc_id: r for r in suffixes.op8(make(docs)).collect()}
    assert {i: {x for p in got[i].spans.split(",") if p for x in range(*map(int, p.split(":")))} for i, _ in docs} == want


def test_hot_grams_are_dealt_over_tasks(spark, make):
    rng = random.Random(6)
    word = lambda n: [f"h{rng.randrange(10**6)}" for _ in range(n)]
    line = word(60)
    docs = [(i, " ".join(word(rng.randrange(30)) + line[: rng.randint(45, 60)] + word(rng.randrange(60)))) for i in range(400)]
    hot = suffixes.hot_grams(make(docs).select("doc_id", "text"), rows=100).collect()
    assert hot and all(r.parts >= 2 for r in hot)
    want = suffixes.brute_force(docs)
    got = {i: set() for i, _ in docs}
    for r in suffixes.matches(make(docs).select("doc_id", "text"), rows=100).collect():
        got[r.doc_id].update(range(r.first, r.end))
    assert got == want
