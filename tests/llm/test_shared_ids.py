"""Near copies go by row, not by id, where unlike texts share an id."""

import random

import corpus_pipeline


def test_a_group_keeps_one_row_when_ids_repeat(spark, make):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, d = text(), text(), text()
    rows = [(1, a), (5, a), (5, b), (7, b), (8, d), (8, d), (9, text()), (None, text())]
    got = corpus_pipeline.drop_near_copies(spark, make(rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, rows[7][1]), (1, a), (5, b), (8, d), (9, rows[6][1])])
