"""The pipeline's stages against plain Python, and its run against its stages."""

import random

import corpus_pipeline
from fabulagraph.llm import decontaminate, secrets
from tests.llm.test_documents import brute_components
from tests.llm.test_native import mix_brute, spans_of


def corpus(seed=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["the", "ing", "er", "an", "st", "on"], k=3))
    rows = [(i, " ".join(word() for _ in range(rng.randint(20, 80))), "en", f"s{i % 3}") for i in range(80)]
    item = " ".join(word() for _ in range(30))
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1] + " more", "en", "s1"), (102, item + " x", "en", "s2"), (103, "a " * 30 + "password=abcdefghijklmnop1234", None, None),
             (104, None, "en", "s0"), (105, " 12 ", "en", "s0"), (106, "", None, "s1"), (5, rows[5][1], "en", "s9")]
    return rows, [(1, item), (2, "short one")]


def test_stages_and_run(spark, tmp_path):
    rows, items = corpus()
    full = [(*r, len(r[1] or ""), "extra") for r in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "secret_scan", "source_mixing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = docs.collect()
        if name == "ngram_join":
            keep = {int(d) for d, _, c in brute_components([r[:2] for r in want]) if d == c}
            want = list({r[0]: r for r in sorted(want, key=lambda r: r[3] or "", reverse=True) if r[0] in keep}.values())
        if name == "decontamination":
            bad = {i for i, v in decontaminate.brute_force([r[:2] for r in want], items).items() if v[4]}
            assert 102 in bad
            want = [r for r in want if r[0] not in bad]
        if name == "secret_scan":
            hidden = {r.doc_id: r for r in got}[103]
            assert spans_of(rows[83][1]) and hidden.text == "a " * 30 + "[secret]" and hidden.n_chars == len(hidden.text) and hidden.lang == "en"
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in want), name
    assert {100, 101, 102, 104, 105, 106}.isdisjoint(r.doc_id for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size, per, target = mix_brute([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in want) and sum(r["size"] for r in out) == sum(size)
    assert abs(sum(r.taken for r in out) - sum(target.values())) <= len(target)
    assert secrets.RULES[0].kind == "assign"


def test_empty(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
