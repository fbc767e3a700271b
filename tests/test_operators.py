import math
import random

import pytest
from pyspark.sql import functions as F

from fabulagraph.operators import graph as G
from fabulagraph.operators import metrics as M
from fabulagraph.operators import stats as S
from fabulagraph.operators import tables as R
from fabulagraph.operators.lineage import components
from fabulagraph.sources import files

GRAPHS = {
    "path": (["ab", "bc", "cd"], (4, 3, 1.5, 0.5, 1, 4)),
    "star": (["ab", "ac", "ad"], (4, 3, 1.5, 0.5, 1, 4)),
    "two components": (["ab", "cd", "de"], (5, 3, 1.2, 0.3, 2, 3)),
    "multi-edge": (["ab", "ab", "ba"], (2, 3, 1.0, 3.0, 1, 2)),
    "self-loop only": (["aa"], (1, 1, 1.0, 0.0, 1, 1)),
    "bridge": (["ab", "bc", "ca", "cd"], (4, 4, 2.0, 0.6667, 1, 4)),
    "blank endpoint": (["ab", "a"], (2, 1, 1.0, 1.0, 1, 2)),
}


def test_graph_metrics(spark):
    rows = [(name, e[0], e[1:]) for name, (edges, _) in GRAPHS.items() for e in edges] + [("path", None, "z")]
    got = {r["g"]: r for r in M.graph_metrics(spark.createDataFrame(rows, "g string, src string, dst string"), "g").collect()}
    names = "graph_num_nodes graph_num_edges graph_avg_degree graph_density graph_num_components graph_largest_component_size".split()
    for name, (_, want) in GRAPHS.items():
        assert tuple(round(got[name][n], 4) for n in names) == want, name


def test_components_of_a_long_path_and_none(spark):
    edges = spark.range(60).select(F.lit(1).alias("g"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = components(edges, "g")
    assert got.count() == 61 and got.select("component").distinct().collect()[0][0] == 0
    assert components(edges.limit(0), "g").count() == 0


def test_persona_stats_keeps_null_groups(spark):
    rows = [("p", None, "r", 1, 1, 5, "a", None, "b"), ("p", None, "r", 1, 2, 6, "a", "is_a", "b"), (None, "m", None, 2, 1, None, None, "causes", "c")]
    t = spark.createDataFrame(rows, "persona_text string, model_name string, regime string, original_index int, sentence_index int, age_refined int, subject string, relation string, object string")
    got = {r["persona_text"]: r for r in M.persona_stats(t).collect()}
    assert len(got) == 2
    assert (got["p"]["num_triplets"], got["p"]["num_unique_triplets"], got["p"]["num_unique_concepts"], got["p"]["age_refined"]) == (2, 2, 2, 5)
    assert got[None]["num_unique_subjects"] == 1 and got[None]["persona_num_tokens"] == 0 and got[None]["triplets_per_100_tokens"] == 0.0
    assert M.persona_stats(t.limit(0)).count() == 0


def test_statistics_with_nulls(spark):
    rows = [("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 4.0), ("d", "y", 9.0), ("e", None, None)]
    s = spark.createDataFrame(rows, "persona_id string, regime string, v double")
    assert {r[0] for r in S.quantile_trim(s, ["v"]).select("persona_id").collect()} == {"b", "c"}
    assert S.iqr_cap(s, ["v"]).where("v is null").count() == 1
    assert S.winsorize(s, "regime", "v", least=2).count() == 5
    assert S.kruskal(s, "v").first()["H"] == pytest.approx(2.4)
    assert S.regime_summary(s, ["v"]).count() == 8
    assert [r["y"] for r in S.ecdf(s, "v").where("regime = 'x'").orderBy("x").collect()] == [0.5, 1.0]
    ci = S.bootstrap_ci(s.where("regime is not null"), "v", times=300)
    assert ci.collect() == S.bootstrap_ci(s.where("regime is not null"), "v", times=300).collect()


def test_balanced_and_numbered(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 10, "a").otherwise("b").alias("g"))
    assert {r["g"]: r["count"] for r in R.balanced(rows, "g", "id").groupBy("g").count().collect()} == {"a": 10, "b": 10}
    assert [r["row_no"] for r in R.numbered(rows, "id").orderBy("id").collect()] == list(range(1, 101))


def test_paragraphs(spark):
    t = spark.createDataFrame([(1, 'x<t DRP="44.5">\n one <b>two</b>\n\n three<t DRP="7"> </t>'), (2, None)], "k int, text string")
    assert [(r.k, r.drp, r.paragraph) for r in R.paragraphs(t).collect()] == [(1, 44.5, "> one two three<t"), (1, 7.0, ">")]
    i = spark.createDataFrame([(1, "  one\ntwo\n<tag>\n  three\n\nfour")], "k int, text string")
    assert [r.paragraph for r in R.indented_paragraphs(i, "k").orderBy("island").collect()] == ["one two", "three four"]


def test_require(spark):
    df = spark.range(1)
    assert R.require(df, {"id"}) is df and R.require(df, {"x"}, "skip") is None and R.require(df, {"x"}, "empty").count() == 0
    with pytest.raises(ValueError):
        R.require(df, {"x"})


def test_bridging_and_focus(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "c", "d"), (1, "d", "e")], "run_id int, src string, dst string")
    assert [tuple(r)[1:3] for r in G.bridging_edges(e).collect()] == [("a", "c")]
    focus = spark.createDataFrame([(1, "a"), (1, "b")], "run_id int, node string")
    assert G.focus_component(e, focus).first()["component"] == "a"


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "r", "o", 1), (1, "s", "r", "o", 1)], "original_index int, subject string, relation string, object string, introduced_at int")
    out = str(tmp_path / "t")
    files.append_new(rows, out)
    files.append_new(rows, out)
    assert spark.read.parquet(out).count() == 1
    (tmp_path / "model_x_final_triplets_primary.csv").write_text('original_index,age_refined,persona_text,subject,object,regime,Unnamed: 0\n1,7,"a ""b"", c",s,o,primary,9\n')
    t = files.triplets(spark, str(tmp_path / "*.csv"))
    assert t.first()["persona_text"] == 'a "b", c' and "Unnamed: 0" not in t.columns and t.first()["relation"] == "<NO_RELATION>"
    assert files.of_model(t, "X").count() == 1


@pytest.mark.parametrize("most", [1 << 18, 7])
def test_components_in_tasks_and_rounds(spark, most):
    """Groups of all sizes, long paths, loops, nulls and clashing column names, with and without rounds."""
    rng = random.Random(most)
    rows = [(g, f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", "x") for g in range(6) for _ in range(rng.choice((1, 5, 30)))]
    rows += [(9, f"p{i:03d}", f"p{i + 1:03d}", "y") for i in range(60)] + [(10, "a", "a", "z"), (11, None, "b", "z"), (None, "a", "b", "z")]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for g, a, b, _ in rows:
        if g is not None and a is not None and b is not None:
            x, y = sorted((top((g, a)), top((g, b))))
            up[y] = x
    want = sorted((g, n, top((g, n))[1]) for g, n in up)
    edges = spark.createDataFrame(rows, "run_id int, src string, dst string, component string").repartition(3)
    got = sorted(tuple(r) for r in components(edges, "run_id", most=most).select("run_id", "node", "component").collect())
    assert got == want
    assert components(edges.limit(0), "run_id", most=most).count() == 0


def test_zscores_of_equal_medians_are_nan(spark):
    rows = [(g, 3, x) for g, x in (("a", 1), ("b", 2), ("c", 3))]
    got = {r.regime: (r.same, r.other) for r in S.regime_zscores(spark.createDataFrame(rows, "regime string, same int, other int"), ["same", "other"]).collect()}
    assert all(math.isnan(same) for same, _ in got.values())
    assert {g: round(x, 6) for g, (_, x) in got.items()} == {"a": -1.224745, "b": 0.0, "c": 1.224745}
