import pytest
from pyspark.sql import functions as F

from fabulagraph.functions import text as T
from fabulagraph.functions.oracle import ReplayOracle, prompt_hash
from fabulagraph.operators import graph as G
from fabulagraph.operators import tables as R
from fabulagraph.plans.story import resolved
from fabulagraph.sources import files


@pytest.fixture
def edges(spark):
    rows = [(1, "a", "b", "x", True, 1), (1, "b", "c", "y", True, 2), (1, "c", "a", "x", False, 3), (1, "c", "d", "z", True, 4), (1, "b", "a", "w", True, 5)]
    return spark.createDataFrame(rows, "run_id int, src string, dst string, label string, active boolean, edge_id int").withColumn("visibility", F.lit(1))


def test_levels_and_cut_points(spark, edges):
    hub = spark.createDataFrame([(1, "a")], "run_id int, node string")
    assert {r.node: r.distance for r in G.bfs_levels(edges, hub).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in G.cut_points(edges).collect()} == {"b", "c"}
    assert G.bfs_levels(edges.limit(0), hub).count() == 1


def test_scores_and_listings(spark, edges):
    nodes = spark.createDataFrame([(1, "a", "TEXT_BASED", True), (1, "b", "INFERENCE_BASED", False), (1, "d", "TEXT_BASED", False)], "run_id int, node string, source string, active boolean")
    got = {r.node: round(r.score, 2) for r in G.node_scores(nodes, edges).collect()}
    assert got == {"a": 3 * 2 + 5 + 8 + round(5 / 3, 2), "b": round(3 * 3 + 20 + 15 + 10 / 3, 2), "d": round(3 + 5 + 5 / 3, 2)}
    assert [r.node for r in G.removal_candidates(G.node_scores(nodes, edges), 2).collect()] == ["d"]
    assert G.edge_listing(edges).first()["edges"].split("\n")[0] == "1. a - x (edge) - b"
    assert [r.node for r in G.by_degree(edges).orderBy("place").collect()] == ["a", "b", "c", "d"]
    m = spark.createDataFrame([(1, "k", "the knight", 1), (1, "k", "Knight", 2), (1, "k", "Knight", 3)], "run_id int, node string, text string, seen int")
    assert G.representers(m).first()["text"] == "Knight"


def test_curves(spark, edges):
    got = {r.edge_id: (r.curvature, r.t) for r in G.curvatures(edges).collect()}
    assert got == {1: (0.15, 0.4), 5: (0.15, 0.6), 2: (0.0, 0.5), 3: (0.0, 0.5), 4: (0.0, 0.5)}
    angle = spark.range(1).select(G.label_angle(*[F.lit(float(x)) for x in (0, 0, -1, 0, 0, 0.5)])).first()[0]
    assert abs(angle) in (0.0, 180.0)
    line = spark.createDataFrame([(1, "h", 0.0, 0.0), (1, "a", 1.0, 0.0), (1, "b", 2.0, 0.0)], "run_id int, node string, x double, y double")
    assert {r.node: (r.x, round(r.y, 2)) for r in G.nudged(line).collect()} == {"h": (0.0, 0.0), "a": (1.0, 0.0), "b": (2.0, 0.3)}


def test_distinct_meanings(spark):
    rows = [(1, "Knight", "is", "brave", "ADJ"), (1, "knight", "has", "bravery", "NOUN"), (1, "knight", "has", "horse", "NOUN"), (1, "king", "has", "sad", "ADJ"), (1, "king", "is", "sadness", "NOUN")]
    t = spark.createDataFrame(rows, "run_id int, subject string, relation string, object string, object_pos string")
    assert {r.object for r in R.distinct_meanings(t, ["run_id"]).collect()} == {"brave", "horse", "sadness"}


def test_more_text(spark):
    t = F.lit
    prefix, number = T.prefix_and_sentence(t("x_y_sent12.png"))
    row = spark.range(1).select(
        prefix, number, T.age_by_grade(t("in 7th grade")), T.age_by_grade(t("a high school sophomore")), T.completed_age(t(None).cast("double"), t("a pupil")), T.relation_or_null(t("--")),
        T.nodes_line("inactive", F.array(t(" a"), t(""))), T.not_a_pupil(t("A former student of art")), T.not_a_pupil(t("A student")), T.not_a_pupil(t("my teacher")), T.before_final(t("primary_FINAL_x")),
    ).first()
    assert list(row) == ["x_y", 12, 12, 15, 8, None, "inactive: a", True, False, True, "primary"]
    assert R.profile(spark.range(5), "id").first()["median"] == 2.0


def test_pronouns():
    s = ["The knight came.", "He left."]
    o = ReplayOracle({("pronouns", prompt_hash("pronouns", {"sentence": s[1], "context": s[:1]})): {"He": "The knight"}})
    assert resolved(s, o) == ["The knight came.", "The knight left."]


def test_stats_of_files(spark, tmp_path):
    (tmp_path / "model_x_triplets_primary.csv").write_text("original_index,age_refined,persona_text,subject,relation,object,regime,sentence_index\n1,7,a b,s,is_a,o,other,1\n")
    assert files.persona_stats_of_files(spark, str(tmp_path / "model_*.csv")).first()["regime"] == "primary"
    (tmp_path / "model_odd.csv").write_text("original_index,age_refined,persona_text,subject,relation,object,regime,sentence_index\n1,7,a b,s,is_a,o,other,1\n")
    with pytest.raises(Exception, match="no regime"):
        files.persona_stats_of_files(spark, str(tmp_path / "model_odd.csv")).collect()


def test_embedding(spark):
    from fabulagraph.functions.embedding import embedded

    rows = spark.createDataFrame([("related to",), ("related  to",), (" ",), (None,)], "t string").select("t", embedded(F.col("t")).alias("e"))
    got = rows.collect()
    assert [r.e is None for r in got] == [False, False, True, True]
    assert abs(sum(x * x for x in got[0].e) - 1) < 1e-5
    assert rows.select(T.cosine(F.col("e"), F.col("e")).alias("c")).where("c is not null").first().c > 0.999
