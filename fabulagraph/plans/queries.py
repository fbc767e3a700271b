"""Registered queries over the driver's tables, each with the same thing in DuckDB's SQL.

Doubles are rounded on both sides, since the order of sums differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulagraph.functions import lexicon as L
from fabulagraph.functions import text as T
from fabulagraph.operators import graph as G
from fabulagraph.operators import metrics as M
from fabulagraph.operators import stats as S
from fabulagraph.operators import tables as R
from fabulagraph.functions.gates import relation_verdict
from fabulagraph.functions.tagger import content_words, nouns, tokens
from fabulagraph.plans import views as V
from fabulagraph.plans.curation import curate
from fabulagraph.plans.curation import trimmed_stats as trim_plan
from fabulagraph.plans.story import read_stories

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

c = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str, name: str) -> Column:
    return F.round(x, 6).alias(name)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics, written once for plans that read them several times."""
    return S.kept(M.persona_stats(V.triplets(spark, d)))


def _words(n: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in n) + "]"


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query(f"WITH {V.V_STATS} SELECT persona_id, persona_text, model_name, regime, num_triplets, num_unique_triplets, num_unique_subjects, num_unique_objects,"
       " num_unique_concepts, num_unique_relations, original_index, age_refined, persona_num_tokens, round(triplet_repetition_ratio, 6) AS triplet_repetition_ratio,"
       " round(abstract_relation_ratio, 6) AS abstract_relation_ratio, round(triplets_per_100_tokens, 6) AS triplets_per_100_tokens FROM v_stats")  # fmt: skip
def persona_stats(spark, d):
    names = "persona_id persona_text model_name regime num_triplets num_unique_triplets num_unique_subjects num_unique_objects num_unique_concepts num_unique_relations original_index age_refined persona_num_tokens".split()
    return M.persona_stats(V.triplets(spark, d)).select(*names, *[r6(x, x) for x in ("triplet_repetition_ratio", "abstract_relation_ratio", "triplets_per_100_tokens")])


@query(f"""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_distinct(w)) / len(w) END, 6) AS lexical_ttr,
round(CASE WHEN len(w) = 0 THEN 0.0 ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w) END, 6) AS lexical_avg_word_len FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)""")
def lexical_metrics(spark, d):
    rows = _docs(spark, d).select("doc_id", T.tokens(c("text")).alias("w"))
    return rows.select("doc_id", r6(T.type_token_ratio(c("w")), "lexical_ttr"), r6(T.mean_length(c("w")), "lexical_avg_word_len"))


@query(f"""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE (len(list_filter(w, lambda x: list_contains({_words(L.POSITIVE)}, x))) - len(list_filter(w, lambda x: list_contains({_words(L.NEGATIVE)}, x)))) / len(w) END, 6) AS sentiment_score
FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)""")
def sentiment(spark, d):
    return _docs(spark, d).select("doc_id", T.tokens(c("text")).alias("w")).select("doc_id", r6(T.sentiment(c("w")), "sentiment_score"))


@query("SELECT doc_id, sha1(text) AS persona_id, source || '::' || doc_id AS persona_key FROM documents")
def persona_id(spark, d):
    return _docs(spark, d).select("doc_id", T.persona_id(c("text")).alias("persona_id"), T.persona_key(c("source"), c("doc_id")).alias("persona_key"))


@query(f"WITH {V.V_TRIPLETS} SELECT regime, CASE WHEN relation = 'is_a' THEN 'taxonomic' WHEN relation = 'causes' THEN 'causal' ELSE 'event' END AS relation_class, count(*) AS n FROM v_triplets GROUP BY ALL")
def relation_class_mix(spark, d):
    return V.triplets(spark, d).groupBy("regime", T.relation_class(c("relation")).alias("relation_class")).agg(F.count("*").alias("n"))


@query(f"""WITH {V.V_EDGES}, e AS (SELECT run_id, count(*) AS m FROM v_edges GROUP BY 1), g AS (SELECT run_id, node, count(*) AS d FROM v_both GROUP BY ALL),
n AS (SELECT run_id, count(*) AS n, avg(d) AS deg FROM g GROUP BY 1)
SELECT run_id, n AS graph_num_nodes, m AS graph_num_edges, round(deg, 6) AS graph_avg_degree, round(CASE WHEN n > 1 THEN 2 * m / (n * (n - 1)) ELSE 0.0 END, 6) AS graph_density FROM n JOIN e USING (run_id)""")
def graph_degree_density(spark, d):
    g = M.graph_metrics(V.edges(spark, d), "run_id", with_components=False)
    return g.select("run_id", "graph_num_nodes", "graph_num_edges", r6("graph_avg_degree", "graph_avg_degree"), r6("graph_density", "graph_density"))


_CC = """RECURSIVE {v}, b2 AS (SELECT * FROM v_both),
reach AS (SELECT run_id, node, node AS seen FROM b2 UNION SELECT r.run_id, r.node, b.near FROM reach r JOIN b2 b ON r.run_id = b.run_id AND r.seen = b.node),
cc AS (SELECT run_id, node, min(seen) AS component FROM reach GROUP BY ALL)"""


@query(f"WITH {_CC.format(v=V.V_EDGES)}, z AS (SELECT run_id, component, count(*) AS n FROM cc GROUP BY ALL)"
       " SELECT run_id, count(*) AS graph_num_components, max(n) AS graph_largest_component_size FROM z GROUP BY 1")  # fmt: skip
def graph_components(spark, d):
    g = M.graph_metrics(V.edges(spark, d), "run_id")
    return g.select("run_id", "graph_num_components", "graph_largest_component_size")


_Q = lambda m, q, t="v_stats": f"(SELECT quantile_cont({m}, {q}) FROM {t})"


@query(f"WITH {V.V_STATS} SELECT persona_id, num_triplets, num_unique_concepts FROM v_stats WHERE num_triplets BETWEEN {_Q('num_triplets', 0.05)} AND {_Q('num_triplets', 0.95)}"
       f" AND num_unique_concepts BETWEEN {_Q('num_unique_concepts', 0.05)} AND {_Q('num_unique_concepts', 0.95)}")  # fmt: skip
def quantile_trim(spark, d):
    return S.quantile_trim(_stats(spark, d), ["num_triplets", "num_unique_concepts"]).select("persona_id", "num_triplets", "num_unique_concepts")


@query(f"WITH {V.V_STATS} SELECT persona_id, round(least(num_triplets, {_Q('num_triplets', 0.75)} + 1.5 * ({_Q('num_triplets', 0.75)} - {_Q('num_triplets', 0.25)}))::DOUBLE, 6) AS num_triplets FROM v_stats")
def iqr_cap(spark, d):
    return S.iqr_cap(_stats(spark, d), ["num_triplets"]).select("persona_id", r6("num_triplets", "num_triplets"))


@query(f"""WITH {V.V_STATS}, q AS (SELECT regime, count(*) AS n, quantile_cont(num_triplets, 0.25) AS a, quantile_cont(num_triplets, 0.75) AS b FROM v_stats GROUP BY 1)
SELECT persona_id, regime, round(CASE WHEN n >= 5 AND b - a <> 0 THEN greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), num_triplets)) ELSE num_triplets END::DOUBLE, 6) AS num_triplets FROM v_stats JOIN q USING (regime)""")
def winsorize_by_regime(spark, d):
    return S.winsorize(_stats(spark, d), "regime", "num_triplets", least=5).select("persona_id", "regime", r6("num_triplets", "num_triplets"))


_SUM = ["num_triplets", "num_unique_concepts", "triplets_per_100_tokens"]


@query(f"WITH {V.V_STATS}, a AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS stat, regime, count(*) AS n, " + ", ".join(f"round_even({f.format(m=m)}, 3) AS {m}" for m in _SUM) + " FROM v_stats GROUP BY regime"
    for k, f in (("mean", "avg({m})"), ("median", "quantile_cont({m}, 0.5)"), ("std", "stddev_samp({m})"), ("iqr", "quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25)"))
) + ") SELECT * FROM a")
def regime_summary(spark, d):
    return S.regime_summary(_stats(spark, d), _SUM)


_RANKS = "r AS (SELECT *, rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2 AS k FROM v_stats)"


@query(f"""WITH {V.V_STATS}, {_RANKS.format(m="num_triplets")}, g AS (SELECT regime, count(*) AS n, sum(k) AS s FROM r GROUP BY 1),
t AS (SELECT sum(x * x * x - x) AS ties FROM (SELECT count(*)::DOUBLE AS x FROM v_stats GROUP BY num_triplets)), a AS (SELECT sum(n)::DOUBLE AS n, sum(s * s / n) AS s, count(*) AS groups FROM g)
SELECT 'num_triplets' AS metric, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS H, groups FROM a, t""")
def kruskal_h(spark, d):
    return S.kruskal(_stats(spark, d), "num_triplets").select("metric", r6("H", "H"), "groups")


_TESTED = ("num_triplets", "num_unique_concepts")


#: The chi-squared tail of four degrees of freedom, those of five segments, is elementary.
@query(f"WITH {V.V_STATS}, " + ", ".join(f"""r{i} AS (SELECT *, rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2 AS k FROM v_stats), g{i} AS (SELECT regime, count(*) AS n, sum(k) AS s FROM r{i} GROUP BY 1),
t{i} AS (SELECT sum(x * x * x - x) AS ties FROM (SELECT count(*)::DOUBLE AS x FROM v_stats GROUP BY {m})), a{i} AS (SELECT sum(n)::DOUBLE AS n, sum(s * s / n) AS s, count(*) AS groups FROM g{i})""" for i, m in enumerate(_TESTED))
    + " SELECT metric, groups, round(h, 6) AS H, round(exp(-h / 2) * (1 + h / 2), 9) AS p_value FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, groups, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM a{i}, t{i}" for i, m in enumerate(_TESTED)) + ")")
def kruskal_p(spark, d):
    stats = _stats(spark, d)
    rows = reduce(DataFrame.unionByName, [S.kruskal(stats, m) for m in _TESTED])
    return rows.select("metric", "groups", r6("H", "H"), F.round(S.chi2_tail(c("H"), c("groups") - 1), 9).alias("p_value"))


@query(f"WITH {V.V_STATS} SELECT 'num_triplets' AS a, 'num_unique_concepts' AS b, round(corr(num_triplets, num_unique_concepts), 6) AS r, count(*) AS n FROM v_stats")
def pearson(spark, d):
    return S.correlations(_stats(spark, d), ["num_triplets", "num_unique_concepts"]).select("a", "b", r6("r", "r"), "n")


@query(f"""WITH {V.V_STATS}, r AS (SELECT rank() OVER (ORDER BY num_triplets) + (count(*) OVER (PARTITION BY num_triplets) - 1) / 2 AS x,
rank() OVER (ORDER BY num_unique_concepts) + (count(*) OVER (PARTITION BY num_unique_concepts) - 1) / 2 AS y FROM v_stats)
SELECT 'num_triplets' AS a, 'num_unique_concepts' AS b, round(corr(x, y), 6) AS r, count(*) AS n FROM r""")
def spearman(spark, d):
    return S.correlations(_stats(spark, d), ["num_triplets", "num_unique_concepts"], "spearman").select("a", "b", r6("r", "r"), "n")


@query(f"""WITH {V.V_STATS}, r AS (SELECT num_triplets - avg(num_triplets) OVER (PARTITION BY regime) AS x, age_refined - avg(age_refined) OVER (PARTITION BY regime) AS y FROM v_stats)
SELECT 'num_triplets' AS a, 'age_refined' AS b, round(corr(x, y), 6) AS r, count(*) AS n FROM r""")
def partial_corr(spark, d):
    return S.partial_correlations(_stats(spark, d), ["num_triplets", "age_refined"]).select("a", "b", r6("r", "r"), "n")


@query()
def correlation_verdicts(spark, d):
    return S.verdict(S.correlations(_stats(spark, d), ["age_refined", "num_triplets", "num_unique_concepts"]))


@query(f"""WITH {V.V_STATS}, m AS (SELECT regime, quantile_cont(num_triplets, 0.5) AS x, quantile_cont(num_unique_concepts, 0.5) AS y FROM v_stats GROUP BY 1)
SELECT regime, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS num_triplets, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS num_unique_concepts FROM m""")
def regime_zscore(spark, d):
    z = S.regime_zscores(_stats(spark, d), ["num_triplets", "num_unique_concepts"])
    return z.select("regime", r6("num_triplets", "num_triplets"), r6("num_unique_concepts", "num_unique_concepts"))


@query(f"WITH {V.V_STATS} SELECT regime, num_triplets AS x, round(row_number() OVER (PARTITION BY regime ORDER BY num_triplets, persona_id) / count(*) OVER (PARTITION BY regime), 6) AS y FROM v_stats")
def ecdf(spark, d):
    return S.ecdf(_stats(spark, d), "num_triplets").select("regime", "x", r6("y", "y"))


@query(f"""WITH {V.V_STATS} SELECT regime, count(*) AS n, {', '.join(f"round(quantile_cont(log10(num_triplets + 1), {q}), 6) AS {k}" for k, q in (("low", 0), ("q1", .25), ("median", .5), ("q3", .75), ("high", 1)))} FROM v_stats GROUP BY 1""")
def box_summary(spark, d):
    b = S.box_summary(_stats(spark, d), "num_triplets", log=True)
    return b.select("regime", "n", *[r6(k, k) for k in ("low", "q1", "median", "q3", "high")])


@query(f"WITH {V.V_STATS}, m AS (SELECT regime, quantile_cont(num_triplets, 0.5)::DOUBLE AS m FROM v_stats GROUP BY 1) SELECT x.regime AS a, y.regime AS b, round(y.m - x.m, 6) AS diff FROM m x JOIN m y ON x.regime < y.regime")
def pairwise_median_diff(spark, d):
    return S.pairwise_median_diff(_stats(spark, d), "num_triplets").select("a", "b", r6("diff", "diff"))


@query(f"""WITH {V.V_STATS}, g AS (SELECT DISTINCT regime FROM v_stats), a AS (SELECT DISTINCT age_refined FROM v_stats), n AS (SELECT regime, age_refined, count(*) AS n FROM v_stats GROUP BY ALL)
SELECT regime, age_refined, coalesce(n, 0) AS n FROM g CROSS JOIN a LEFT JOIN n USING (regime, age_refined)""")
def frequency_fill(spark, d):
    return S.frequencies(_stats(spark, d), "age_refined")


@query(f"WITH {V.V_STATS} SELECT regime, age_refined, round(count(*) / sum(count(*)) OVER (PARTITION BY regime), 6) AS share FROM v_stats GROUP BY regime, age_refined")
def crosstab_norm(spark, d):
    return S.crosstab_share(_stats(spark, d), "age_refined").select("regime", "age_refined", r6("share", "share"))


@query()
def bootstrap_ci(spark, d):
    return S.bootstrap_ci(_stats(spark, d), "num_triplets", times=200)


@query(f"WITH {V.V_STATS} SELECT avg((relation IS NOT NULL)::INT)::DOUBLE AS coverage FROM v_triplets")
def coverage(spark, d):
    return S.coverage(V.triplets(spark, d), "relation")


_AGE_SQL = "SELECT p_partkey, p_size % 25 AS age FROM part"


@query("SELECT p_partkey, age, CASE " + " ".join(f"WHEN age BETWEEN {lo} AND {hi} THEN '{lo}-{hi}'" for lo, hi in L.AGE_BINS)
       + f" END AS age_bin, CASE WHEN age <= 10 THEN '3–10' WHEN age <= 14 THEN '11–14' ELSE '15–18' END AS coarse_bin FROM ({_AGE_SQL})")
def age_bins(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", (c("p_size") % 25).alias("age"))
    return p.select("p_partkey", "age", T.age_bin(c("age")).alias("age_bin"), T.coarse_age_bin(c("age")).alias("coarse_bin"))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN age BETWEEN {lo} AND {hi} THEN '{n}'" for n, lo, hi in L.AGE_REGIMES) + f" END AS regime, age BETWEEN 3 AND 11 AS primary_ok, age <= 18 AS university_ok FROM ({_AGE_SQL})")
def age_regime(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", (c("p_size") % 25).alias("age"))
    return p.select("p_partkey", T.age_regime(c("age")).alias("regime"), T.age_fits(c("age"), F.lit("primary")).alias("primary_ok"), T.age_fits(c("age"), F.lit("university")).alias("university_ok"))


@query("SELECT p_partkey, CASE WHEN x < 44 THEN 'Grades K–1' " + " ".join(f"WHEN x BETWEEN {lo} AND {hi} THEN '{g}'" for lo, hi, g in L.DRP_BANDS[1:]) + f" ELSE '{L.DRP_BEYOND}' END AS grade FROM (SELECT p_partkey, 30 + p_size AS x FROM part)")
def drp_grade(spark, d):
    return V.table(spark, d, "part").select("p_partkey", T.drp_grade(30 + c("p_size")).alias("grade"))


#: Personas made of parts: a sentence with an age or a school level in it.
_PERSONA = "'A ' || p_size || '-year-old who likes ' || p_type || CASE p_size % 8 WHEN 0 THEN ', a high school student' WHEN 1 THEN ', in kindergarten' WHEN 2 THEN ', at the university' ELSE '' END"
_PERSONAS = f"SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'Someone at school, a ' || p_type || CASE p_size % 7 WHEN 0 THEN ' high school student' WHEN 1 THEN ' pupil' WHEN 2 THEN ' college teacher' ELSE ' ' END ELSE {_PERSONA} END AS text, p_size FROM part"


def _personas(spark, d):
    return V.table(spark, d, "part").selectExpr("p_partkey", _PERSONAS.split("SELECT p_partkey, ", 1)[1].rsplit(" AS text", 1)[0] + " AS text", "p_size")


def _any_sql(phrases, t="lower(text)"):
    return "(" + " OR ".join(f"contains({t}, '{p}')" for p in phrases) + ")"


_STATED = r"try_cast(nullif(regexp_extract(lower(text), '([0-9]{1,2})\s*-*\s*(?:years?\s*-?\s*old|y/o|yrs?)', 1), '') AS INT)"


@query(f"SELECT p_partkey, coalesce({_STATED}, CASE " + " ".join(
    "WHEN " + " OR ".join("(" + " AND ".join(f"contains(lower(text), '{p}')" for p in g) + ")" for g in groups) + f" THEN {age}" for groups, age in L.AGE_CASCADE)
    + f" END) AS age FROM ({_PERSONAS})")
def age_extract(spark, d):
    return _personas(spark, d).select("p_partkey", T.age_by_cascade(c("text")).alias("age"))


@query(f"SELECT p_partkey, coalesce({_STATED}, CASE " + " ".join(f"WHEN {_any_sql(ps)} THEN {age}" for ps, age in [((p,), a) for p, a in L.PHRASE_AGES] + L.SCHOOL_AGES) + f" END) AS age FROM ({_PERSONAS})")
def age_heuristic(spark, d):
    return _personas(spark, d).select("p_partkey", T.age_by_phrase(c("text")).alias("age"))


@query(f"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 14 OR p_size >= 18 THEN 'age out of range' END,
CASE WHEN NOT contains(lower(text), 'high school') AND NOT regexp_matches(lower(text), '\\bgrade\\s*(9|10|11|12)\\b') THEN 'no explicit high school mention' END,
CASE WHEN {_any_sql(["university", "college", "degree"])} THEN 'mentions university/college' END,
CASE WHEN {_any_sql(["full-time job", "working full time"])} THEN 'mentions full-time work' END], lambda x: x IS NOT NULL), ';') AS reasons FROM ({_PERSONAS})""")
def strict_filter_reasons(spark, d):
    return _personas(spark, d).select("p_partkey", F.array_join(T.high_school_reasons(c("text"), c("p_size")), ";").alias("reasons"))


@query("SELECT p_partkey, " + ", ".join(f"{_any_sql(L.EXCLUDE[k])} AS not_{k}" for k in L.EXCLUDE) + f" FROM ({_PERSONAS})")
def keyword_exclusion(spark, d):
    return _personas(spark, d).select("p_partkey", *[T.contains_any(c("text"), L.EXCLUDE[k]).alias(f"not_{k}") for k in L.EXCLUDE])


@query(f"SELECT p_partkey, regexp_matches(lower(text), '\\b({'|'.join(L.HIGH_SCHOOL_ROLES)})\\b') AS role FROM ({_PERSONAS})")
def role_filter(spark, d):
    return _personas(spark, d).select("p_partkey", T.is_high_school_role(c("text")).alias("role"))


@query("SELECT d.doc_id, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 0 AND n_chars IS NOT NULL")
def judge_accept(spark, d):
    judged = _docs(spark, d).join(V.table(spark, d, "labels"), "doc_id")
    label = F.when((c("quality") == 1) & (c("toxic") == 0), "yes").otherwise("no")
    return R.accepted(judged.withColumns({"llm_label": label, "llm_confidence": F.lit(90), "age": c("n_chars")})).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return R.resume(_docs(spark, d).select("doc_id"), V.table(spark, d, "labels"), ["doc_id"])


@query(f"WITH {V.V_TRIPLETS} SELECT regime, count(*) FILTER (run_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS kept, count(*) AS total FROM v_triplets GROUP BY 1")
def persona_keep_ratio(spark, d):
    kept = V.table(spark, d, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("run_id"))
    return R.keep_ratio(V.triplets(spark, d), kept, ["run_id"], "regime").select("regime", "kept", "total")


@query(f"WITH {V.V_TRIPLETS} SELECT edge_id FROM v_triplets WHERE run_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def persona_semi_join(spark, d):
    kept = V.table(spark, d, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("run_id"))
    return R.kept_only(V.triplets(spark, d), kept, ["run_id"]).select("edge_id")


@query(f"WITH {V.V_STATS} SELECT persona_id FROM v_stats WHERE NOT (num_triplets BETWEEN {_Q('num_triplets', 0.05)} AND {_Q('num_triplets', 0.95)})")
def removed_personas(spark, d):
    s = _stats(spark, d)
    return R.resume(s.select("persona_id"), S.quantile_trim(s, ["num_triplets"]), ["persona_id"])


@query(f"WITH {V.V_STATS} SELECT persona_id, v.num_triplets, a.c_acctbal FROM v_stats v LEFT JOIN (SELECT c_name, arg_min(c_acctbal, c_custkey) AS c_acctbal FROM customer WHERE c_acctbal > 0 GROUP BY 1) a ON c_name = persona_text")
def attach_attributes(spark, d):
    people = V.table(spark, d, "customer").where("c_acctbal > 0").select(c("c_name").alias("persona_text"), "c_acctbal", "c_custkey")
    return R.attach(_stats(spark, d), people, "persona_text", "c_custkey").select("persona_id", "num_triplets", "c_acctbal")


@query(f"WITH {V.V_TRIPLETS} SELECT run_id, subject, relation, min(edge_id) AS edge_id FROM v_triplets GROUP BY ALL")
def dedup_first(spark, d):
    t = V.triplets(spark, d).select("run_id", "subject", "relation", "edge_id")
    return R.first_of(t, ["run_id", "subject", "relation"], "edge_id")


@query(f"WITH {V.V_EDGES} SELECT run_id, arg_min(src, edge_id) AS subject, arg_min(label, edge_id) AS relation, arg_min(dst, edge_id) AS object, min(edge_id) AS edge_id FROM v_edges GROUP BY run_id, lower(src), lower(label), lower(dst)")
def dedup_exact(spark, d):
    t = V.edges(spark, d).select("run_id", c("src").alias("subject"), c("label").alias("relation"), c("dst").alias("object"), "edge_id")
    return R.first_of_normalised(t, "edge_id", ["run_id"])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) WHERE (i - 1) % 4 = 1")
def shard_mod(spark, d):
    return R.shard(_docs(spark, d).select("doc_id"), "doc_id", 4, 1)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 50)::BIGINT AS chunk FROM documents")
def chunk_50(spark, d):
    return R.chunks(_docs(spark, d).select("doc_id"), "doc_id").select("doc_id", "chunk")


@query(f"""WITH {V.V_EDGES}, h AS (SELECT run_id, node FROM (SELECT run_id, node, sum(a) AS a, count(*) AS n FROM (SELECT run_id, src AS node, active::INT AS a FROM v_edges UNION ALL SELECT run_id, dst, active::INT FROM v_edges) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY a DESC, n DESC, node) = 1)
SELECT edge_id, row_number() OVER (PARTITION BY e.run_id ORDER BY (src <> node)::INT, edge_id)::INT AS place FROM v_edges e JOIN h USING (run_id)""")
def hub_priority(spark, d):
    e = V.edges(spark, d)
    t = e.select("run_id", c("src").alias("subject"), "edge_id")
    return R.hub_first(t, G.backbone(e), "edge_id").select("edge_id", "place")


@query(f"WITH {V.V_EDGES} SELECT edge_id FROM v_edges QUALIFY row_number() OVER (PARTITION BY run_id, src ORDER BY edge_id) <= 3")
def cap_per_node(spark, d):
    return R.capped(V.edges(spark, d), ["run_id", "src"], "edge_id").select("edge_id")


_BAD = "(" + " OR ".join("contains({x}, '" + t + "')" for t in L.CONTROL_TOKENS) + ")"


@query(f"""SELECT conv_id, turn, s, r, md5(CASE WHEN NOT {_BAD.format(x='o')} THEN o WHEN NOT {_BAD.format(x='s')} THEN s ELSE 'UNKNOWN' END) AS o FROM
(SELECT conv_id, turn, CASE WHEN NOT {_BAD.format(x='s')} THEN s WHEN NOT {_BAD.format(x='o')} THEN o ELSE 'UNKNOWN' END AS s, CASE WHEN {_BAD.format(x='r')} OR r = '' THEN 'related_to' ELSE r END AS r, o
FROM (SELECT conv_id, turn, trim(role) AS s, trim(text) AS r, trim(text) AS o FROM (SELECT conv_id, turn, role, regexp_replace(text, '\\s', '_', 'g') AS text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)))""")
def repair_triplets(spark, d):
    t = V.table(spark, d, "conversations").where("text is not null and role is not null").withColumn("text", F.regexp_replace("text", r"\s", "_"))
    fixed = T.repaired(c("role"), c("text"), c("text"))
    return t.select("conv_id", "turn", fixed.alias("x")).select("conv_id", "turn", "x.s", "x.r", F.md5("x.o").alias("o"))


_LABELS = "SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g')) AS t FROM conversations"


@query(f"""SELECT conv_id, turn, regexp_matches(lower(t), '(^|\\s)({"|".join(L.NEGATION_WORDS)})(\\s|$)') OR {_any_sql(L.NEGATION_PHRASES, "lower(t)")} AS negation, regexp_matches(t, '[a-zA-Z]') AS has_letter FROM ({_LABELS})""")
def negation_filter(spark, d):
    t = V.table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")).alias("t"))
    return t.select("conv_id", "turn", T.is_negation(c("t")).alias("negation"), T.is_relation_label(c("t")).alias("has_letter"))


_LOW = "lower(t)"


@query(f"""SELECT conv_id, turn, regexp_replace(CASE WHEN regexp_matches({_LOW}, '\\blikes?\\b') THEN 'enjoys' WHEN regexp_matches({_LOW}, '\\b(is|are|was|were|be|being|been)\\b') THEN 'is'
WHEN regexp_matches({_LOW}, '\\b(has|have|possess|own)\\b') THEN 'has' ELSE replace({_LOW}, ' ', '_') END, '_+', '_', 'g') AS label FROM ({_LABELS})""")
def edge_label_norm(spark, d):
    t = V.table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")).alias("t"))
    return t.select("conv_id", "turn", T.edge_label(c("t")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN length(x) < 2 THEN '' ELSE x END AS label FROM (SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_type), ' '), lambda w: length(w) <= 2 OR regexp_matches(w, '[aeiou]')), ' ') AS x FROM part)""")
def clean_label(spark, d):
    return V.table(spark, d, "part").select("p_partkey", T.clean_label(F.concat(F.lit("nsubj:"), c("p_type"), F.lit("..."))).alias("label"))


@query("""SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name
WHERE ((contains(a.n_name, b.n_name) OR contains(b.n_name, a.n_name)) AND abs(length(a.n_name) - length(b.n_name)) <= 4) OR (abs(length(a.n_name) - length(b.n_name)) <= 2 AND levenshtein(a.n_name, b.n_name) <= 2)
   OR a.n_regionkey = 1""")
def levenshtein_pairs(spark, d):
    n = V.table(spark, d, "nation")
    a, b = n.select(c("n_name").alias("a"), "n_regionkey"), n.select(c("n_name").alias("b"), "n_regionkey")
    pairs = a.join(b, "n_regionkey").where("a < b").where(T.similar_strings(c("a"), c("b")) | (c("n_regionkey") == 1))
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    e = V.table(spark, d, "embeddings")
    a, b = e.select(c("vec_id").alias("a"), "label", c("embedding").alias("x")), e.select(c("vec_id").alias("b"), "label", c("embedding").alias("y"))
    return a.join(b, (a["label"] == b["label"]) & (c("b") == c("a") + 1)).select("a", "b", r6(T.cosine(c("x"), c("y")), "cosine"))


_BFS = """src AS (SELECT run_id, min(src) AS node FROM v_edges GROUP BY 1), act AS (SELECT * FROM v_edges WHERE active AND visibility > {v}),
ab AS (SELECT run_id, src AS node, dst AS near FROM act UNION SELECT run_id, dst, src FROM act), d1 AS (SELECT run_id, near AS node FROM src JOIN ab USING (run_id, node)),
d2 AS (SELECT d1.run_id, ab.near AS node FROM d1 JOIN ab ON d1.run_id = ab.run_id AND d1.node = ab.node),
dist AS (SELECT run_id, node, min(k)::INT AS distance FROM (SELECT *, 0 AS k FROM src UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2) GROUP BY ALL)"""


@query(f"WITH {V.V_EDGES}, {_BFS.format(v=1)} SELECT run_id, node, distance FROM dist")
def bfs_distance(spark, d):
    e = V.edges(spark, d)
    return G.distances(G.active(e, 1), e.groupBy("run_id").agg(F.min("src").alias("node")))


@query(f"WITH {V.V_EDGES}, {_BFS.format(v=0)} SELECT run_id, node, distance FROM dist WHERE (run_id, node) NOT IN (SELECT (run_id, node) FROM src)")
def carryover_view(spark, d):
    e = V.edges(spark, d)
    return G.carryover(e, e.groupBy("run_id").agg(F.min("src").alias("node")))


@query(f"WITH {V.V_EDGES}, {_BFS.format(v=0)} SELECT e.edge_id FROM v_edges e WHERE active AND (run_id, src) IN (SELECT (run_id, node) FROM dist) AND (run_id, dst) IN (SELECT (run_id, node) FROM dist)")
def view_edges(spark, d):
    e = V.edges(spark, d)
    near = G.distances(G.active(e), e.groupBy("run_id").agg(F.min("src").alias("node")))
    return G.view_edges(e, near).select("edge_id")


_SENTENCES = list(range(8))


@query(f"""WITH {V.V_EDGES}, r AS (SELECT src AS token, sentence_index AS s, greatest(0.0, least(5.0, 5.0 - visibility)) AS score FROM v_edges)
SELECT token, {', '.join(f'round(coalesce(avg(score) FILTER (s = {k}), 0.0)::DOUBLE, 6) AS s{k}' for k in _SENTENCES)} FROM r GROUP BY token""")
def landscape_matrix(spark, d):
    r = V.edges(spark, d).select(c("src").alias("token"), c("sentence_index").alias("sentence"), T.landscape(c("visibility")).alias("score"))
    return G.landscape_matrix(r, _SENTENCES).select("token", *[r6(f"`{k}`", f"s{k}") for k in _SENTENCES])


@query(f"""WITH {V.V_EDGES}, v AS (SELECT DISTINCT run_id, sentence_index AS s, src AS node FROM v_edges), e AS (SELECT run_id, max(s) AS hi FROM v GROUP BY 1),
p AS (SELECT v.*, coalesce(lead(s) OVER (PARTITION BY v.run_id, node ORDER BY s), hi + 1) - 1 AS until FROM v JOIN e USING (run_id)),
g AS (SELECT run_id, node, s, unnest(range(s + 1, until + 1)) AS k FROM p WHERE until > s)
SELECT run_id, k AS sentence, coalesce(string_agg(node, ',' ORDER BY node) FILTER (k = s + 1), '') AS left_now, string_agg(node, ',' ORDER BY node) AS inactive FROM g GROUP BY ALL""")
def inactive_sets(spark, d):
    v = V.edges(spark, d).select("run_id", c("sentence_index").alias("sentence"), c("src").alias("node"))
    return G.inactive_sets(v).select("run_id", c("sentence").cast("long").alias("sentence"), F.array_join("left_now", ",").alias("left_now"), F.array_join("inactive", ",").alias("inactive"))


@query(f"WITH {V.V_TRIPLETS}, i AS (SELECT run_id, subject, relation, object, min(sentence_index) AS introduced_at FROM v_triplets GROUP BY ALL) SELECT * FROM i WHERE introduced_at <= 3")
def cumulative_triplets(spark, d):
    return G.upto(G.first_introductions(V.triplets(spark, d)), 3)


@query(f"WITH {V.V_EDGES} SELECT edge_id, greatest(0, 2 - greatest(0, 5 - sentence_index))::INT AS visibility, greatest(0, 2 - greatest(0, 5 - sentence_index)) > 0 AS active FROM v_edges")
def edge_decay_closed_form(spark, d):
    return G.decayed(V.edges(spark, d).withColumn("touched_at", c("sentence_index")), F.lit(5)).select("edge_id", "visibility", "active")


@query(f"WITH {V.V_EDGES} SELECT run_id, src, dst, label, active, edge_id FROM v_edges QUALIFY row_number() OVER (PARTITION BY run_id, least(src, dst), greatest(src, dst) ORDER BY active DESC, edge_id, src, dst, label) = 1")
def pair_best_edge(spark, d):
    return G.best_of_pair(V.edges(spark, d))


@query(f"""WITH {V.V_EDGES}, {_BFS.format(v=0)}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, distance ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY run_id, distance) AS n FROM dist)
SELECT run_id, node, distance, round(CASE WHEN distance = 0 THEN 0 ELSE greatest(4 + 4.5 * distance, n * 2.7 / (2 * pi())) * cos(2 * pi() * i / n + pi() * (3 - sqrt(5)) * distance) END::DOUBLE, 4) AS x,
round(CASE WHEN distance = 0 THEN 0 ELSE greatest(4 + 4.5 * distance, n * 2.7 / (2 * pi())) * sin(2 * pi() * i / n + pi() * (3 - sqrt(5)) * distance) END::DOUBLE, 4) AS y FROM k""")
def radial_layout(spark, d):
    e = V.edges(spark, d)
    at = G.radial_layout(G.distances(G.active(e), e.groupBy("run_id").agg(F.min("src").alias("node"))))
    return at.select("run_id", "node", "distance", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {_CC.format(v=V.V_EDGES)}, z AS (SELECT run_id, component, count(*) AS n FROM cc GROUP BY ALL), b AS (SELECT run_id, component AS dst FROM z QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, component) = 1)"
       " SELECT z.run_id, z.component AS src, b.dst FROM z JOIN b USING (run_id) WHERE z.component <> b.dst")  # fmt: skip
def connect_components(spark, d):
    return G.bridging_edges(V.edges(spark, d)).select("run_id", "src", "dst")


@query(f"WITH {_CC.format(v=V.V_EDGES)} SELECT run_id, count(DISTINCT component) <= 1 AS connected FROM cc GROUP BY 1")
def connectivity(spark, d):
    return G.is_connected(V.edges(spark, d))


@query("SELECT source, (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source)) AS n FROM (SELECT DISTINCT source FROM documents)")
def balance_groups(spark, d):
    return R.balanced(_docs(spark, d).select("doc_id", "source"), "source", "doc_id").groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT r_name AS name, '' AS n_nationkey, r_regionkey::VARCHAR AS key FROM region UNION ALL SELECT n_name, n_nationkey::VARCHAR, n_regionkey::VARCHAR FROM nation""")
def union_align(spark, d):
    a = V.table(spark, d, "region").select(c("r_name").alias("name"), c("r_regionkey").alias("key"))
    b = V.table(spark, d, "nation").select(c("n_name").alias("name"), "n_nationkey", c("n_regionkey").alias("key"))
    return R.union_aligned([a, b], as_text=True)


@query(r"""SELECT p_partkey, pos::INT AS pos, drp::DOUBLE AS drp, p_type AS paragraph FROM (SELECT p_partkey, p_type, unnest([1, 2]) AS pos, unnest([p_size + 0.5, p_size + 20]) AS drp FROM part)""")
def paragraphs(spark, d):
    t = V.table(spark, d, "part").select("p_partkey", F.format_string('<p> head\n<t DRP="%d.5"> %s \n\n<t DRP="%d">%s', "p_size", "p_type", c("p_size") + 20, "p_type").alias("text"))
    t = t.withColumn("text", F.regexp_replace("text", r'<t (DRP="[\d.]+")>', "$1"))
    return R.paragraphs(t).select("p_partkey", "pos", "drp", "paragraph")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 2)::BIGINT AS k, greatest(0, least(3, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 2)))::INT AS score FROM events")
def json_payload(spark, d):
    e = V.table(spark, d, "events").select("event_id", T.payload(F.concat(F.lit("final: "), c("props"), F.lit(" done")), "struct<k:bigint>").alias("x"))
    return e.select("event_id", F.coalesce(c("x.k"), F.lit(2)).cast("long").alias("k"), T.decay_score(c("x.k").cast("string")).alias("score"))


@query("SELECT conv_id AS run_id, turn AS sentence_index, md5(coalesce(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '')) AS context FROM conversations")
def context_window(spark, d):
    s = V.table(spark, d, "conversations").select(c("conv_id").alias("run_id"), c("turn").alias("sentence_index"), "text")
    return R.previous_text(s).select("run_id", "sentence_index", F.md5("context").alias("context"))


@query("SELECT l_name, n FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'yes' WHEN quality = 0 THEN 'low quality' ELSE 'toxic' END AS l_name, count(*) AS n FROM labels GROUP BY 1)")
def outcome_counts(spark, d):
    o = F.when((c("quality") == 1) & (c("toxic") == 0), "yes").when(c("quality") == 0, "low quality").otherwise("toxic")
    return R.outcome_counts(V.table(spark, d, "labels"), o).select(c("outcome").alias("l_name"), "n")


@query("SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')))::INT AS n FROM pages WHERE html IS NOT NULL")
def tag_strip(spark, d):
    p = V.table(spark, d, "pages").where("html is not null")
    return p.select("page_id", F.length(F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", " "))).alias("n"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    """An extension beyond the reference: tumbling windows."""
    e = V.table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("event_type", c("w.start").alias("hour"), "n", "total")


def _sentences(spark, d):
    return V.table(spark, d, "conversations").select(c("conv_id").cast("string").alias("run_id"), c("turn").cast("int").alias("sentence_index"), "text")


@query()
def story_graph(spark, d):
    return read_stories(_sentences(spark, d))


@query()
def tagged_words(spark, d):
    s = _sentences(spark, d).withColumn("tokens", tokens(c("text")))
    return s.select("run_id", "sentence_index", content_words(c("tokens")).alias("content"), nouns(c("tokens")).alias("nouns"))


def _draw_sql(n: int, *parts: str) -> str:
    """What the stub draws from 0 to n - 1 for texts without quotes: of the digest of the parts as a tuple."""
    return "(('0x' || substr(sha1('(' || " + " || ', ' || ".join(parts) + (" || ',)'" if len(parts) == 1 else " || ')'") + f"), 1, 8))::BIGINT % {n})"


_QUOTED = "chr(39) || text || chr(39)"


@query(f"""SELECT p_partkey AS idx, 'part::' || p_partkey AS persona_id, age, 'yes' AS llm_label, 100 - d // 2 AS llm_confidence FROM (SELECT *, {_draw_sql(100, _QUOTED)} AS d,
coalesce({_STATED}, CASE {" ".join(f"WHEN {_any_sql(ps)} THEN {a}" for ps, a in [((p,), a) for p, a in L.PHRASE_AGES] + L.SCHOOL_AGES)} END) AS age FROM ({_PERSONAS}))
WHERE contains(lower(text), 'high school') AND NOT {_any_sql(L.EXCLUDE["highschool"])} AND age >= 14 AND age < 18 AND NOT {_any_sql(["university", "college", "degree"])} AND d < 60 AND 100 - d // 2 >= {L.MIN_CONFIDENCE}""")
def curated_personas(spark, d):
    p = _personas(spark, d).select(F.lit("part").alias("source_config"), c("p_partkey").alias("idx"), c("text").alias("persona_text"))
    return curate(p, "highschool", ["high school"]).select("idx", "persona_id", "age", "llm_label", "llm_confidence")


_CAP = "least({m}, (SELECT quantile_cont({m}, 0.75) + 1.5 * (quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25)) FROM t))"


@query(f"""WITH {V.V_STATS}, e AS (SELECT run_id, subject AS src, object AS dst FROM v_triplets), b AS (SELECT DISTINCT run_id, src AS node, dst AS near FROM e UNION SELECT run_id, dst, src FROM e),
g AS (SELECT run_id, node, count(*) AS d FROM b GROUP BY ALL), n AS (SELECT run_id, count(*) AS graph_num_nodes, avg(d) AS graph_avg_degree FROM g GROUP BY 1), m AS (SELECT run_id, count(*) AS graph_num_edges FROM e GROUP BY 1),
o AS (SELECT persona_text, min(run_id) AS run_id FROM v_triplets GROUP BY 1), s AS (SELECT v.*, graph_num_nodes, graph_num_edges, graph_avg_degree,
CASE WHEN graph_num_nodes > 1 THEN 2 * graph_num_edges / (graph_num_nodes * (graph_num_nodes - 1)) ELSE 0.0 END AS graph_density FROM v_stats v JOIN o USING (persona_text) JOIN n USING (run_id) JOIN m USING (run_id)),
t AS (SELECT * FROM s WHERE {" AND ".join(f"{m} BETWEEN (SELECT quantile_cont({m}, 0.05) FROM s) AND (SELECT quantile_cont({m}, 0.95) FROM s)" for m in L.TRIMMED)})
SELECT persona_id, num_triplets, graph_num_nodes, graph_num_edges, {", ".join(f"round({_CAP.format(m=m)}::DOUBLE, 6) AS {m}" for m in L.CAPPED)} FROM t""")
def trimmed_stats(spark, d):
    clean = trim_plan(V.triplets(spark, d))["clean"]
    return clean.select("persona_id", "num_triplets", "graph_num_nodes", "graph_num_edges", *[r6(m, m) for m in L.CAPPED])


@query(f"SELECT run_id, sentence_index, md5(array_to_string(list_sort(list_distinct(w)), ' ')) AS words, len(list_distinct(w))::INT AS n FROM (SELECT conv_id::VARCHAR AS run_id, turn::INT AS sentence_index, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM conversations)")
def sentence_lemmas(spark, d):
    s = _sentences(spark, d).select("run_id", "sentence_index", T.sentence_lemmas(F.lower("text")).alias("w"))
    return s.select("run_id", "sentence_index", F.md5(F.array_join(F.array_sort("w"), " ")).alias("words"), F.size("w").alias("n"))


_ENDS = "v_ends AS (SELECT run_id, src AS node, active, edge_id FROM v_edges UNION ALL SELECT run_id, dst, active, edge_id FROM v_edges)"


@query(f"WITH {V.V_EDGES}, {_ENDS} SELECT run_id, node, count(*) AS degree, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, node)::INT AS place FROM v_ends GROUP BY run_id, node")
def node_degrees(spark, d):
    return G.by_degree(V.edges(spark, d))


@query(f"WITH {V.V_EDGES}, {_ENDS} SELECT run_id, node FROM (SELECT run_id, node, sum(active::INT) AS a, count(*) AS n FROM v_ends GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY a DESC, n DESC, node) = 1")
def backbone_nodes(spark, d):
    return G.backbone(V.edges(spark, d))


@query(f"WITH {V.V_EDGES} SELECT run_id, node, string_agg(DISTINCT near, ',' ORDER BY near) AS near_nodes FROM v_both GROUP BY ALL")
def adjacency(spark, d):
    return G.adjacency(V.edges(spark, d)).select("run_id", "node", F.array_join("near_nodes", ",").alias("near_nodes"))


@query(f"WITH {V.V_EDGES} SELECT run_id, node FROM v_both WHERE (run_id, node) NOT IN (SELECT (run_id, src) FROM v_edges WHERE active UNION SELECT (run_id, dst) FROM v_edges WHERE active) GROUP BY ALL")
def dangling_nodes(spark, d):
    e = V.edges(spark, d)
    return G.dangling(G.endpoints(e), e.where("active"))


@query(f"WITH {V.V_EDGES} SELECT run_id, src AS subject, label AS relation, dst AS object FROM v_edges WHERE active AND src <> dst AND label IS NOT NULL")
def semantic_triplets(spark, d):
    return G.semantic_triplets(V.edges(spark, d))


@query(f"WITH {V.V_EDGES} SELECT DISTINCT run_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM v_edges WHERE src <> dst")
def simple_graph(spark, d):
    return G.simple(V.edges(spark, d))


@query(f"""WITH {V.V_EDGES}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id, least(src, dst), greatest(src, dst) ORDER BY edge_id, src, dst, label) - 1 AS k, count(*) OVER (PARTITION BY run_id, least(src, dst), greatest(src, dst)) AS n FROM v_edges)
SELECT run_id, least(src, dst) AS a, greatest(src, dst) AS b, k::INT AS k, round(CASE WHEN n = 1 THEN 0.5 WHEN n = 2 THEN CASE WHEN k = 0 THEN 0.4 ELSE 0.6 END
ELSE greatest(0.3, 0.5 - 0.15 * (n - 1) / 2) + (least(0.7, 0.5 + 0.15 * (n - 1) / 2) - greatest(0.3, 0.5 - 0.15 * (n - 1) / 2)) * k / (n - 1) END::DOUBLE, 6) AS t FROM k""")
def edge_curves(spark, d):
    curved = G.curvatures(V.edges(spark, d))
    pair = Window.partitionBy("run_id", "a", "b").orderBy("t0")
    named = curved.select("run_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), c("t").alias("t0"))
    return named.select("run_id", "a", "b", (F.row_number().over(pair) - 1).alias("k"), r6("t0", "t"))


@query(f"""WITH {V.V_EDGES}, {_ENDS}, g AS (SELECT run_id, node, count(*) AS n FROM v_ends WHERE active GROUP BY ALL),
a AS (SELECT run_id, src AS node, dst AS near FROM v_edges WHERE active UNION SELECT run_id, dst, src FROM v_edges WHERE active), d AS (SELECT run_id, node, count(*) AS d FROM a GROUP BY ALL), z AS (SELECT run_id, count(*) AS size FROM d GROUP BY 1)
SELECT x.run_id, x.node, round((3 * coalesce(n, 0) + 5 + CASE WHEN n > 0 THEN 8 ELSE 0 END + CASE WHEN coalesce(size, 0) > 1 THEN 5 * coalesce(d, 0) / (size - 1) ELSE 0 END)::DOUBLE, 6) AS score
FROM (SELECT DISTINCT run_id, node FROM v_both) x LEFT JOIN g USING (run_id, node) LEFT JOIN d USING (run_id, node) LEFT JOIN z USING (run_id)""")
def node_scores(spark, d):
    e = V.edges(spark, d)
    on = G.endpoints(e.where("active")).withColumn("active", F.lit(True))
    nodes = G.endpoints(e).join(on, ["run_id", "node"], "left").select("run_id", "node", F.lit("TEXT_BASED").alias("source"), F.coalesce("active", F.lit(False)).alias("active"))
    return G.node_scores(nodes, e).select("run_id", "node", r6("score", "score"))


@query(f"""WITH {V.V_EDGES} SELECT run_id, md5(string_agg(n || '. ' || src || ' - ' || label || ' (edge) - ' || dst, chr(10) ORDER BY n)) AS listing FROM
(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY edge_id, src, label, dst) AS n FROM v_edges WHERE active) GROUP BY 1""")
def edge_listing(spark, d):
    return G.edge_listing(V.edges(spark, d)).select("run_id", F.md5("edges").alias("listing"))


@query(f"""WITH {V.V_TRIPLETS}, t AS (SELECT DISTINCT run_id, sentence_index, subject, relation, object FROM v_triplets), n AS (SELECT run_id, sentence_index, subject AS node FROM t UNION SELECT run_id, sentence_index, object FROM t)
SELECT x.run_id, x.sentence_index, x.triplets, y.nodes FROM (SELECT run_id, sentence_index, md5(string_agg(concat_ws('|', subject, relation, object), ';' ORDER BY concat_ws('|', subject, relation, object))) AS triplets FROM t GROUP BY ALL) x
JOIN (SELECT run_id, sentence_index, md5(string_agg(node, ';' ORDER BY node)) AS nodes FROM n GROUP BY ALL) y USING (run_id, sentence_index)""")
def state_snapshots(spark, d):
    shown = F.array_sort(F.transform("triplets", lambda t: F.concat_ws("|", t["subject"], t["relation"], t["object"])))
    return G.snapshots(V.triplets(spark, d)).select("run_id", "sentence_index", F.md5(F.array_join(shown, ";")).alias("triplets"), F.md5(F.array_join("nodes", ";")).alias("nodes"))


@query(f"""WITH {V.V_TRIPLETS} SELECT run_id, regime, md5(string_agg(subject, '; ' ORDER BY edge_id, subject)) AS subjects FROM v_triplets GROUP BY ALL""")
def ordered_strings(spark, d):
    o = M.ordered_strings(V.triplets(spark, d), ["run_id", "regime"], "edge_id")
    return o.select("run_id", "regime", F.md5("subjects").alias("subjects"))


@query("SELECT count(value) AS n, count(DISTINCT value) AS n_distinct, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,"
       " round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max FROM events")  # fmt: skip
def value_profile(spark, d):
    return R.profile(V.table(spark, d, "events"), "value").select("n", "n_distinct", *[r6(x, x) for x in ("mean", "std", "min", "q1", "median", "q3", "max")])


@query(f"WITH {V.V_STATS}, k AS (SELECT regime FROM v_stats GROUP BY 1 HAVING count(*) >= 20) SELECT persona_id FROM v_stats WHERE regime IN (SELECT regime FROM k)")
def bins_by_min_n(spark, d):
    return R.enough(_stats(spark, d), "regime", 20).select("persona_id")


@query(f"SELECT p_partkey, coalesce(p_size % 20, 0)::INT AS age, sha1(text) AS persona_id FROM ({_PERSONAS})")
def completed_ages(spark, d):
    return _personas(spark, d).select("p_partkey", T.completed_age((c("p_size") % 20).cast("double"), c("text")).alias("age"), T.persona_id(c("text")).alias("persona_id"))


@query(f"""WITH RECURSIVE {V.V_EDGES}, b2 AS (SELECT run_id, src AS node, dst AS near FROM v_edges WHERE active AND src <> dst UNION SELECT run_id, dst, src FROM v_edges WHERE active AND src <> dst),
first AS (SELECT run_id, node AS gone, min(near) AS node, count(*) AS d FROM b2 GROUP BY run_id, b2.node),
walk AS (SELECT run_id, gone, node FROM first UNION SELECT w.run_id, w.gone, b.near FROM walk w JOIN b2 b ON b.run_id = w.run_id AND b.node = w.node AND b.near <> w.gone),
met AS (SELECT w.run_id, w.gone, count(*) AS n FROM walk w JOIN b2 b ON b.run_id = w.run_id AND b.node = w.gone AND b.near = w.node GROUP BY ALL)
SELECT f.run_id, f.gone AS node FROM first f JOIN met m ON m.run_id = f.run_id AND m.gone = f.gone WHERE m.n < f.d""")
def cut_points(spark, d):
    return G.cut_points(V.edges(spark, d))


@query(f"""WITH RECURSIVE {V.V_EDGES}, {_ENDS}, hub AS (SELECT run_id, node FROM (SELECT run_id, node, sum(active::INT) AS a, count(*) AS n FROM v_ends GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY a DESC, n DESC, node) = 1),
st AS (SELECT DISTINCT run_id, src AS node, dst AS near FROM v_edges), walk AS (SELECT run_id, node, 0 AS distance FROM hub UNION SELECT w.run_id, s.near, w.distance + 1 FROM walk w JOIN st s ON s.run_id = w.run_id AND s.node = w.node WHERE w.distance < 60)
SELECT run_id, node, min(distance)::INT AS distance FROM walk GROUP BY ALL""")
def hub_levels(spark, d):
    e = V.edges(spark, d)
    return G.bfs_levels(e, G.backbone(e))


@query(f"WITH {V.V_TRIPLETS} SELECT edge_id, CASE WHEN relation IS NULL THEN 'reject' ELSE 'accept' END AS action, CASE WHEN relation IS NULL THEN 'no label' WHEN relation = 'is_a' THEN 'copula or possession' ELSE 'relation' END AS reason FROM v_triplets")
def label_gates(spark, d):
    t = V.triplets(spark, d).select("edge_id", "subject", "relation", "object")
    end = lambda x: F.struct(c(x).alias("lemma"), F.lit("NOUN").alias("pos"))
    return t.select("edge_id", relation_verdict(end("subject"), c("relation"), end("object")).alias("v")).select("edge_id", "v.action", "v.reason")
