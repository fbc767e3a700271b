"""The engine's tables as views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relations by return flag, and the activity of a line by its status.
RELATIONS = {"A": "is_a", "R": "causes", "N": "meets"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triplet per line: the customer is the persona and run, supplier and part are the ends."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    relation = F.lit(None).cast("string")
    for flag, name in RELATIONS.items():
        relation = F.when(c("l_returnflag") == flag, name).otherwise(relation)
    return lines.join(orders, c("l_orderkey") == c("o_orderkey")).join(people, c("o_custkey") == c("c_custkey")).select(
        c("o_custkey").alias("run_id"), c("l_orderkey").alias("original_index"), (c("c_nationkey") % 14 + 4).alias("age_refined"),
        c("c_name").alias("persona_text"), F.lit("m").alias("model_name"), F.concat(F.lit("s"), c("l_suppkey")).alias("subject"),
        relation.alias("relation"), F.concat(F.lit("p"), c("l_partkey")).alias("object"), c("l_linenumber").alias("sentence_index"),
        c("c_mktsegment").alias("regime"), (c("l_linestatus") == "O").alias("active"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("edge_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triplets as edges between small sets of nodes, so that runs have paths and parallel edges."""
    c = F.col
    t = triplets(spark, sf_dir)
    node = lambda x, n: F.concat(F.lit("n"), (F.substring(x, 2, 20).cast("long") % n))
    return t.select(
        "run_id", node(c("subject"), 40).alias("src"), node(c("object"), 40).alias("dst"), c("relation").alias("label"),
        (c("sentence_index") % 3).alias("visibility"), "active", "edge_id", "sentence_index",
    )


V_TRIPLETS = """v_triplets AS (
  SELECT o_custkey AS run_id, l_orderkey AS original_index, (c_nationkey % 14 + 4) AS age_refined, c_name AS persona_text, 'm' AS model_name,
    's' || l_suppkey AS subject, CASE l_returnflag WHEN 'A' THEN 'is_a' WHEN 'R' THEN 'causes' WHEN 'N' THEN 'meets' END AS relation,
    'p' || l_partkey AS object, l_linenumber AS sentence_index, c_mktsegment AS regime, l_linestatus = 'O' AS active, l_orderkey * 10 + l_linenumber AS edge_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

V_EDGES = V_TRIPLETS + """, v_edges AS (
  SELECT run_id, 'n' || (substr(subject, 2)::BIGINT % 40) AS src, 'n' || (substr(object, 2)::BIGINT % 40) AS dst, relation AS label,
    sentence_index % 3 AS visibility, active, edge_id, sentence_index FROM v_triplets),
v_both AS (SELECT DISTINCT run_id, src AS node, dst AS near FROM v_edges UNION SELECT DISTINCT run_id, dst, src FROM v_edges)"""

V_STATS = V_TRIPLETS + """, v_base AS (
  SELECT persona_text, model_name, regime, count(*) AS num_triplets, count(DISTINCT subject || chr(1) || coalesce(relation, 'nan') || chr(1) || object) AS num_unique_triplets,
    count(DISTINCT subject) AS num_unique_subjects, count(DISTINCT object) AS num_unique_objects, count(DISTINCT coalesce(relation, 'nan')) AS num_unique_relations,
    count(DISTINCT subject) + count(DISTINCT object) AS num_unique_concepts, avg(CASE WHEN relation IN ('is_a', 'causes') THEN 1.0 ELSE 0.0 END) AS abstract_relation_ratio,
    min(original_index) AS original_index, arg_min(age_refined, original_index * 10 + sentence_index) AS age_refined
  FROM v_triplets GROUP BY ALL), v_stats AS (
  SELECT *, sha1(persona_text) AS persona_id, 1 - num_unique_triplets / num_triplets AS triplet_repetition_ratio,
    len(list_filter(regexp_split_to_array(persona_text, '\\s+'), lambda x: x <> ''))::BIGINT AS persona_num_tokens,
    100.0 * num_triplets / len(list_filter(regexp_split_to_array(persona_text, '\\s+'), lambda x: x <> '')) AS triplets_per_100_tokens FROM v_base)"""
