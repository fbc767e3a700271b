"""Per-persona metrics of triplets (AGG-1..8, AGG-43, AGG-44)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulagraph.functions import text as T
from fabulagraph.operators.lineage import components

KEYS = ["persona_text", "model_name", "regime"]


def _null_as_nan(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("nan"))


def persona_stats(triplets: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """AGG-1..3: one row per group; null keys are groups.  First values (AGG-8) are those of the least
    (original_index, sentence_index).

    Equal triplets of a group meet first, with their number; each then gives a row per kind of value, and
    equal values meet.  Only counts go to the groups: no join, and no set of a group is held anywhere.
    """
    c = F.col
    s, r, o = (_null_as_nan(x) for x in ("subject", "relation", "object"))
    order = F.struct("original_index", "sentence_index", "age_refined")
    whole = triplets.groupBy(*keys, s.alias("_s"), r.alias("_r"), o.alias("_o")).agg(F.count("*").alias("_n"), F.min(order).alias("_f"), F.min("original_index").alias("_i"))
    kind = lambda k, v, n=F.lit(0).cast("long"): F.struct(F.lit(k).alias("k"), v.alias("v"), n.alias("n"))
    kinds = F.array(kind("t", F.concat_ws("\u0001", "_s", "_r", "_o"), c("_n")), kind("s", c("_s")), kind("o", c("_o")), kind("c", c("_s")), kind("c", c("_o")), kind("r", c("_r")))
    # of a relation, as many triplets as have it; of a triplet, its number and the first of them
    parts = whole.select(*keys, F.explode(kinds).alias("x"), "_n", "_f", "_i")
    in_t = c("x.k") == "t"
    values = parts.groupBy(*keys, c("x.k").alias("k"), c("x.v").alias("v")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(c("x.k") == "r", c("_n"))).alias("_of"), F.min(F.when(in_t, c("_f"))).alias("_f"), F.min(F.when(in_t, c("_i"))).alias("_i")
    )
    abstract = F.when((c("k") == "r") & T.relation_class(c("v")).isin("taxonomic", "causal"), c("_of")).otherwise(0)
    count = lambda k: F.sum(F.when(c("k") == k, 1).otherwise(0))
    out = values.groupBy(*keys).agg(
        F.sum("n").alias("num_triplets"), F.sum(abstract).cast("double").alias("_abstract"), F.min("_i").alias("original_index"), F.min("_f").alias("_f"),
        count("t").alias("num_unique_triplets"), count("s").alias("num_unique_subjects"), count("o").alias("num_unique_objects"),
        count("c").alias("num_unique_concepts"), count("r").alias("num_unique_relations"),
    )
    out = out.withColumn("abstract_relation_ratio", c("_abstract") / c("num_triplets")).withColumn("age_refined", c("_f.age_refined"))
    return with_text(out.withColumn("triplet_repetition_ratio", 1 - c("num_unique_triplets") / c("num_triplets")).drop("_f", "_abstract"))


def abstract_concept_ratio(rows: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """AGG-6: per group, nouns that are no names among the alphabetic tokens of the concepts; 0.0 without any.

    ``tokens`` is an array of (text, lemma, pos) a row, repeated concepts included; ``n`` counts the rows.
    """
    c = F.col
    words = F.filter(c(tokens), lambda t: t["text"].rlike("^[a-zA-Z]+$"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.size(F.filter(words, lambda t: t["pos"] == "NOUN"))).cast("double").alias("_a"), F.sum(F.size(words)).alias("_w")
    )
    return out.select(*keys, "n", T.ratio(c("_a"), F.coalesce("_w", F.lit(0))).alias("abstract_concept_ratio"))


def with_text(stats: DataFrame) -> DataFrame:
    """AGG-4, SCA-1, SCA-3, SCA-4: measures of the persona's text, once per group."""
    c = F.col
    words = T.tokens(c("persona_text"))
    n = F.size(T.white_words(c("persona_text"))).cast("long")
    return (
        stats.withColumn("persona_id", T.persona_id(c("persona_text")))
        .withColumn("persona_num_tokens", n)
        .withColumn("triplets_per_100_tokens", T.ratio(100.0 * c("num_triplets"), c("persona_num_tokens")))
        .withColumn("_w", words)
        .withColumn("sentiment_score", T.sentiment(c("_w")))
        .withColumn("lexical_ttr", T.type_token_ratio(c("_w")))
        .withColumn("lexical_avg_word_len", T.mean_length(c("_w")))
        .drop("_w")
    )


def graph_metrics(edges: DataFrame, group: str, src: str = "src", dst: str = "dst", with_components: bool = True, blanks: bool = False) -> DataFrame:
    """AGG-7 (AGG-44 with ``blanks``): size, mean simple degree, density and components per group.

    Edges count as often as they occur; degree counts neighbours once; blank and null ends are
    no nodes, and neither are the edges they end (``blanks`` keeps blank ones).
    """
    c = F.col
    ok = lambda x: c(x).isNotNull() & (F.lit(True) if blanks else c(x) != "")
    kept = edges.where(ok(src) & ok(dst)).select(group, c(src).alias("src"), c(dst).alias("dst"))
    m = kept.groupBy(group).agg(F.count("*").alias("graph_num_edges"))
    pairs = kept.select(group, F.explode(F.array(F.struct("src", "dst"), F.struct(c("dst").alias("src"), c("src").alias("dst")))).alias("e"))
    pairs = pairs.select(group, c("e.src").alias("node"), c("e.dst").alias("near")).distinct()
    degree = pairs.groupBy(group, "node").agg(F.count("*").alias("d"))
    n = degree.groupBy(group).agg(F.count("*").alias("graph_num_nodes"), F.avg("d").alias("graph_avg_degree"))
    nodes = c("graph_num_nodes")
    density = F.when(nodes > 1, 2 * c("graph_num_edges") / F.when(nodes > 1, nodes * (nodes - 1))).otherwise(0.0)
    out = n.join(m, group).withColumn("graph_density", density)
    if with_components:
        sizes = components(kept, group).groupBy(group, "component").agg(F.count("*").alias("n"))
        parts = sizes.groupBy(group).agg(F.count("*").alias("graph_num_components"), F.max("n").alias("graph_largest_component_size"))
        out = out.join(parts, group).withColumn("graph_largest_component_ratio", c("graph_largest_component_size") / nodes)
    return out


def ordered_strings(triplets: DataFrame, keys: list[str], order: str) -> DataFrame:
    """AGG-43: subjects, relations and objects of a group, joined in order."""
    one = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, x))), lambda e: e[x]), "; ").alias(f"{x}s")
    return triplets.groupBy(*keys).agg(one("subject"), one("relation"), one("object"))
