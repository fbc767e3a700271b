"""Whole plans: curating personas, and trimming and comparing regimes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulagraph.functions import lexicon as L
from fabulagraph.functions import text as T
from fabulagraph.functions.oracle import Oracle, StubOracle, aged, judged
from fabulagraph.operators import metrics as M
from fabulagraph.operators import stats as S
from fabulagraph.operators import tables as R


def curate(
    records: DataFrame, category: str, keywords: list[str], done: DataFrame | None = None, oracle: Callable[[], Oracle] = StubOracle, least: int = L.MIN_CONFIDENCE
) -> DataFrame:
    """Personas of a category from (source_config, idx, persona_text): relevance, exclusion, resume, rule
    reasons, age by rules and then by asking, judgement, acceptance.

    Cheap rules come first in the plan, so the model sees only what they leave; what was
    judged before (``done``: persona_id) isn't asked again.
    """
    c = F.col
    rows = records.where(T.contains_any(c("persona_text"), keywords) & ~T.contains_any(c("persona_text"), L.EXCLUDE[category]))
    rows = rows.withColumn("persona_id", T.persona_key(c("source_config"), c("idx")))
    if done is not None:
        rows = R.resume(rows, done, ["persona_id"])
    rows = rows.withColumn("age", T.age_by_phrase(c("persona_text")))
    known = rows.where("age is not null")
    asked = aged(rows.where("age is null"), oracle).withColumn("age", T.final_age(c("persona_text"), c("age_asked"), c("age_group")))
    rows = known.unionByName(asked.select(known.columns))
    why = T.high_school_reasons(c("persona_text"), c("age")) if category == "highschool" else T.school_reasons(c("persona_text"), c("age"), category)
    rows = rows.withColumn("strict_reject_reasons", why).where(F.size("strict_reject_reasons") == 0)
    return R.accepted(judged(rows, oracle), least)


def trimmed_stats(triplets: DataFrame, run: str = "run_id") -> dict[str, DataFrame]:
    """Persona statistics with graph metrics, trimmed by quantiles and capped; and the personas that fell out."""
    c = F.col
    stats = M.persona_stats(triplets)
    owner = triplets.groupBy("persona_text").agg(F.min(run).alias(run))
    graph = M.graph_metrics(triplets.select(run, c("subject").alias("src"), c("object").alias("dst")), run)
    stats = S.kept(stats.join(owner, "persona_text").join(graph, run, "left"))
    trimmed = S.quantile_trim(stats, L.TRIMMED, *L.TRIM_QUANTILES)
    return {
        "stats": stats, "trimmed": trimmed, "clean": S.iqr_cap(trimmed, L.CAPPED, L.IQR_FACTOR), "removed": R.resume(stats.select("persona_id"), trimmed, ["persona_id"]),
    }


def regime_tests(stats: DataFrame, metrics: list[str] = L.TESTED) -> DataFrame:
    """Kruskal-Wallis tests of the metrics over regimes, with p-values."""
    rows = reduce(DataFrame.unionByName, [S.kruskal(stats, m) for m in metrics])
    return rows.withColumn("p_value", S.chi2_tail(F.col("H"), F.col("groups") - 1))
