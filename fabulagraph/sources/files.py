"""Readers and writers of the engine's files (SRC-1..5, SRC-11..17, SRC-21)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulagraph.functions import text as T
from fabulagraph.operators.metrics import persona_stats
from fabulagraph.operators.tables import require, resume

#: Column to type of the triplet and persona files.
TRIPLETS = {
    "original_index": "bigint", "age_refined": "int", "persona_text": "string", "story_text": "string", "model_name": "string", "subject": "string",
    "relation": "string", "object": "string", "sentence_index": "bigint", "introduced_at": "int", "regime": "string", "active": "boolean",
}
PERSONAS = {
    "idx": "bigint", "persona_text": "string", "age": "double", "source_config": "string", "strict_reject_reasons": "string", "llm_label": "string",
    "llm_confidence": "bigint", "llm_reason": "string", "age_refined": "double", "age_refine_confidence": "double", "age_refine_reason": "string",
}
#: What names a triplet among those written before.
TRIPLET_KEY = ["original_index", "subject", "relation", "object", "introduced_at"]


def _csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding)


def personas(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """SRC-1: CSV or Parquet; a column ``persona`` serves as ``persona_text``.

    Bytes that aren't UTF-8 show as U+FFFD; ``encoding="windows-1252"`` reads such files.
    """
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else _csv(spark, path, encoding)
    if "persona_text" not in rows.columns and "persona" in rows.columns:
        rows = rows.withColumn("persona_text", F.col("persona"))
    return rows.select(*[F.col(c).try_cast(PERSONAS[c]).alias(c) if c in PERSONAS else F.col(c) for c in rows.columns])


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: CSV with columns of the schema's names in any order; unnamed columns fall out, a missing
    ``model_name`` is null, a missing required column leaves no rows; adds ``source_file``."""
    rows = _csv(spark, path).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = rows.select(*[c for c in rows.columns if not c.startswith("Unnamed") and not c.startswith("_c")])
    if "model_name" not in rows.columns:
        rows = rows.withColumn("model_name", F.lit(None).cast("string"))
    if "relation" not in rows.columns:
        rows = rows.withColumn("relation", F.lit("<NO_RELATION>"))
    rows = require(rows, {"original_index", "age_refined", "persona_text", "subject", "object", "regime"}, "empty")
    return rows.select(*[F.col(c).try_cast(TRIPLETS[c]).alias(c) if c in TRIPLETS else F.col(c) for c in rows.columns])


def of_model(rows: DataFrame, tag: str) -> DataFrame:
    """SRC-3, SRC-4: rows of the model's final triplet files."""
    name = F.lower("source_file")
    return rows.where(name.startswith(f"model_{tag.lower()}") & F.contains(name, F.lit("_final_triplets_")) & name.endswith(".csv"))


def tagged_union(frames: dict[str, DataFrame]) -> DataFrame:
    """SRC-5: rows of several sources by name, each with its ``source_config``."""
    out = None
    for name, rows in frames.items():
        rows = rows.withColumn("source_config", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def merge_chunks(rows: DataFrame, path: str, regime: str | None = None) -> None:
    """SRC-11: chunk files by model and regime of their names; other names are left out."""
    model, found = T.model_and_regime(F.col("source_file"))
    kept = rows.withColumn("model", model).withColumn("file_regime", found).where("model is not null")
    kept = kept if regime is None else kept.where(F.col("file_regime") == regime)
    kept.write.partitionBy("model", "file_regime").mode("overwrite").parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """SRC-16, SRC-17: appends rows whose key isn't there yet; a rerun adds nothing."""
    spark, keys = rows.sparkSession, keys or TRIPLET_KEY
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = resume(rows, spark.read.parquet(path), keys)
    rows.dropDuplicates(keys).write.mode("append").parquet(path)


def idempotent_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """SRC-16..20 for streams: a function for ``foreachBatch``; the query's checkpoint is the progress."""
    return lambda rows, _: append_new(rows, path, keys)


def save_outputs(trimmed: DataFrame, clean: DataFrame, removed: DataFrame, path: str) -> None:
    """SRC-14."""
    for name, rows in (("trimmed", trimmed), ("clean", clean), ("removed", removed)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def persona_stats_of_files(spark: SparkSession, path: str) -> DataFrame:
    """AGG-37: statistics over triplet files; the regime is the file name's, and a name without one is an error."""
    rows = triplets(spark, path)
    model, regime = T.model_and_regime(F.col("source_file"))
    named = F.coalesce(regime, F.raise_error(F.concat(F.lit("no regime in the name of "), F.col("source_file"))))
    return persona_stats(rows.withColumn("regime", named))
