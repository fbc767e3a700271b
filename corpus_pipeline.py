"""The corpus pipeline: documents through five stages, each over all that its predecessor kept.

1. language ID: documents without a recognised language go; a null ``lang`` is filled.
2. n-gram join: of each group of near copies, the row of the least id stays.
3. decontamination: contaminated documents go.
4. secret scan: secrets are replaced in the text; no document goes.
5. mixing: how many words of each document the mix takes.

All but the last return the columns of ``documents``.  The first stage has no SQL, so
``ORACLE_SQL`` is None; tests compare the run with a plain Python version.

Nulls and edges: documents with null or blank texts have no language and go in the first
stage; rows with a null id can't be named as copies and pass the second; of rows that
share an id, one of each component stays; empty tables give empty results; columns beyond those of
``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulagraph.llm import decontaminate, language, mixing, ngram_join, secrets
from fabulagraph.llm.store import checkpoint, removed, sent, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(*COLUMNS)
    model = language.fit(rows.where(~language.held_out(F.col("doc_id"), 3, 1)))
    found = language.predict(rows, model).where(F.col("lang_pred") != language.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(*COLUMNS)
    groups = checkpoint(ngram_join.labelled(rows).where("doc_id is not null"))
    copies = checkpoint(groups.where("doc_id <> first.doc_id or node <> first.node").select("doc_id", "node").distinct())
    again = checkpoint(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    # ids that stand on one row name it; rows of the other ids are judged one by one
    gone = sent(copies.select("doc_id").union(again).distinct())
    kept = rows.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    if again.isEmpty():
        return kept
    rest = ngram_join.nodes(rows.join(again, "doc_id", "left_semi"), keep=COLUMNS[1:]).join(copies, ["doc_id", "node"], "left_anti")
    one = rest.where("node is not null").groupBy("doc_id", "node").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return kept.unionByName(one.select(*COLUMNS)).unionByName(rest.where("node is null").select(*COLUMNS))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[2:])
    return decontaminate.judged(scanned).where(~F.col("contaminated")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs.withColumn("_null", F.col("text").isNull()), keep=(*COLUMNS[2:], "_null"))
    text = F.when(F.col("_null"), F.lit(None).cast("string")).otherwise(
        F.when(F.size("spans") > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    )
    changed = F.size("spans") > 0
    return found.select("doc_id", text.alias("text"), "lang", "source", changed.alias("_c"), "n_chars").select(
        "doc_id", "text", "lang", "source", F.when(F.col("_c"), F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.op10(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again by the next; what the
    stage before it wrote is deleted then."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
            if before is not None:
                removed(before)
            before = docs
    return docs
