"""Relational operators on personas, triplets and files (FIL-*, JOIN-*, WIN-*, SRC-*, AGG-38..42)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulagraph.functions import lexicon as L
from fabulagraph.functions import text as T
from fabulagraph.operators.lineage import cut


def require(df: DataFrame, columns: set[str], how: str = "raise") -> DataFrame | None:
    """FIL-32 and the guards of readers: ``raise``, ``skip`` (None) or ``empty`` where columns are missing."""
    missing = sorted(columns - set(df.columns))
    if not missing:
        return df
    if how == "raise":
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return None if how == "skip" else df.limit(0)


def union_aligned(frames: list[DataFrame], as_text: bool = False) -> DataFrame:
    """SET-1, SRC-5, SRC-22: union by name; with ``as_text``, sorted columns of clean strings, '' for nulls."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if not as_text:
        return out
    clean = lambda n: F.coalesce(F.regexp_replace(F.translate(F.col(n).cast("string"), "\u0000", ""), r"[\r\n]+", " "), F.lit("")).alias(n)
    return out.select(*[clean(n) for n in sorted(out.columns)])


def accepted(personas: DataFrame, least: int = 80) -> DataFrame:
    """FIL-15, SRC-21: judged yes with enough confidence, and of known age."""
    return personas.where((F.col("llm_label") == "yes") & (F.col("llm_confidence") >= least) & F.col("age").isNotNull())


def resume(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """FIL-16, JOIN-4, JOIN-5, SRC-17: rows whose key isn't among those done."""
    return candidates.join(done.select(*keys).distinct(), keys, "left_anti")


def kept_only(triplets: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-3, SRC-15: rows whose key is kept."""
    return triplets.join(kept.select(*keys).distinct(), keys, "left_semi")


def keep_ratio(triplets: DataFrame, kept: DataFrame, keys: list[str], group: str) -> DataFrame:
    """SRC-15: kept and total rows per group."""
    marked = triplets.join(kept.select(*keys).distinct().withColumn("_k", F.lit(1)), keys, "left")
    return marked.groupBy(group).agg(F.sum(F.coalesce("_k", F.lit(0))).alias("kept"), F.count("*").alias("total"))


def attach(stats: DataFrame, attributes: DataFrame, key: str, order: str) -> DataFrame:
    """JOIN-1: the attributes of the first row of each key; those that clash are renamed ``_attr``."""
    others = [c for c in attributes.columns if c != key]
    first = attributes.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_a"))
    return stats.join(first, key, "left").select(*stats.columns, *[F.col(f"_a.{c}").alias(c if c not in stats.columns else f"{c}_attr") for c in others])


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """WIN-4: the first row of each key, by aggregation, so that map tasks drop repeats first."""
    best = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*rows.columns), order).alias("_r"))
    return best.select("_r.*")


def first_of_normalised(triplets: DataFrame, order: str, within: list[str]) -> DataFrame:
    """WIN-5: the first of triplets that are equal but for case and outer blanks."""
    norm = [T.strip(F.lower(F.col(c))).alias(f"_{c}") for c in ("subject", "relation", "object")]
    best = triplets.groupBy(*within, *norm).agg(F.min_by(F.struct(*[c for c in triplets.columns if c not in within]), order).alias("_r"))
    return best.select(*within, "_r.*")


def numbered(rows: DataFrame, order: str, name: str = "row_no") -> DataFrame:
    """A running number by ``order`` without one sorted task: range partitions are counted first."""
    parts = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    parts = cut(parts)
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (
        parts.join(F.broadcast(ahead), "_p")  # a row per partition
        .withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy(order)))
        .drop("_p", "_before")
    )


def shard(rows: DataFrame, order: str, shards: int, which: int) -> DataFrame:
    """WIN-3: every ``shards``-th row by ``order``."""
    return numbered(rows, order).where((F.col("row_no") - 1) % shards == which).drop("row_no")


def chunks(rows: DataFrame, order: str, size: int = 50) -> DataFrame:
    """SRC-13: adds the number of the chunk of ``size`` rows."""
    return numbered(rows, order).withColumn("chunk", F.floor((F.col("row_no") - 1) / size)).drop("row_no")


def hub_first(triplets: DataFrame, hubs: DataFrame, order: str) -> DataFrame:
    """WIN-6: place of each triplet if those with the run's hub as subject come first."""
    joined = triplets.join(hubs.select("run_id", F.col("node").alias("_hub")), "run_id", "left")
    late = F.coalesce((F.col("subject") != F.col("_hub")).cast("int"), F.lit(1))
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(late, order))).drop("_hub")


def capped(rows: DataFrame, keys: list[str], order: str, most: int = 3) -> DataFrame:
    """WIN-7: at most ``most`` rows of a key (the limit is the operator's meaning)."""
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_i") <= most).drop("_i")


def enough(rows: DataFrame, group: str, least: int) -> DataFrame:
    """FIL-17: rows of groups that have ``least`` rows."""
    counts = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return rows.join(counts, rows[group].eqNullSafe(counts["_g"]), "left_semi")


def balanced(rows: DataFrame, group: str, key: str, seed: int = 42) -> DataFrame:
    """AGG-40: as many rows of each group as the smallest has, chosen by a seeded hash.

    Ranks come from counts per slice of the hash and ranks inside a slice, so a large group
    is not sorted in one task.
    """
    c = F.col
    slices = 1 << 12
    marked = rows.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_s", F.pmod("_h", F.lit(slices)))
    counts = marked.groupBy(group, "_s").agg(F.count("*").alias("_n"))
    ahead = counts.select(
        c(group).alias("_g"), c("_s").alias("_t"),
        F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    least = counts.groupBy(group).agg(F.sum("_n").alias("n")).agg(F.min("n").alias("_least")).withColumn("_one", F.lit(1))
    ranked = marked.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_s").orderBy("_h", key)))
    ranked = ranked.join(ahead, c(group).eqNullSafe(c("_g")) & (c("_s") == c("_t"))).withColumn("_one", F.lit(1))
    return ranked.join(F.broadcast(least), "_one").where(c("_before") + c("_i") <= c("_least")).select(*rows.columns)  # one row


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """AGG-42: n rows by a seeded hash (sampling is the operator's meaning)."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def outcome_counts(judged: DataFrame, outcome: Column) -> DataFrame:
    """AGG-39, AGG-46: rows by outcome, nulls counted."""
    return judged.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def previous_text(sentences: DataFrame, n: int = 5) -> DataFrame:
    """WIN-19, WIN-20: the last n sentences before each, joined by blanks."""
    w = Window.partitionBy("run_id").orderBy("sentence_index").rowsBetween(-n, -1)
    return sentences.withColumn("context", F.array_join(F.collect_list("text").over(w), " "))


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """WIN-17, WIN-18: the first n rows (the limit is the operator's meaning)."""
    return rows.orderBy(*order).limit(n)


def young(rows: DataFrame, category: str, most: int = 11) -> DataFrame:
    """WIN-21: of known age up to ``most`` and not excluded, by age."""
    return rows.where((F.col("age") <= most) & ~T.contains_any(F.col("persona_text"), L.EXCLUDE[category])).orderBy("age")


def profile(rows: DataFrame, value: str) -> DataFrame:
    """AGG-45: n, mean, deviation and quartiles of a column in one row."""
    x = F.col(value).cast("double")
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")
    one = rows.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count_distinct(x).alias("n_distinct"), q)
    return one.select("n", "mean", "std", "n_distinct", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("min", "q1", "median", "q3", "max"))])


def distinct_meanings(triplets: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-14, NLP-13, NLP-14: drops one of two triplets of a subject that say the same with an adjective and a noun.

    ``is`` with the adjective beats ``has`` with the noun, and the other way round; which
    objects are adjectives comes as ``object_pos``.  Pairs meet on the subject and the kinds
    of both sides only, never all with all.
    """
    c = F.col
    rows = triplets.withColumn("_o", T.strip(F.lower("object"))).withColumn("_s", T.strip(F.lower("subject"))).withColumn("_r", T.strip(F.lower("relation")))
    one = lambda pos, n: rows.where(c("object_pos") == pos).select(*keys, "_s", c("_o").alias(f"_{n}"), c("_r").alias(f"_r{n}")).distinct()
    pairs = one("ADJ", "adj").join(one("NOUN", "noun"), [*keys, "_s"])
    near = T.derived_lemmas(c("_adj"), c("_noun")) | T.swapped_ends(c("_adj"), c("_noun")) | T.similar_strings(c("_adj"), c("_noun"))
    pairs = pairs.where(near & (((c("_radj") == "is") & (c("_rnoun") == "has")) | ((c("_radj") == "has") & (c("_rnoun") == "is"))))
    winners = pairs.where(c("_radj") == "has").select(*keys, "_s", F.lit("has").alias("_r"), c("_adj").alias("_o"))
    beaten = pairs.where(c("_radj") == "is").select(*keys, "_s", F.lit("has").alias("_r"), c("_noun").alias("_o"))
    return rows.join(winners.unionByName(beaten).distinct(), [*keys, "_s", "_r", "_o"], "left_anti").select(*triplets.columns)


def paragraphs(texts: DataFrame, text: str = "text") -> DataFrame:
    """SRC-9: (…, pos, drp, paragraph) of texts with DRP="n" marks; paragraphs without text fall out."""
    keep = [c for c in texts.columns if c != text]
    parts = texts.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r'(?=DRP="[\d.]+")')).alias("pos", "block"))
    drp = F.nullif(F.regexp_extract("block", r'DRP="([\d.]+)"', 1), F.lit("")).try_cast("double")
    plain = F.regexp_replace(F.regexp_replace("block", r"<[^>]+>", ""), r'DRP="[\d.]+"', "")
    lines = F.filter(F.transform(F.split(plain, r"\R"), T.strip), lambda x: x != "")
    return parts.select(*keep, "pos", drp.alias("drp"), F.array_join(lines, " ").alias("paragraph")).where("drp is not null and paragraph <> ''")


def indented_paragraphs(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """SRC-10: a line that begins with white space opens a paragraph; blank lines and markup fall out."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\R")).alias("line_no", "line"))
    lines = lines.where((T.strip(F.col("line")) != "") & ~T.strip(F.col("line")).startswith("<"))
    opens = F.col("line").rlike(r"^\s").cast("int")
    island = F.sum(opens).over(Window.partitionBy(key).orderBy("line_no"))
    lines = lines.withColumn("island", island)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", T.strip(F.col("line")).alias("x")))), lambda e: e["x"]), " ")
    return lines.groupBy(key, "island").agg(joined.alias("paragraph"))
