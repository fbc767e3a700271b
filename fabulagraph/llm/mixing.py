"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... take the points of a golden-ratio sequence (a Kronecker sequence
in 40-bit integers, so that it is exact at any length).  Each point falls into one
source's stretch of the cumulative weights; a slot's rank among its source's slots
says which block of the source it takes.  A source's documents lie in shuffled order
(by md5 of the id) on a line of words, which is cut into blocks as long as those of all
other sources and walked ``PASSES`` times at most.  So the slots that a source wins decide how
much of it is taken: their number is near its share, since the sequence's discrepancy is a few
slots at any length, and a block is short against the smallest target.

Nothing runs over one source as a whole: ranks and positions are prefix sums in two
levels (about sqrt(n) groups of sqrt(n) rows), so a source with a third of all rows
is spread over many tasks.  Slots and blocks meet on (source, rank).

Nulls and edges: a null text has size 0 and is taken 0 times; a null source is a
source of its own, the last; rows with equal or null ids are placed by size next and
counted each; an empty table gives an empty mix; if no text has words, targets are 0.
Columns other than ``doc_id``, ``text`` and ``source`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulagraph.llm.columns import count_words
from fabulagraph.llm.store import checkpoint

#: Fixed values of the contract: weights by the source's place, share of all words, most passes.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
#: Words of a slot: at most BLOCK and a LEAST_SLOTS-th of the smallest target, unless that made more than
#: MOST_SLOTS slots and more than SLOTS_PER_DOC slots a document.
BLOCK = 1024
LEAST_SLOTS = 512
MOST_SLOTS = 1 << 20
SLOTS_PER_DOC = 16
#: The golden ratio's fraction in 40 bits; odd, so the points of 2 ** 40 slots are all different.
GOLDEN = 679_528_905_981
BITS = 40
#: Cells that points and stretches meet in; a cell holds the sources whose stretches cross it.
GRID = 4096


def point(i: Column) -> Column:
    """``GOLDEN * i mod 2 ** 40`` without overflow, for i below 2 ** 40."""
    high, low = F.floor(i / F.lit(1 << 20)).cast("long"), i % F.lit(1 << 20)
    top = (high * F.lit(GOLDEN)) % F.lit(1 << 20) * F.lit(1 << 20)
    return (top + (low * F.lit(GOLDEN)) % F.lit(1 << BITS)) % F.lit(1 << BITS)


def targets(sizes: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: place, source_size, n_docs, target, and its stretch of the weights.

    ``sizes`` is (source, size) per document.  Sources whose cap is low for their weight
    reach it first.  In that order, ``level`` is the words per weight that are left if all
    earlier ones are at their caps; it rises up to the first source below its cap and falls
    after it, so its highest value is where nothing is left to share out again.  The
    one-partition windows read a row per source.
    """
    c = F.col
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(c("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (c("place") % len(weights)) + 1)
    by_cap = Window.orderBy((c("cap") / c("weight")).asc(), c("place").asc())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        per.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("cap", (c("source_size") * passes).cast("double"))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("left", c("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", c("left") / F.sum("weight").over(after))
        .withColumn("target", F.least(c("cap"), F.max("level").over(whole) * c("weight")))
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("all_words", F.sum("words").over(whole))
        .withColumn("upto", F.sum("words").over(upto))
        .select("place", "source", "source_size", "n_docs", "target", "words", "all_words",
                (c("upto") - c("words")).alias("from_word"), c("upto").alias("to_word"))
    )


def _prefix(df: DataFrame, key: list[str], group: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of ``key``, by ``group`` and then ``order``."""
    groups = df.groupBy(*key, group).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*key).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*key, group, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*key, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(groups, [*key, group])
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_base", "_in")
    )


def block_of(goal: DataFrame, most: int = BLOCK) -> tuple[int, int]:
    """(words of a slot, slots) of a mix; ``goal`` is the result of ``targets``."""
    least = F.min(F.when(F.col("words") > 0, F.col("words")))
    n, least, docs = goal.agg(F.coalesce(F.max("all_words"), F.lit(0)), F.coalesce(least, F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    block = max(1, min(most, least // LEAST_SLOTS), -(-n // max(MOST_SLOTS, SLOTS_PER_DOC * docs)))
    return block, -(-n // block)


def schedule(goal: DataFrame, n: int) -> DataFrame:
    """The ``n`` slots (slot, place, rank) of the targets ``goal``.

    A source that has a target and that no point meets, as may happen where the bound on slots holds, gets one
    slot after them.
    """
    spark = goal.sparkSession
    c = F.col
    step = max(1024, int(n**0.5))
    goal = goal.where("words > 0")
    stretch = goal.select("place", "all_words", "from_word", "to_word")
    points = spark.range(0, n, 1, max(1, min(n // 4096, 100_000))).select(
        c("id").alias("slot"), (point(c("id")) / F.lit(float(1 << BITS))).alias("u"), F.floor(c("id") / F.lit(step)).alias("chunk")
    )
    # each stretch lies in some cells of a grid over [0, 1); a point looks in its own cell alone
    start, end = c("from_word") / c("all_words"), c("to_word") / c("all_words")
    last = F.least(F.lit(GRID - 1), F.floor(end * GRID))
    cells = stretch.select("place", end.alias("e"), F.explode(F.sequence(F.least(last, F.floor(start * GRID)), last)).alias("cell"))
    cells = cells.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("e", c("place").alias("p")))).alias("ends"))
    held = F.filter("ends", lambda x: x["e"] > c("u"))
    met = points.withColumn("cell", F.floor(c("u") * GRID)).join(cells, "cell").select(
        "slot", "chunk", F.coalesce(F.get(held, F.lit(0))["p"], F.element_at("ends", -1)["p"]).alias("place")
    )
    unmet = stretch.join(met.select("place").distinct(), "place", "left_anti").select(
        (F.lit(n) + c("place")).cast("long").alias("slot"), F.lit(n // step + 1).cast("long").alias("chunk"), c("place")
    )
    slots = met.select("slot", "chunk", "place").unionByName(unmet)
    return _prefix(slots, ["place"], "chunk", [c("slot")], F.lit(1), "rank").select("slot", "place", "rank")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, pieces).

    ``members`` has a row per document: row (place, bucket, pos), doc_id, source, size,
    source_size, target.  ``pieces`` lists what each slot takes: row, slot, rank, and the
    first and end word in the document.
    """
    c = F.col
    sizes = checkpoint(docs.select(c(doc_id).alias("doc_id"), c(source).alias("source"), count_words(c(text)).alias("size")))
    goal = checkpoint(targets(sizes))
    key = F.md5(F.coalesce(c("doc_id").cast("string"), F.lit("")))
    spread = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    members = (
        sizes.join(goal.select("place", "source", "source_size", "n_docs", "target"), sizes["source"].eqNullSafe(goal["source"]))
        .drop(goal["source"])
        .withColumn("key", key)
        .withColumn("bucket", F.floor(spread * F.ceil(F.sqrt("n_docs"))).cast("long"))
    )
    order = [c("key"), c("doc_id").asc_nulls_first(), c("size")]
    members = _prefix(members, ["place"], "bucket", order, c("size"), "at")
    members = members.withColumn("pos", F.row_number().over(Window.partitionBy("place", "bucket").orderBy(*order)))
    members = checkpoint(members.drop("key", "n_docs"))
    words, n = block_of(goal, block)
    slots = schedule(goal, n)
    # a pass puts the document at ``at`` plus the words of the passes before; each stretch of a block meets its slot, if there is one
    passed = members.where("size > 0").select(
        "place", "bucket", "pos", "doc_id", "size",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(PASSES - 1)), lambda k: c("at") + k * c("source_size"))).alias("lo"),
    ).withColumn("hi", c("lo") + c("size"))
    cut = passed.select(
        "place", "bucket", "pos", "doc_id", "lo", "hi", F.explode(F.sequence(F.floor(c("lo") / F.lit(words)), F.floor((c("hi") - 1) / F.lit(words)))).alias("rank")
    )
    first, end = F.greatest(c("lo"), c("rank") * F.lit(words)), F.least(c("hi"), (c("rank") + 1) * F.lit(words))
    pieces = cut.join(slots, ["place", "rank"]).select(
        "place", "bucket", "pos", "doc_id", "slot", "rank", (first - c("lo")).alias("first"), (end - c("lo")).alias("end")
    )
    return members, pieces


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns: what the slots take of each document, summed."""
    c = F.col
    members, pieces = mix(docs)
    row = ["place", "bucket", "pos"]
    taken = pieces.groupBy(*row).agg(F.sum(c("end") - c("first")).alias("taken"))
    return members.join(taken, row, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


ORACLE = r"""
WITH s AS (SELECT row_number() OVER () AS row_no, doc_id, source,
                  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM {docs}),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s GROUP BY source),
q AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, (2 * source_size)::DOUBLE AS cap FROM p),
v AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q WINDOW o AS (ORDER BY cap / weight, place)),
t AS (SELECT source, place, source_size, least(cap, max(level) OVER () * weight) AS target FROM v),
z AS (SELECT *, round(target)::BIGINT AS words, (sum(round(target)::BIGINT) OVER ())::BIGINT AS all_words, (sum(round(target)::BIGINT) OVER (ORDER BY place))::BIGINT AS upto FROM t),
k AS (SELECT max(all_words) AS all_words, greatest(1, least(1024, min(words) FILTER (words > 0) // 512), ceil(max(all_words) / greatest(1048576, 16 * (SELECT count(*) FROM s)))::BIGINT) AS block FROM z),
i AS (SELECT unnest(range(0, (all_words + block - 1) // block)) AS slot FROM k WHERE all_words > 0),
u AS (SELECT slot, ((679528905981::HUGEINT * slot) % 1099511627776)::DOUBLE / 1099511627776 AS u FROM i),
c AS (SELECT place, count(*) AS n_slots FROM u JOIN z ON words > 0 AND u.u >= (upto - words)::DOUBLE / all_words AND u.u < upto::DOUBLE / all_words GROUP BY place),
l AS (SELECT s.doc_id, s.size, z.source_size, z.target, CASE WHEN z.words > 0 THEN greatest(1, coalesce(c.n_slots, 0)) * (SELECT block FROM k) ELSE 0 END AS words,
             (sum(s.size) OVER (PARTITION BY z.place ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id NULLS FIRST, s.size, s.row_no
                                ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS place_at
      FROM s JOIN z ON s.source IS NOT DISTINCT FROM z.source LEFT JOIN c ON c.place = z.place)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(place_at + size, words) - place_at)
        + greatest(0, least(place_at + source_size + size, words) - place_at - source_size))::BIGINT AS taken FROM l
"""
