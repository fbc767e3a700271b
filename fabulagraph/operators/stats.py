"""Summaries, trimming, tests and correlations over persona statistics (AGG-9..35, WIN-1, WIN-2, JOIN-12)."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulagraph.operators.lineage import cut


def _quantile(x: str, q: float) -> Column:
    return F.percentile(x, F.lit(q))


def running(values: DataFrame, keys: list[str], x: str, n: str) -> DataFrame:
    """Adds ``before``, the sum of ``n`` over rows of the same keys and lesser ``x``, and ``total``, that over all rows of the keys.

    Range partitions are summed first, and windows hold a partition's rows of a key: a group, and the
    table as a whole, may be of any size.  Keys may be null.
    """
    c = F.col
    parts = cut(values.repartitionByRange(*keys, x).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy(*keys, "_p").agg(F.sum(n).alias("_s"))  # a row per partition and key
    whole = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("_s").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[c(k).alias(f"_{k}") for k in keys], c("_p").alias("_q"), ahead.alias("_ahead"), F.sum("_s").over(whole).alias("total"))
    inside = F.sum(n).over(Window.partitionBy(*keys, "_p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in keys], c("_p") == c("_q"))
    out = parts.withColumn("_in", F.coalesce(inside, F.lit(0))).join(sums, same)
    return out.withColumn("before", c("_ahead") + c("_in")).drop("_in", "_ahead", "_p", "_q", *[f"_{k}" for k in keys])


def quantiles(stats: DataFrame, metrics: list[str], at: list[float]) -> DataFrame:
    """One row of ``{metric}`` arrays: the metrics' quantiles, interpolated, from running counts of their distinct values."""
    c = F.col
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).cast("double").alias("x")) for m in metrics])).alias("v")
    values = stats.select(each).select("v.*").where("x is not null").groupBy("metric", "x").agg(F.count("*").alias("n"))
    placed = running(values, ["metric"], "x", "n")
    place = lambda q: (c("total") - 1) * F.lit(float(q))
    found = placed.groupBy("metric").agg(F.first(c("total")).alias("total"), *[
        F.min(F.when(c("before") + c("n") > f(place(q)), c("x"))).alias(f"{k}{i}") for i, q in enumerate(at) for k, f in (("lo", F.floor), ("hi", F.ceil))])
    value = [c(f"lo{i}") + (c(f"hi{i}") - c(f"lo{i}")) * (place(q) - F.floor(place(q))) for i, q in enumerate(at)]
    return found.select("metric", F.array(*value).alias("q")).groupBy().agg(*[F.max(F.when(c("metric") == m, c("q"))).alias(m) for m in metrics])


def regime_summary(stats: DataFrame, metrics: list[str], group: str = "regime", digits: int = 3) -> DataFrame:
    """AGG-9, AGG-10, SET-5, JOIN-2: rows (stat, group, n, metrics); null groups are left out.

    One aggregation gives all statistics; a stack turns them into rows.
    """
    c = F.col
    rows = stats.where(c(group).isNotNull())
    kinds = {
        "mean": lambda m: F.avg(m), "median": lambda m: _quantile(m, 0.5), "std": lambda m: F.stddev_samp(m),
        "iqr": lambda m: _quantile(m, 0.75) - _quantile(m, 0.25),
    }
    wide = rows.groupBy(group).agg(F.count("*").alias("n"), *[f(m).alias(f"{k}_{m}") for k, f in kinds.items() for m in metrics])
    each = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("stat"), *[F.bround(c(f"{k}_{m}"), digits).alias(m) for m in metrics]) for i, k in enumerate(kinds)])
    return wide.select(group, "n", F.explode(each).alias("x")).select("x.stat", group, "n", *[f"x.{m}" for m in metrics])


def quantile_trim(stats: DataFrame, metrics: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """AGG-11: rows inside the quantiles of every metric, all taken from the untrimmed rows; nulls fall out."""
    c = F.col
    bounds = quantiles(stats, metrics, [low, high]).withColumnsRenamed({m: f"_{m}" for m in metrics}).withColumn("_one", F.lit(1))
    inside = [c(m).between(F.get(c(f"_{m}"), F.lit(0)), F.get(c(f"_{m}"), F.lit(1))) for m in metrics]
    joined = stats.withColumn("_one", F.lit(1)).join(F.broadcast(bounds), "_one")  # one row
    return joined.where(reduce(lambda a, b: a & b, inside)).select(*stats.columns)


def iqr_cap(stats: DataFrame, metrics: list[str], k: float = 1.5) -> DataFrame:
    """AGG-12: values above the third quartile plus k times the range come down to it."""
    c = F.col
    quarters = quantiles(stats, metrics, [0.25, 0.75]).withColumnsRenamed({m: f"_{m}" for m in metrics}).withColumn("_one", F.lit(1))
    q = lambda m, i: F.get(c(f"_{m}"), F.lit(i))
    capped = {m: F.when(c(m).isNotNull(), F.least(c(m).cast("double"), q(m, 1) + k * (q(m, 1) - q(m, 0)))) for m in metrics}
    return stats.withColumn("_one", F.lit(1)).join(F.broadcast(quarters), "_one").withColumns(capped).select(*stats.columns)  # one row


def winsorize(stats: DataFrame, group: str, metric: str, k: float = 1.5, least: int = 1) -> DataFrame:
    """AGG-13, AGG-14: both sides, within groups of ``least`` rows or more that have a range.

    Quartiles come from an aggregation and a join, so no group is sorted in one window.
    """
    c = F.col
    per = stats.groupBy(c(group).alias("_g")).agg(F.count(metric).alias("_n"), F.percentile(metric, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    q1, q3 = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    on = (c("_n") >= least) & (q3 - q1 != 0)
    clipped = F.greatest(q1 - k * (q3 - q1), F.least(q3 + k * (q3 - q1), c(metric).cast("double")))
    value = F.when(c(metric).isNotNull(), F.when(on, clipped).otherwise(c(metric).cast("double")))
    return stats.join(per, stats[group].eqNullSafe(per["_g"]), "left").withColumn(metric, value).select(*stats.columns)


def average_ranks(rows: DataFrame, x: str, alias: str) -> DataFrame:
    """Adds the average rank of ``x`` over all rows.

    Ranks are running counts of the distinct values: a value's rows share one rank, and only the
    table of distinct values is put in order, in range partitions.
    """
    c = F.col
    values = running(rows.groupBy(x).agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1)), ["_one"], x, "_n")
    ranks = values.select(c(x).alias("_x"), (c("before") + (c("_n") + 1) / 2).alias(alias))
    return rows.join(ranks, c(x) == c("_x")).drop("_x")


def _gamma_tail(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + t * d or 1e-300)
            c = 1 + t / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_tail(h: Column, df: Column) -> Column:
    """P-value of a chi-squared statistic (a row per test)."""

    @F.pandas_udf("double")
    def tail(h: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else _gamma_tail(k / 2, x / 2) for x, k in zip(h, df)])

    return tail(h, df.cast("double"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation (a row per pair)."""

    @F.pandas_udf("double")
    def tail(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or k < 3 else _beta((k - 2) / 2, 0.5, max(0.0, 1 - x * x)) for x, k in zip(r, n)])

    return tail(r, n.cast("double"))


def kruskal(stats: DataFrame, metric: str, group: str = "regime") -> DataFrame:
    """AGG-15, AGG-16: one row (metric, test, H, groups) corrected for ties; null with under two groups."""
    c = F.col
    rows = average_ranks(stats.where(c(metric).isNotNull() & c(group).isNotNull()).select(group, metric), metric, "_rank")
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum("_rank").alias("r"))
    ties = rows.groupBy(metric).agg(F.count("*").alias("t")).agg(F.sum(c("t").cast("double") * c("t") * c("t") - c("t")).alias("ties"))
    total = per.agg(F.sum("n").cast("double").alias("n"), F.sum(c("r") * c("r") / c("n")).alias("s"), F.count("*").alias("groups"))
    one = total.withColumn("_one", F.lit(1)).join(ties.withColumn("_one", F.lit(1)), "_one")  # a row each
    h = (12 / (c("n") * (c("n") + 1)) * c("s") - 3 * (c("n") + 1)) / (1 - c("ties") / (c("n") * c("n") * c("n") - c("n")))
    return one.select(F.lit(metric).alias("metric"), F.lit("Kruskal-Wallis").alias("test"), F.when(c("groups") >= 2, h).alias("H"), "groups")


def correlations(stats: DataFrame, metrics: list[str], method: str = "pearson") -> DataFrame:
    """AGG-17, JOIN-13: rows (a, b, r, n) over rows without nulls, all pairs from one aggregation."""
    rows = stats.select(*metrics).dropna()
    names = metrics
    if method == "spearman":
        for m in metrics:
            rows = average_ranks(rows, m, f"_r_{m}")
        names = [f"_r_{m}" for m in metrics]
    pairs = [(i, j) for i in range(len(metrics)) for j in range(i + 1, len(metrics))]
    wide = rows.agg(F.count("*").alias("n"), *[F.corr(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")).alias(f"r{i}_{j}") for i, j in pairs])
    each = F.array(*[F.struct(F.lit(metrics[i]).alias("a"), F.lit(metrics[j]).alias("b"), F.col(f"r{i}_{j}").alias("r")) for i, j in pairs])
    return wide.select("n", F.explode(each).alias("x")).select("x.a", "x.b", "x.r", "n")


def partial_correlations(stats: DataFrame, metrics: list[str], group: str = "regime") -> DataFrame:
    """AGG-18: correlations of what is left after the group's mean."""
    rows = stats.select(group, *metrics).dropna()
    means = rows.groupBy(group).agg(*[F.avg(m).alias(f"_m_{m}") for m in metrics])
    rest = rows.join(F.broadcast(means), group).select(*[(F.col(m) - F.col(f"_m_{m}")).alias(m) for m in metrics])  # a row per regime
    return correlations(rest, metrics)


def masked(pairs: DataFrame, most: float = 0.05) -> DataFrame:
    """AGG-20: p-values, and correlations blanked where p isn't below ``most``."""
    return pairs.withColumn("p", correlation_p(F.col("r"), F.col("n"))).withColumn("r_masked", F.when(F.col("p") < most, F.col("r")))


def verdict(pairs: DataFrame, most: float = 0.05) -> DataFrame:
    """AGG-21."""
    c = F.col
    return masked(pairs, most).withColumn("verdict", F.when(c("p") >= most, "NO EFFECT").when(c("r") > 0, "INCREASES").otherwise("DECREASES"))


def regime_zscores(stats: DataFrame, metrics: list[str], group: str = "regime") -> DataFrame:
    """AGG-19: medians by group, standardised over the groups; NaN where all groups have the same median."""
    whole = Window.partitionBy()
    medians = stats.groupBy(group).agg(*[_quantile(m, 0.5).alias(m) for m in metrics])  # a row per regime

    def score(m: str) -> Column:
        spread = F.stddev_pop(m).over(whole)
        return F.when(spread == 0, F.lit(float("nan"))).otherwise((F.col(m) - F.avg(m).over(whole)) / spread).alias(m)

    return medians.select(group, *[score(m) for m in metrics])


def ecdf(stats: DataFrame, metric: str, group: str = "regime", order: str = "persona_id") -> DataFrame:
    """WIN-1, WIN-2: (group, x, y); equal values rise one by one.

    Places are running counts by value and ``order`` in range partitions, so neither a group nor the rows of
    one value meet in a window.
    """
    c = F.col
    rows = stats.where(c(metric).isNotNull()).select(c(group).alias("_group"), F.struct(c(metric).alias("x"), c(order).alias("o")).alias("_at"))
    places = running(rows.groupBy("_group", "_at").agg(F.count("*").alias("_n")), ["_group"], "_at", "_n")
    each = places.withColumn("i", F.explode(F.sequence(F.lit(1), c("_n"))))
    return each.select(c("_group").alias(group), c("_at.x").alias("x"), ((c("before") + c("i")) / c("total")).alias("y"))


def box_summary(stats: DataFrame, metric: str, group: str = "regime", log: bool = False) -> DataFrame:
    """AGG-25..34: five numbers and n per group, on log10(x + 1) if asked."""
    x = F.log10(F.col(metric) + 1) if log else F.col(metric).cast("double")
    five = stats.where(F.col(group).isNotNull()).withColumn("_x", x).groupBy(group).agg(
        F.count("_x").alias("n"), F.percentile("_x", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")
    )
    return five.select(group, "n", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("low", "q1", "median", "q3", "high"))])


def pairwise_median_diff(stats: DataFrame, metric: str, group: str = "regime") -> DataFrame:
    """JOIN-12: difference of medians for each pair of groups in order (a row per regime is joined)."""
    m = stats.where(F.col(group).isNotNull()).groupBy(group).agg(_quantile(metric, 0.5).alias("m"))
    a, b = m.select(F.col(group).alias("a"), F.col("m").alias("ma")), m.select(F.col(group).alias("b"), F.col("m").alias("mb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", (F.col("mb") - F.col("ma")).alias("diff"))


def frequencies(stats: DataFrame, value: str, group: str = "regime") -> DataFrame:
    """AGG-23: counts of every value in every group, zero where there are none."""
    seen = stats.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    grid = seen.groupBy(group).agg(F.lit(1).alias("_one")).join(F.broadcast(seen.select(value).distinct().withColumn("_one", F.lit(1))), "_one")
    return grid.join(seen, [group, value], "left").select(group, value, F.coalesce("n", F.lit(0)).alias("n"))


def crosstab_share(stats: DataFrame, value: str, group: str = "regime") -> DataFrame:
    """AGG-24 in rows: the share of each value in its group."""
    seen = stats.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    total = seen.groupBy(F.col(group).alias("_g")).agg(F.sum("n").alias("_t"))
    return seen.join(total, F.col(group).eqNullSafe(F.col("_g"))).select(group, value, (F.col("n") / F.col("_t")).alias("share"))


def bootstrap_ci(stats: DataFrame, metric: str, group: str = "regime", times: int = 5000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """AGG-22, AGG-27, AGG-30: interval of the mean over seeded Poisson resamples.

    Every row gets a weight per resample from a hash, so resampling is one aggregation over
    rows by resample, whatever the group's size, and reruns agree.
    """
    c = F.col
    rows = stats.where(c(metric).isNotNull()).select(group, c(metric).cast("double").alias("x"), F.xxhash64(F.lit(seed), "persona_id").alias("h"))
    each = rows.select(group, "x", "h", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("b"))
    u = F.pmod(F.xxhash64("h", "b"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    steps, total, p = [], 0.0, math.exp(-1)
    for k in range(9):
        total += p
        steps.append(total)
        p /= k + 1
    weight = reduce(lambda a, b: a + b, [F.when(u >= t, 1).otherwise(0) for t in steps])
    means = each.withColumn("w", weight).groupBy(group, "b").agg((F.sum(c("w") * c("x")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    q = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q")
    return means.groupBy(group).agg(q).select(group, F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def median_interval(stats: DataFrame, metric: str, group: str = "regime", times: int = 5000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """AGG-27, AGG-30: (group, median, low, high), the interval over seeded Poisson resamples.

    A resample of a group's distinct values gives each a Poisson number of copies, by its count, and the
    median is where the copies' running sum passes half: rows count once, before any resampling.
    """
    c = F.col
    values = kept(stats.where(c(metric).isNotNull()).groupBy(group, c(metric).cast("double").alias("x")).agg(F.count("*").alias("n")))
    each = values.select(group, "x", "n", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("b"))
    # a sum of n Poisson weights is Poisson of mean n; by the normal law with its variance, rounded
    u1, u2 = ((F.pmod(F.xxhash64(F.lit(seed + k), c(group), "x", "b"), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30)) for k in (0, 1))
    normal = F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    w = F.greatest(F.lit(0.0), F.round(c("n") + F.sqrt("n") * normal))
    run = Window.partitionBy(group, "b").orderBy("x")
    each = each.withColumn("w", w).withColumn("upto", F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(Window.partitionBy(group, "b")))
    medians = each.where((c("all") > 0) & (2 * c("upto") >= c("all"))).groupBy(group, "b").agg(F.min("x").alias("m"))
    ends = medians.groupBy(group).agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"))
    whole = values.groupBy(group).agg(F.expr("percentile(x, 0.5, n)").alias("median"))
    return whole.join(ends, whole[group].eqNullSafe(ends[group])).select(whole[group], "median", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def kept(stats: DataFrame) -> DataFrame:
    """The table written once, for plans that read it several times."""
    return cut(stats)


def coverage(stats: DataFrame, column: str) -> DataFrame:
    """AGG-35: share of rows that have the value."""
    return stats.agg(F.avg(F.col(column).isNotNull().cast("double")).alias("coverage"))
