"""Quality rules as a bitmask ledger.

``ledger`` reads every text once.  It evaluates each rule of ``RULES`` once and
stores, beside the measurements, one ``fail_bits`` long with bit *i* set if rule
*i* fails.  Policies are versioned masks over those bits, so a new policy, or an
ablation of a policy, reads only the ledger.  No shuffle, no Python: all of it is
one projection over the scan.

Nulls and edges: a null text has no words and measures 0 everywhere, so it fails
``few_words``; an empty table gives an empty ledger; repeated rows and null ids
give one ledger row each; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulagraph.llm.columns import SPACE, let, without, words

#: Fixed values of the base measurements.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Hashes of the windows decide only whether there may be a repeat at all (equal
    windows have equal hashes); the count itself compares the windows' text.
    """

    def spans(w: Column) -> Column:
        return F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))

    def exact(w: Column) -> Column:
        ranked = F.array_sort(
            F.transform(spans(w), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i, WINDOW)).alias("k"), i.alias("p")))
        )

        def starts(s: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce(x["k"] == y["k"], F.lit(False))

            again = F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
            return F.array_sort(F.transform(again, lambda x: x["p"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(ranked, lambda s: let(starts(s), covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def counted(w: Column) -> Column:
        # words are hashed once, and windows by the hashes of their words
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
        once = let(hashes, lambda x: F.size(F.array_distinct(x)) == F.size(x))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(F.when(once, F.lit(0)).otherwise(exact(w)))

    return let(w, counted).cast("long")


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The measurements of each row, in one projection."""
    c = F.col
    t = F.coalesce(c(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(without(x, SPACE)) > 0)
    rows = docs.select(
        *keep, words(c(text)).alias("_words"), lines.alias("_lines"), F.length(without(t, SPACE)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    # words and lines are read several times, so they are columns of their own
    return rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(c("_words")).alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """Each rule's failure over the measurements, in the order of its bit."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeat_words": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 5 * c("word_chars"),
        "dup_lines": 10 * c("n_dup_lines") > 6 * c("n_lines"),
        "long_words": c("word_chars") > 40 * c("n_words"),
        "short_words": c("word_chars") < F.lit(1.5) * c("n_words"),
    }


RULES = ("few_words", "repeat_words", "symbols", "dup_lines", "long_words", "short_words")
BIT = {name: i for i, name in enumerate(RULES)}

#: Versioned policies: the rules of each, never changed after release.
POLICIES = {
    "base": ("few_words", "repeat_words"),
    "v1": ("few_words", "repeat_words", "symbols"),
    "v2": ("few_words", "repeat_words", "symbols", "dup_lines", "long_words", "short_words"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(1 << BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``fail_bits`` of each row."""
    bits = None
    for name, fails in rules().items():
        bit = F.when(fails, F.lit(1 << BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measured(docs, text, keep).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablate(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rows it fails, rows only it fails, rows kept with and without it.

    One aggregation over the ledger: rows are grouped by their masked bits first, at
    most ``2 ** len(rules)`` groups, and the bits of each group are read after that.
    """
    on = mask(policy)
    groups = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(on).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = POLICIES[policy]
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in names]))
    c = F.col

    def total(when: Column) -> Column:
        return F.sum(F.when(when, c("n")).otherwise(0))

    return (
        groups.select("bits", "n", one.alias("r"))
        .select("bits", "n", c("r.rule").alias("rule"), c("r.bit").alias("bit"))
        .groupBy("rule")
        .agg(
            total(c("bits").bitwiseAND(c("bit")) != 0).alias("n_fail"),
            total(c("bits") == c("bit")).alias("n_only"),
            total(c("bits") == 0).alias("n_kept"),
            total((c("bits") == 0) | (c("bits") == c("bit"))).alias("n_kept_without"),
        )
    )


def op1(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The contract's columns, from the ledger under ``policy``."""
    c = F.col
    book = apply_policy(ledger(docs.select("doc_id", "text")), policy)
    failed = c("fail_bits").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & c("kept")).alias("kept"), "fail_bits",
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT row_no, i AS pos, array_to_string(words[i:i + 4], ' ') AS win
      FROM (SELECT row_no, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT row_no, pos FROM k QUALIFY count(*) OVER (PARTITION BY row_no, win) > 1),
n AS (SELECT row_no, sum(step) AS n FROM (
        SELECT row_no, least(5, coalesce(lead(pos) OVER (PARTITION BY row_no ORDER BY pos) - pos, 5)) AS step FROM r) GROUP BY row_no),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN n USING (row_no)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 5 * word_chars)::BIGINT
             + 8 * (10 * n_dup_lines > 6 * n_lines)::BIGINT + 16 * (word_chars > 40 * n_words)::BIGINT
             + 32 * (word_chars < 1.5 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       (fail_bits & 7) = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b
"""
