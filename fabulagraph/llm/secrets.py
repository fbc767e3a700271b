"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query of trigrams that any match must hold
(``trigram_query``, in disjunctive form).  ``build_index`` posts (trigram, doc_id) for
the trigrams of the queries, over ASCII-folded text; ``candidates`` intersects the
postings and leaves, per document, the rules whose query holds.  Only those are
verified with the regex.  A rule without mandatory trigrams is verified on every row.

Main path: DataFrame functions only.  What is shuffled is ids and bits; texts stay with
their scan as long as the counted candidates fit a broadcast, and beyond that move only
where they hold a posting at all.

Nulls and edges: a null text is read as empty; a row with a null id can't be found in
the index and is verified on all rules; rows that share an id are verified wherever one
of them is a candidate, so each gets its own exact spans; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulagraph.llm.columns import let
from fabulagraph.llm.store import checkpoint


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` reads the same in Java, Python and RE2.  Where ``group``
    is set, matches whose group has under ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])

#: Fixed patterns of the base kinds, then the kinds that this method adds.  For access and
#: hex a least length inside the pattern finds the same runs as dropping short ones after.
RULES = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", "AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", "[0-9a-f]{16,}", base=True),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----([A-Za-z0-9+/=\\x09-\\x0D\\x20]*?-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
)

#: A query is a set of conjunctions; the empty conjunction holds everywhere.
Query = frozenset[frozenset[str]]
TRUE: Query = frozenset([frozenset()])
_MOST_STRINGS, _MOST_TERMS = 64, 128


def _absorb(terms: set[frozenset[str]]) -> Query:
    return frozenset(t for t in terms if not any(o < t for o in terms))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > _MOST_TERMS:  # either alone is implied
        return min((a, b), key=len)
    return _absorb({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Query:
    return _absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _fold(code: int) -> str:
    c = chr(code)
    return c.lower() if "A" <= c <= "Z" else c


def _exact(op, arg) -> set[str] | None:
    """All (folded) strings that a node matches, if they are few."""
    if op is sre.LITERAL:
        return {_fold(arg)}
    if op is sre.IN:
        found: set[str] = set()
        for o, a in arg:
            if o is not sre.LITERAL:
                return None
            found.add(_fold(a))
        return found
    if op is sre.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is sre.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
        part = _exact_all(arg[2])
        return part and (part | {""} if arg[0] == 0 else part)
    return None


def _exact_all(items) -> set[str] | None:
    strings = {""}
    for op, arg in items:
        part = _exact(op, arg)
        if part is None or len(strings) * len(part) > _MOST_STRINGS:
            return None
        strings = {s + p for s in strings for p in part}
    return strings


def _query(op, arg) -> Query:
    if op is sre.SUBPATTERN:
        return _query_all(arg[-1])
    if op is sre.BRANCH:
        return _absorb(set().union(*[_query_all(x) for x in arg[1]]))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
        return _query_all(arg[2])
    return TRUE


def _query_all(items) -> Query:
    found, run = TRUE, {""}
    for op, arg in items:
        part = _exact(op, arg)
        if part is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {s + p for s in run for p in part}
            continue
        found = _both(found, _of_strings(run))
        run = part if part is not None and len(part) <= _MOST_STRINGS else {""}
        if part is None:
            found = _both(found, _query(op, arg))
    return _both(found, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Trigrams of ASCII-folded text that every match of the pattern holds, as an OR of ANDs."""
    return _query_all(parser.parse(pattern))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for term in trigram_query(r.pattern) for t in term})


def build_index(docs: DataFrame, trigrams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that occur in the folded text."""
    folded = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    held = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(x)), F.lit(x)) for x in trigrams])) if trigrams else F.array().cast("array<string>")
    return folded.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): bit *i* is set if the query of rule *i* holds on the document's postings.

    The postings of a document meet as bits, so the aggregation keeps one row per document
    and task before the shuffle.
    """
    number = {t: i for i, t in enumerate(vocabulary(rules))}
    words = range((len(number) + 61) // 62)
    at = F.create_map(*[F.lit(x) for t, i in number.items() for x in (t, i)])[F.col("trigram")]
    sums = [
        F.bit_or(F.when(F.floor(F.col("at") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at") % 62)).otherwise(F.lit(0).cast("long"))).alias(f"b{w}")
        for w in words
    ]
    by_doc = index.withColumn("at", at).groupBy("doc_id").agg(*sums)

    def holds(term: frozenset[str]) -> Column:
        parts = []
        for w in words:
            bits = sum(1 << (number[t] % 62) for t in term if number[t] // 62 == w)
            if bits:
                parts.append(F.col(f"b{w}").bitwiseAND(F.lit(bits)) == bits)
        return reduce(lambda a, b: a & b, parts)

    mask = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query != TRUE:
            mask = mask.bitwiseOR(F.when(reduce(lambda a, b: a | b, map(holds, query)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return by_doc.select("doc_id", mask.alias("rules")).where("rules <> 0")


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) in code points, of leftmost matches that don't overlap."""
    kind = "array<struct<start:int,number:int,end:int>>"

    def placed(found: Column) -> Column:
        sizes = F.transform(found, F.length)
        gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), sizes.alias("size"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("done"))

        def step(a: Column, x: Column) -> Column:
            first = a["at"] + x["gap"]
            one = F.struct(first.alias("start"), F.lit(number).alias("number"), (first + x["size"]).alias("end"))
            return F.struct((first + x["size"]).alias("at"), F.concat(a["done"], F.array(one)).alias("done"))

        spans = F.aggregate(pairs, start, step, lambda a: a["done"])
        if not rule.group:
            return spans
        return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: let(
            spans, lambda s: F.filter(s, lambda x, i: F.length(F.get(g, i)) >= rule.least)))

    none = F.array().cast(kind)
    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


#: Candidates (an id and a mask each) that are sent to every executor at most; 16 MB or so.
BROADCAST_ROWS = 400_000


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns of ``keep``, and ``spans``: (start, number of the rule, end), by start, then rule."""
    c = F.col
    full = sum(1 << i for i, r in enumerate(rules) if trigram_query(r.pattern) == TRUE)
    grams = vocabulary(rules)
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text"))
    found = checkpoint(candidates(build_index(rows, grams), rules))
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = found.select(c("doc_id").alias("_id"), "rules")
    if few:
        joined = rows.join(F.broadcast(found), c("doc_id") == c("_id"), "left")
    else:  # texts without any posting stay where they are
        folded = F.lower("text")
        posted = reduce(lambda a, b: a | b, [F.contains(folded, F.lit(x)) for x in grams]) & c("doc_id").isNotNull()
        moved = rows.where(posted).join(found, c("doc_id") == c("_id"), "left")
        joined = moved.unionByName(rows.where(~posted).withColumns({"_id": F.lit(None).cast(found.schema["_id"].dataType), "rules": F.lit(None).cast("long")}))
    on = F.when(c("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("rules", F.lit(0))).cast("long").bitwiseOR(F.lit(full).cast("long"))
    parts = [F.when(c("_on").bitwiseAND(F.lit(1 << i).cast("long")) != 0, _spans(c("text"), r, i)).otherwise(
        F.array().cast("array<struct<start:int,number:int,end:int>>")) for i, r in enumerate(rules)]
    return joined.withColumn("_on", on).select("doc_id", *keep, "text", F.array_sort(F.concat(*parts)).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span replaced by ``mark``; overlapping spans are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        ahead = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(ahead, F.lit(mark))).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        )

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    c = F.col
    count = lambda i: F.size(F.filter("spans", lambda s: s["number"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["number"] < 3)
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(c("spans")).alias("spans"),
    )


def _sql(text: str, table: str) -> str:
    """DuckDB SQL of (row_no, number, start, end) by the same rules, for ``table``(row_no, t)."""
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        keep = f"WHERE length(g[j]) >= {r.least}" if r.group else ""
        parts.append(f"""SELECT row_no, {i} AS number, s::INT AS start, (s + length(m[j]))::INT AS stop FROM (
  SELECT *, list_sum(list_transform(p[:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:j - 1], lambda x: length(x))), 0) AS s FROM (
    SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (
      SELECT row_no, regexp_extract_all({text}, '{pattern}') AS m, regexp_extract_all({text}, '{pattern}', {r.group}) AS g, regexp_split_to_array({text}, '{pattern}') AS p FROM {table}))) {keep}""")
    return "\nUNION ALL ".join(parts)


_KIND = "CASE number " + " ".join(f"WHEN {i} THEN '{r.kind}'" for i, r in enumerate(RULES)) + " END"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_sql("t", "d")}),
a AS (SELECT row_no, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
  coalesce(string_agg({_KIND} || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3), '') AS base,
  string_agg({_KIND} || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans FROM s GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row_no)
"""
