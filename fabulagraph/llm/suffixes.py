"""Repeated passages by sparse suffix arrays.

A document's suffixes are kept at minimisers alone: every window of ``LEAST`` words keeps the
leftmost of its runs of ``GRAM`` words whose hash is least.  The choice depends on the window's
content, so a passage that occurs twice keeps the same suffixes with the same windows.
Suffixes are sorted by gram and what follows; neighbours that share the gram are extended to the
right and to the left over the words that their windows can need, as 32-bit hashes, and a window
that two documents hold marks the passage in both, whatever else shares the gram.  Longer
passages are covered by several windows.

Sorting is one shuffle by the gram.  Grams that more than ``ROWS`` suffixes share are counted
first and dealt over as many tasks as they need; of theirs, windows that only one document of a part
holds, and two documents of each other window, meet by the windows' keys afterwards.  The count is of
what map tasks see at least ``SEEN`` times, and a hot gram that it misses is right too: a task streams it
in parts of ``ROWS``.

Nulls and edges: null texts, and texts of fewer than ``LEAST`` words, have no passage; a null
id takes part in no match; rows of one id are one document, whose own repeats don't count;
ties in the sort go by id and position; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulagraph.llm import hashing
from fabulagraph.llm.store import map_texts, sent, written

LEAST = 50
GRAM = 8
#: Suffixes judged at once; a gram that more of them share is judged in parts.
ROWS = 1 << 14
#: A map task names grams that it has seen so often, among so many.
SEEN, AMONG = 16, 1 << 20
_U = np.uint64

#: Words as they are, without folding.
_PLAIN = np.array([0 if b in {9, 10, 11, 12, 13, 32} else b or 256 for b in range(256)], np.uint16)


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Of each stretch of ``width`` grams, the position of the least; of equal ones, the leftmost."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        have += step
    return at


def _around(words: np.ndarray, at: np.ndarray, most_before: np.ndarray, most_after: np.ndarray, least: int, gram: int) -> np.ndarray:
    """Rows of 32-bit word hashes: after the gram, then before it, nearest first; 0 beyond what the row's windows hold."""
    short = np.maximum((words >> _U(20)).astype(np.uint32), np.uint32(1))
    side = least - gram
    padded = np.concatenate([np.zeros(side, np.uint32), short, np.zeros(side, np.uint32)])
    steps = np.arange(side)
    after = padded[at[:, None] + side + gram + steps] * (steps < most_after[:, None])
    before = padded[at[:, None] + side - 1 - steps] * (steps < most_before[:, None])
    # most significant byte first, so that bytes sort as words do
    return np.concatenate([after, before], axis=1).astype(">u4")


def _grams(texts: list[bytes], least: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text with a window: its number, words, grams, and the minimiser of each window."""
    for i, words in hashing.batches_of_words(texts, _PLAIN):
        if len(words) >= least:
            grams = hashing.runs(words, gram)
            yield i, words, grams, minimisers(grams, least - gram + 1)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def hot_grams(docs: DataFrame, least: int = LEAST, gram: int = GRAM, rows: int = ROWS) -> DataFrame:
    """(gram, parts) of grams that more than ``rows`` suffixes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def seen() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= SEEN
            return pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(n[some])], names=["gram", "n"])

        for batch in batches:
            for _, _, grams, owner in _grams(_bytes(batch), least, gram):
                held.append(grams[np.unique(owner)])
            if sum(map(len, held)) >= AMONG:
                yield seen()
                held = []
        if held:
            yield seen()

    found = map_texts(docs.where("doc_id is not null and text is not null").select("text"), run, "gram bigint, n bigint")
    found = found.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > rows)
    return found.select("gram", F.ceil(F.col("n") / F.lit(rows)).cast("int").alias("parts"))


def suffixes(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(gram, around, doc_id, at): the kept suffixes."""
    size = 8 * (least - gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            for i, words, grams, owner in _grams(_bytes(batch), least, gram):
                at, first, count = np.unique(owner, return_index=True, return_counts=True)
                # a suffix's windows begin next to each other
                before, after = at - first, least - gram - (at - first - count + 1)
                parts.append((np.full(len(at), i), grams[at], at, _around(words, at, before, after, least, gram)))
                if sum(len(p[1]) for p in parts) >= 1 << 16:
                    yield _rows(batch, parts, size)
                    parts = []
            if parts:
                yield _rows(batch, parts, size)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return map_texts(rows, run, f"gram bigint, around binary, doc_id {kind}, at int")


def _rows(batch: pa.RecordBatch, parts: list[tuple], size: int) -> pa.RecordBatch:
    which, grams, at, around = (np.concatenate([p[k] for p in parts]) for k in range(4))
    data = pa.py_buffer(around.tobytes())
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(at), [None, data])
    return pa.RecordBatch.from_arrays(
        [pa.array(grams.view(np.int64)), fixed.cast(pa.binary()), batch.column("doc_id").take(pa.array(which)), pa.array(at.astype(np.int32))],
        names=["gram", "around", "doc_id", "at"],
    )


def _windows(runs: np.ndarray, around: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the key of every window of ``side`` words beside the gram, by the number of words
    before it, and whether the text reaches as far."""
    n = len(runs)
    hashes, reach = [], []
    for part, seed in ((around[:, :side], 1), (around[:, side:], 2)):
        h = [np.full(n, seed, np.uint64)]
        for k in range(side):
            h.append(hashing.mix(h[-1] + part[:, k].astype(np.uint64) * _U(2 * k + 3)))
        hashes.append(h)
        none = part == 0
        reach.append(np.where(none.any(axis=1), none.argmax(axis=1), side))
    after, before = hashes
    keys = np.empty((n, side + 1), np.uint64)
    gram = runs.view(np.uint64)
    for k in range(side + 1):
        keys[:, k] = hashing.mix(gram + hashing.mix(after[side - k] + hashing.mix(before[k] + _U(k))))
    steps = np.arange(side + 1)
    return keys, (steps <= reach[1][:, None]) & (side - steps <= reach[0][:, None])


def _shared(rows: tuple, least: int, gram: int, open_run: int | None) -> pa.RecordBatch | None:
    """Stretches of the rows whose windows another document's row holds too; of hot rows and of the run
    ``open_run``, which have others elsewhere, also what these need to know: windows of one document, and
    two documents of each shared one."""
    side = least - gram
    runs, docs, at, around, hot = rows
    opened = hot | (runs == open_run) if open_run is not None else hot
    ids, codes = np.unique(docs, return_inverse=True)
    begin = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    several = np.minimum.reduceat(codes, begin) != np.maximum.reduceat(codes, begin)
    use = np.flatnonzero(np.repeat(several, np.diff(np.append(begin, len(runs)))) | opened)
    if not len(use):
        return None
    keys, ok = _windows(runs[use], around[use], side)
    row, before = np.nonzero(ok)
    if not len(row):
        return None
    key = keys[row, before]
    order = np.argsort(key, kind="stable")
    row, before, key = row[order], before[order], key[order]
    code = codes[use][row]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    lo = np.repeat(np.minimum.reduceat(code, begin), size)
    rest = np.where(code == lo, len(ids), code)
    next_lo = np.repeat(np.minimum.reduceat(rest, begin), size)
    hit = next_lo < len(ids)
    # all windows of a row hold its gram, so their union is one stretch
    most, fewest, partner = np.full(len(use), -1), np.full(len(use), side + 1), np.full(len(use), len(ids))
    np.maximum.at(most, row[hit], before[hit])
    np.minimum.at(fewest, row[hit], before[hit])
    np.minimum.at(partner, row[hit], np.where(code == lo, next_lo, lo)[hit])
    found = np.flatnonzero(most >= 0)
    who, first, end = codes[use][found], at[use][found] - most[found], at[use][found] - fewest[found] + least
    parts = [(ids[who], first, end, ids[partner[found]], np.zeros(len(found), np.int64), np.ones(len(found), bool))]
    if opened.any():
        wanted = opened[use][row]
        new = np.ones(len(key), bool)  # the first row of a key and document
        by_code = np.lexsort((code, key))
        new[by_code[1:]] = (key[by_code[1:]] != key[by_code[:-1]]) | (code[by_code[1:]] != code[by_code[:-1]])
        wanted &= ~hit | new & ((code == lo) | (code == next_lo))
        r, k = row[wanted], before[wanted]
        first = at[use][r] - k
        parts.append((ids[code[wanted]], first, first + least, ids[code[wanted]], key[wanted].view(np.int64), np.zeros(len(r), bool)))
    columns = [np.concatenate(x) for x in zip(*parts)]
    settled = columns[5]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32)), pa.array(columns[3]), pa.array(columns[4], mask=settled)],
        names=["doc_id", "first", "end", "partner", "key"],
    )


def _matcher(least: int, gram: int, rows: int):
    side = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        open_run = None  # the run that rows judged before belong to

        def judged(x: tuple) -> Iterator[pa.RecordBatch]:
            out = _shared(x, least, gram, open_run)
            if out is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            around = np.frombuffer(b"".join(batch.column("around").to_pylist()), ">u4").reshape(-1, 2 * side)
            own = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("gram", "doc_id", "at"))
            held.append((*own, around, batch.column("hot").to_numpy(zero_copy_only=False)))
            if sum(len(h[0]) for h in held) < rows:
                continue
            x = tuple(np.concatenate(c) for c in zip(*held))
            # whole runs are judged; the last goes on, unless it fills all
            last = int(np.flatnonzero(x[0] != x[0][-1])[-1]) + 1 if x[0][0] != x[0][-1] else 0
            if last:
                yield from judged(tuple(c[:last] for c in x))
                held = [tuple(c[last:] for c in x)]
            else:
                open_run = x[0][0]
                yield from judged(x)
                held = []
        if held:
            yield from judged(tuple(np.concatenate(c) for c in zip(*held)))

    return run


def matches(docs: DataFrame, least: int = LEAST, gram: int = GRAM, rows: int = ROWS) -> DataFrame:
    """(doc_id, first, end, partner): stretches of words that another document holds too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    c = F.col
    kept = suffixes(docs, least, gram).join(sent(hot_grams(docs, least, gram, rows)), "gram", "left")
    part = F.when(c("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), c("parts"))).cast("int")
    kept = kept.select("gram", part.alias("part"), "around", "doc_id", "at", c("parts").isNotNull().alias("hot"))
    kept = kept.repartition("gram", "part").sortWithinPartitions("gram", "around", "doc_id", "at")
    found = written(kept.mapInArrow(_matcher(least, gram, rows), f"doc_id {kind}, first int, end int, partner {kind}, key bigint"))
    left = found.where("key is not null").select("key", "doc_id", "first", "end")
    both = left.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi")
    met = left.join(both, "key").select("doc_id", "first", "end", F.when(c("doc_id") == c("lo"), c("hi")).otherwise(c("lo")).alias("partner"))
    return found.where("key is null").drop("key").unionByName(met)


def passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """One row per document with repeated passages: ``spans`` (first, end) of words, apart from each
    other, and ``partner``, the id of a document that holds one of them."""
    c = F.col
    in_order = Window.partitionBy("doc_id").orderBy("first", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    found = matches(docs, least, gram).withColumn("new", F.coalesce(c("first") > before, F.lit(True)).cast("int"))
    found = found.withColumn("span", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.groupBy("doc_id", "span").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.min("partner").alias("partner"))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"), F.min("partner").alias("partner"))


def op8(docs: DataFrame) -> DataFrame:
    """Every document's id with n_spans, n_repeated (words in repeated passages) and spans (first:end
    in words, comma-joined)."""
    found = passages(docs.select("doc_id", "text"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"].cast("string"), s["end"].cast("string"))), ",")
    found = found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), total.alias("n_repeated"), listed.alias("spans"))
    c = F.col
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce(c("n_spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce(c("n_repeated"), F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce(c("spans"), F.lit("")).alias("spans"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS k FROM (SELECT *, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
s AS (SELECT k FROM w GROUP BY k HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT DISTINCT doc_id, i FROM w JOIN s USING (k)),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_repeated, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (doc_id)
"""


def brute_force(docs: list[tuple], least: int = LEAST) -> dict:
    """doc_id to the set of words (by number) in windows of ``least`` words that another document holds, for tests."""
    where: dict[tuple, set] = {}
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = {}
    for d, w in split.items():
        hit: set[int] = set()
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                hit.update(range(i, i + least))
        out[d] = hit
    return out
