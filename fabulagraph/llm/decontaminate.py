"""Benchmark decontamination with an Aho-Corasick automaton.

The symbols of the automaton are normalised words.  A window is 13 consecutive words of an item;
of every 13 words in a row, some 7 begin at a multiple of 7, so the automaton's patterns are an item's
words by sevens, and the whole of items that have no window.  Each text is scanned once; where a pattern
occurs, the match is extended to the left and right as far as text and item agree, and if it has 13 words
or more they are all words of windows.  Hits are numbers of words, and map back to code points
of the original text.

The automaton is one for all items.  It is built in each worker from broadcast item texts, once for as
long as the worker lives, and holds about as many words as the items do.  Beyond ``BLOCK_CHARS`` characters of items,
which a worker's memory can't be relied on to hold, there are several, and the texts are written and scanned again for each.

Nulls and edges: a null text has no words and is not contaminated; an item without words
or with a null text has no window; items with a null id are left out, and ids are of any type; items
with equal ids count as one; ties cannot arise; an empty benchmark hits nothing; an empty table
gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulagraph.llm.store import map_texts, written

#: Fixed values of the contract.
WINDOW = 13
#: Words of a pattern: a window holds one that begins at a multiple of it.
PIECE = 7
#: Characters of items that an automaton holds, about 15 bytes of memory each.
BLOCK_CHARS = 32_000_000

#: Bytes to normalised bytes: A-Z to lower case; other ASCII but digits and a-z parts words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Matcher:
    """The automaton over (item_id, text) rows."""

    def __init__(self, items: list[tuple[object, str]]):
        numbers: dict[bytes, int] = {}
        self.ids: list[object] = []
        self.items: list[tuple[int, array]] = []  # (number of the id, words)
        patterns: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        place: dict[object, int] = {}
        for item, text in items:
            words = array("i", (numbers.setdefault(w, len(numbers) + 1) for w in normalised((text or "").encode())))
            if words and item is not None:
                at = len(self.items)
                self.items.append((place.setdefault(item, len(place)), words))
                if len(words) < WINDOW:
                    patterns.setdefault(tuple(words), []).append((at, 0))
                else:
                    for i in range(0, len(words) - PIECE + 1, PIECE):
                        patterns.setdefault(tuple(words[i : i + PIECE]), []).append((at, i))
        self.numbers, self.ids = numbers, list(place)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, found in patterns.items():
            self.automaton.add_word(words, (len(words), tuple(found)))
        self.some = bool(patterns)
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged hit ranges in words, item ids."""
        words = normalised(text or b"")
        if not self.some or not words:
            return len(words), [], set()
        seq = tuple(map(self.numbers.get, words, repeat(0)))
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        done: dict[tuple[int, int], int] = {}  # (item, how far its words are ahead) to where the text has been compared
        for end, (n, found) in self.automaton.iter(seq):
            first = end - n + 1
            for at, i in found:
                number, item = self.items[at]
                if len(item) < WINDOW:
                    if n == len(item):
                        ranges.append((first, end + 1))
                        items.add(number)
                    continue
                if n != PIECE or done.get((at, i - first), -1) > first:
                    continue
                a, b = first, end + 1
                shift = i - first
                while a and a + shift and seq[a - 1] == item[a + shift - 1]:
                    a -= 1
                while b < len(seq) and b + shift < len(item) and seq[b] == item[b + shift]:
                    b += 1
                done[at, shift] = b
                if b - a >= WINDOW:
                    ranges.append((a, b))
                    items.add(number)
        return len(words), merge(ranges), {self.ids[i] for i in items}


#: The last automaton that this worker has built, and for which items.
_BUILT: list = [None, None]


def _matcher(name: str, items: Broadcast) -> Matcher:
    if _BUILT[0] != name:
        _BUILT[:] = [None, None]
        _BUILT[:] = [name, Matcher(items.value)]
    return _BUILT[1]


def _scanner(items: Broadcast):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, items)
        for batch in batches:
            n_words, hits, ids = [], [], []
            texts = batch.column("text").cast(pa.binary())
            before = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for text, had, own in zip(texts, *before):
                n, ranges, found = matcher.scan(text.as_py())
                n_words.append(n)
                hits.append(merge([(x["first"], x["end"]) for x in had] + ranges) if had else ranges)
                ids.append(sorted(found.union(own)))
            as_hits = pa.array([[{"first": a, "end": b} for a, b in x] for x in hits], batch.schema.field("hits").type)
            columns = {"n_words": pa.array(n_words, pa.int64()), "hits": as_hits, "items": pa.array(ids, batch.schema.field("items").type)}
            yield pa.RecordBatch.from_arrays(
                [columns.get(f.name, batch.column(f.name)) for f in batch.schema], schema=batch.schema
            )

    return run


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def in_original(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of code points of the original text."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in hits]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> list[Broadcast]:
    """The items, in blocks of bounded size if need be, each collected and broadcast by itself."""
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars * 4 // (3 * block_chars)) if chars > block_chars else 1)
    share = [rows if n == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == b) for b in range(n)]
    return [spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()]) for part in share]


def scan(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text, ``keep``, n_words, ``hits`` (ranges of words) and ``items`` (ids, ascending)."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id", "text", *keep, F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:int,end:int>>").alias("hits"), F.array().cast(f"array<{kind}>").alias("items"),
    )
    for k, items in enumerate(blocks(benchmark, block_chars=block_chars)):
        rows = map_texts(rows if k == 0 else written(rows), _scanner(items), rows.schema)
    return rows


def spans(scanned: DataFrame) -> DataFrame:
    """doc_id and ``spans``: the hit ranges in code points of the original text, of hit documents."""
    kind = scanned.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [
                [{"start": a, "end": b} for a, b in in_original(text, [(h["first"], h["end"]) for h in hits])]
                for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, of)], names=["doc_id", "spans"])

    rows = scanned.where(F.size("hits") > 0).select("doc_id", "text", "hits")
    return map_texts(rows, run, f"doc_id {kind}, spans array<struct<start:int,end:int>>")


def judged(scanned: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + (h["end"] - h["first"]))
    c = F.col
    return scanned.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")}).withColumn(
        "contaminated", (c("n_hit") > 0) & (20 * c("n_hit") >= c("n_words"))
    )


def op3(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return judged(scan(docs.select("doc_id", "text"), benchmark)).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(listed, 256).alias("items_sha256"), "contaminated"
    )


def brute_force(docs: list[tuple], benchmark: list[tuple]) -> dict:
    """doc_id to (n_words, n_hit, n_items, items_sha256, contaminated), window by window, for tests."""
    split = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in _WORD.findall(t or "")]
    windows: dict[tuple, set] = {}
    for item, text in benchmark:
        w = split(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w and item is not None else 0):
            windows.setdefault(tuple(w[i : i + WINDOW]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        named = ",".join(sorted(map(str, ids)))
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(named.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(len(w), 13) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT row_no, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM h) GROUP BY row_no),
s AS (SELECT row_no, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT row_no, item_id FROM h) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (row_no) LEFT JOIN s USING (row_no)
"""
