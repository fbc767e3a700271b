"""N-gram Jaccard self-join by universe partition and pigeonhole.

A text's set is its distinct word shingles, as 64-bit hashes.  Sets go in bands by size.
In a band, the universe of hashes is cut into segments, and a set into one subset a
segment.  Two sets whose similarity reaches the threshold differ by at most H elements,
a bound of the band, so by the pigeonhole principle some segments must agree.  Every set
posts signatures of its subsets to its own band, and to lower bands that a similar set
may lie in:

* a segment of threshold 0 posts the hash of its subset (it matches if nothing differs);
* a segment of threshold 1 also posts the subset without each one element (it matches if
  at most one element differs), which counts twice in the pigeonhole.

``allocate`` chooses the number of segments and of thresholds 1 per band by estimated
cost.  Empty subsets would collide in many sets and are not posted; a set with more empty
segments than the allocation allows for posts them after all, so no link is lost.

Equal sets are one node.  Signatures meet in sorted runs; map tasks pair their own rows
first, so a signature in a third of all rows sends a row a task.  In the first round, each
node is verified, exactly and on the shingle sets of the texts, against the most widely
shared nodes of its signatures.  A second round takes the signatures whose members are not all
connected yet, one for each set of members, and verifies pairs across components whose sketches
allow the similarity.  A sketch has at least as many bytes as half the set's elements, so it lets
pass what is similar or nearly so.  Where very many nodes share a signature, each node looks others
up by subsets and one-deletion neighbourhoods, in the segments that cost least.  What signatures
need to know of all their members comes from aggregates, joined back, so a hot signature is
split over tasks.  Components come from contraction.

Nulls and edges: a null or blank text has an empty set and is linked with nothing; rows
with equal sets are always linked, repeated rows and equal ids too; a null id takes part,
and ``component_id`` is the least id of the component that isn't null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulagraph.llm import hashing
from fabulagraph.llm.components import components
from fabulagraph.llm.store import checkpoint, map_texts, sent

#: Fixed values of the contract.
SHINGLE = 4
PERCENT = 85
#: A band's sizes end below its start times this.
BAND_GROWTH = 1.18
#: For the cost: share of shingles that unlike texts have in common, and the cost of a
#: chance collision in posted rows.
COMMON = 0.3
COLLISION = 200.0

_U = np.uint64


def _bands() -> Iterator[tuple[int, int]]:
    lo = 1
    while True:
        hi = max(lo + 1, int(lo * BAND_GROWTH))
        yield lo, hi
        lo = hi


@lru_cache(maxsize=None)
def _edges(upto: int) -> tuple[int, ...]:
    out = []
    for lo, _ in _bands():
        out.append(lo)
        if lo > upto:
            return tuple(out)


def bands_of(size: int, percent: int = PERCENT) -> list[int]:
    """Bands that a set of the size posts to: its own and those of smaller similar sets."""
    edges = _edges(1 << int(size).bit_length())
    least = -(-percent * size // 100)
    first, last = np.searchsorted(edges, [least, size], "right") - 1
    return list(range(int(first), int(last) + 1))


def _sizes(band: int) -> tuple[int, int]:
    edges = _edges(64)
    while band + 1 >= len(edges):
        edges = _edges(edges[-1] * 2)
    return edges[band], edges[band + 1] - 1


@lru_cache(maxsize=None)
def most_different(band: int, percent: int = PERCENT) -> int:
    """Elements that similar sets, the smaller one of the band, differ by at most."""
    _, most = _sizes(band)
    return (100 - percent) * (most + most * 100 // percent) // (100 + percent)


@lru_cache(maxsize=None)
def allocate(band: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(segments, segments of threshold 1, allowed loss by empty segments) of a band.

    With y of the band and x at least as large, at most H elements differ.  Thresholds 0
    count 1 and thresholds 1 count 2; together they must exceed H plus the allowed loss.
    Of all such choices, the one of least estimated cost is taken.
    """
    lo, most = _sizes(band)
    differ = most_different(band, percent)
    best = None
    for loss in range(0, 1 + max(1, differ // 40)):
        need = differ + 1 + loss
        for ones in sorted({0, *(need * k // 16 for k in range(9))}):
            m = need - ones
            if m < max(1, ones) or m > most:
                continue
            size = (lo + most) / 2 / m
            empty = np.exp(-size)
            over = max(0.0, 1 - loss / max(1e-9, 4 * m * empty)) if m > 1 else 0.0
            rows = m + ones * size
            chance = (m - ones) * COMMON**size + ones * (1 + 2 * size) * COMMON ** max(0.0, size - 1) + over * m * empty
            cost = rows + COLLISION * chance
            if best is None or cost < best[0]:
                best = cost, (m, ones, loss)
    return best[1] if best else (1, 0, 0)


def _cut(hashes: np.ndarray, band: int, m: int) -> tuple[np.ndarray, ...]:
    """Of a set in a band of ``m`` segments: segment of each element, sizes, sums and salts of the segments, element values."""
    element = hashing.mix(hashes + _U(0x51ED270B))
    # segments are equal stretches of the hashes' range, so a sorted set lies in order
    place = (((hashes >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
    ends = np.searchsorted(place, np.arange(m), "right")
    sizes = np.diff(ends, prepend=0)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(element, dtype=np.uint64)])
    salt = hashing.mix(np.arange(m, dtype=np.uint64) + _U(band * 0x100000001 + 1))
    return place, sizes, total[ends] - total[ends - sizes], salt, element


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """What a set (ascending hashes) posts, for all its bands."""
    out = []
    for band in bands_of(len(hashes), percent):
        m, ones, loss = allocate(band, percent)
        place, sizes, subset, salt, element = _cut(hashes, band, m)
        lost = int((sizes[ones:] == 0).sum()) + 2 * int((sizes[:ones] <= 1).sum())
        keep = sizes > 0 if lost <= loss else np.ones(m, bool)
        out.append(hashing.mix(subset + salt)[keep])
        if ones:
            cut = int(sizes[:ones].sum())
            seg = place[:cut]
            some = (sizes[seg] > 1) | (lost > loss)
            out.append(hashing.mix(subset[seg] - element[:cut] + salt[seg])[some])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def neighbourhoods(hashes: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per band: keys of the subsets, and of the subsets without one element, with the segments of these.

    Segments are finer than those of ``signatures``: a node that may choose among them finds
    more that few others share.
    """
    for band in bands_of(len(hashes), percent):
        place, _, subset, salt, element = _cut(hashes, band, 2 * (most_different(band, percent) + 1))
        yield band, hashing.mix(subset + salt), hashing.mix(subset[place] - element + salt[place]), place


def fingerprint(hashes: np.ndarray) -> int:
    """The node of a set: equal sets have the same."""
    a = hashing.mix(np.array([hashing.mix(hashes + _U(77)).sum(dtype=np.uint64) + _U(len(hashes))], np.uint64))
    return int(a.view(np.int64)[0])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def nodes(docs: DataFrame, n: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, node) and ``keep``; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for _, words in hashing.batches_of_words(_texts(batch)):
                s = hashing.shingles(words, n)
                sizes.append(len(s))
                found.append(fingerprint(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.int64()), *(batch.column(k) for k in keep)],
                names=["doc_id", "n_shingles", "node", *keep],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_texts(docs.select("doc_id", "text", *(k for k in keep if k != "text")), run, f"doc_id {kind}, n_shingles bigint, node bigint{kept}")


def _starred(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of (sig, node): where a run of a signature begins, and each row's run's least node."""
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    return first, node[np.flatnonzero(first)][np.cumsum(first) - 1]


#: Posted rows that a map task holds and pairs at once (24 bytes each).
PAIRED_ROWS = 1 << 21


def _own_stars(sigs: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    sig, node = np.concatenate(sigs).view(np.int64), np.concatenate(owners)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    first, least = _starred(sig, node)
    star = pa.array(least, pa.int64(), mask=first)
    for lo in range(0, len(sig), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(sig[part]), pa.array(node[part]), star[part]], names=["sig", "node", "star"])


def postings(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(sig, node, star): a node posts a signature; ``star`` is set if the map task has paired the row already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0
        for batch in batches:
            for _, words in hashing.batches_of_words(_texts(batch)):
                s = hashing.shingles(words, n)
                if len(s) and (node := fingerprint(s)) not in seen:
                    seen.add(node)
                    sigs.append(signatures(s, percent))
                    owners.append(np.full(len(sigs[-1]), node, np.int64))
                    held += len(sigs[-1])
                if held >= PAIRED_ROWS:
                    yield from _own_stars(sigs, owners)
                    sigs, owners, seen, held = [], [], set(), 0
        if sigs:
            yield from _own_stars(sigs, owners)

    return map_texts(docs.select("text"), run, "sig bigint, node bigint, star bigint")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings in the order of (sig, star nulls first, node): (sig, node, star) of rows that have a partner."""
    last, least = None, None
    for batch in batches:
        sig, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
        done = batch.column("star")
        open_ = np.asarray(done.is_null())
        star = np.asarray(done.fill_null(0))
        at = np.flatnonzero(open_)
        if len(at):
            first, own = _starred(sig[at], node[at])
            if last is not None and sig[at[0]] == last:  # the run goes on from the batch before
                run = len(first) if first[1:].sum() == 0 else int(np.flatnonzero(first[1:])[0]) + 1
                own[:run] = least
            star = star.copy()
            star[at] = own
            last, least = sig[at[-1]], own[-1]
        keep = star != node
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep]), pa.array(star[keep])], names=["sig", "node", "star"])


def candidates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(sig, node, star): nodes that share a signature with others, each with one of them."""
    posted = postings(docs, n, percent)
    # rows that are paired already only pass through: they go anywhere
    to = F.when(F.col("star").isNull(), F.col("sig")).otherwise(F.col("node"))
    return posted.repartition(to).sortWithinPartitions("sig", "node").mapInArrow(_meet, "sig bigint, node bigint, star bigint")


def verify(pairs: DataFrame, texts: DataFrame, n: int = SHINGLE, percent: int = PERCENT, salts: int = 8) -> DataFrame:
    """The pairs (a, b) of nodes that are similar; ``texts`` has (node, text), one text a node at least.

    Texts of b meet the text of a in runs of a, which are split by a salt: a task keeps one
    set at a time, however many partners it has.
    """
    c = F.col
    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")
    own = pairs.select("a", salt.alias("salt")).distinct().join(texts.withColumnRenamed("node", "a"), "a")
    own = own.select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")
    others = pairs.join(texts.withColumnRenamed("node", "b"), "b").select("a", salt.alias("salt"), "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            found: list[tuple[int, int]] = []
            for i, words in hashing.batches_of_words(_texts(batch)):
                s = hashing.shingles(words, n)
                if fingerprint(s) != (a[i] if b[i] is None else b[i]):
                    continue  # another text of the same id
                if b[i] is None:
                    held, mine = a[i], s
                elif held == a[i]:
                    both = len(np.intersect1d(mine, s, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(s) - both):
                        found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    met = own.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", c("b").asc_nulls_first())
    return map_texts(met.drop("salt"), run, "a bigint, b bigint")


def _texts_of(wanted: DataFrame, named: DataFrame, docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(node, text) of the wanted nodes: one document each, or those of one id where texts share it;
    what reads the texts leaves out the others."""
    ids = checkpoint(named.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    some = sent(ids.where("doc_id is not null"))
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found = rows.join(some, "doc_id").select("node", "text")
    lone = ids.where("doc_id is null").select("node")
    if lone.isEmpty():
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (hashing.shingles(words, n) for _, words in hashing.batches_of_words(_texts(batch)))
            owners = [fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), batch.column("text")], names=["node", "text"])

    unnamed = map_texts(docs.where(F.col("doc_id").isNull()).select("text"), run, "node bigint, text string")
    return found.unionByName(unnamed.join(lone, "node").groupBy("node").agg(F.min("text").alias("text")))


#: The nodes of signatures that at most so many share are compared by sketches; those of larger ones are searched by allocation.
MIDDLE_GROUP = 8192
#: Nodes that stand for a signature in the first round: of as many parts of its nodes, the one whose signatures most nodes share.
HUBS = 2

_DELETED, _LOWER = _U(0x2545F4914F6CDD1D), _U(0x5851F42D4C957F2D)


def _index(batches: Iterator[pa.RecordBatch], n: int, percent: int, probe: bool) -> Iterator[pa.RecordBatch]:
    """From (node, text): keys of all subsets and one-deletion neighbourhoods.

    A key tells a subset from a deletion, and a set of the band from a larger one that posts
    to it.  A probe of its own band looks for both, with an allocation for each; a probe of a
    lower band looks for sets of that band.  Level 0 is the subset among subsets; level 1 is
    the subset among deletions and its deletions among subsets.  ``need`` is one more than
    what similar sets differ by, given the node's size.
    """
    names = ["key", "node", "part", "seg", "level", "need"] if probe else ["key", "node"]
    for batch in batches:
        owners = batch.column("node").to_pylist()
        parts: list[tuple] = []
        for i, words in hashing.batches_of_words(_texts(batch)):
            s = hashing.shingles(words, n)
            if fingerprint(s) != owners[i]:
                continue  # another text of the same id
            for band, whole, less, place in neighbourhoods(s, percent):
                m, (lo, most) = len(whole), _sizes(band)
                own = lo <= len(s) <= most
                if not probe:
                    key = np.unique(np.concatenate([whole, hashing.mix(less ^ _DELETED)]))
                    parts.append((owners[i], key if own else hashing.mix(key ^ _LOWER)))
                    continue
                key = np.concatenate([whole, hashing.mix(whole ^ _DELETED), less])
                seg = np.concatenate([np.arange(m), np.arange(m), place])
                level = np.concatenate([np.zeros(m, np.int8), np.ones(m + len(less), np.int8)])
                for larger in (False, True) if own else (False,):
                    partner = len(s) * 100 // percent if larger else most
                    need = (100 - percent) * (len(s) + partner) // (100 + percent) + 1
                    parts.append((owners[i], hashing.mix(key ^ _LOWER) if larger else key, 2 * band + larger, seg, level, need))
        if not parts:
            continue
        key = np.concatenate([x[1] for x in parts]).view(np.int64)
        lengths = [len(x[1]) for x in parts]
        columns = [key, np.repeat(np.array([x[0] for x in parts], np.int64), lengths)]
        if probe:
            columns += [
                np.repeat(np.array([x[2] for x in parts], np.int32), lengths),
                np.concatenate([x[3] for x in parts]).astype(np.int32),
                np.concatenate([x[4] for x in parts]),
                np.repeat(np.array([x[5] for x in parts], np.int32), lengths),
            ]
        for lo in range(0, len(key), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 18)]) for x in columns], names=names)


#: Least and most bytes of a sketch, powers of two; a byte for each of as many segments.
SKETCH, MOST_SKETCH = 64, 4096


def _sketch_size(n: int) -> int:
    """At least half of n, within the bounds."""
    return max(SKETCH, min(MOST_SKETCH, 1 << max(0, (n - 1) // 2).bit_length()))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The exclusive or of a byte of each element's hash in every segment.

    One element more or less changes one byte at most, so sets differ by at least as many
    elements as their sketches by bytes.  A sketch folds to half its size by the exclusive or
    of neighbours.
    """
    size = _sketch_size(len(hashes))
    out = np.zeros(size, np.uint8)
    at = (hashes >> _U(65 - size.bit_length())).astype(np.int64)
    np.bitwise_xor.at(out, at, (hashing.mix(hashes + _U(0x77)) >> _U(56)).astype(np.uint8))
    return out


def _sketched(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(node, n, sketch) from (node, text)."""
    for batch in batches:
        owners, kept, sizes, sketches = batch.column("node").to_pylist(), [], [], []
        for i, words in hashing.batches_of_words(_texts(batch)):
            s = hashing.shingles(words, n)
            if fingerprint(s) != owners[i]:
                continue  # another text of the same id
            kept.append(owners[i])
            sizes.append(len(s))
            sketches.append(sketch(s).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], names=["node", "n", "sketch"])


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    while sketches.shape[-1] > size:
        sketches = sketches[..., 0::2] ^ sketches[..., 1::2]
    return sketches


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows in the order of (key, role, sketch's size), seekers before what they look up: pairs across
    components whose sizes and sketches allow for the similarity, each once a batch."""
    last = None
    seekers: list[tuple] = []  # (nodes, labels, sizes, sketches) of one sketch size each
    for batch in batches:
        keys, roles = batch.column("key").to_numpy(), batch.column("role").to_numpy()
        nodes_, labels, sizes = (batch.column(x).to_numpy() for x in ("node", "label", "n"))
        sketches = batch.column("sketch").to_pylist()
        width = np.fromiter(map(len, sketches), np.int64, len(sketches))
        change = (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1]) | (width[1:] != width[:-1])
        starts = np.flatnonzero(np.concatenate([[True], change])) if len(keys) else []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in zip(starts, [*starts[1:], len(keys)]):
            if keys[lo] != last:
                last, seekers = keys[lo], []
            own = (nodes_[lo:hi], labels[lo:hi], sizes[lo:hi].astype(np.int64), np.frombuffer(b"".join(sketches[lo:hi]), np.uint8).reshape(hi - lo, -1))
            if roles[lo] == 0:
                seekers.append(own)
                continue
            for asked in seekers:
                least = min(asked[3].shape[1], own[3].shape[1])
                mine, theirs = _folded(asked[3], least), _folded(own[3], least)
                for node, label, size, bytes_ in zip(*asked[:3], mine):
                    fits = (own[1] != label) & (100 * np.minimum(own[2], size) >= percent * np.maximum(own[2], size))
                    at = np.flatnonzero(fits)
                    if len(at):
                        at = at[(theirs[at] != bytes_).sum(axis=1) <= (100 - percent) * (own[2][at] + size) // (100 + percent)]
                        found.append((np.minimum(own[0][at], node), np.maximum(own[0][at], node)))
        if found:
            pairs = np.unique(np.stack([np.concatenate([x[k] for x in found]) for k in (0, 1)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[k]) for k in (0, 1)], names=["a", "b"])


def _searched(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) across components among members (node, label, size) of large signatures.

    Each node whose component isn't the largest looks others up.  It takes the cheapest
    lookups, by how many nodes a key has, whose thresholds exceed what similar sets differ
    by: subsets that many share are left out where rarer ones suffice.
    """
    c = F.col
    rank = F.struct("size", "label")
    top = members.agg(F.max(rank).alias("r")).select(c("r.label").alias("top"))
    seekers = members.join(F.broadcast(top), c("label") == c("top"), "left_anti").select("node")
    held = checkpoint(texts.join(members.select("node"), "node", "left_semi"))
    index = checkpoint(held.mapInArrow(lambda x: _index(x, n, percent, False), "key bigint, node bigint"))
    probes = held.join(seekers, "node").mapInArrow(
        lambda x: _index(x, n, percent, True), "key bigint, node bigint, part int, seg int, level tinyint, need int"
    )
    counts = index.groupBy("key").agg(F.count("*").alias("n"))
    # a key that only the seeker has costs nothing
    priced = checkpoint(probes.join(counts, "key", "left").withColumn("n", F.coalesce(c("n"), F.lit(0))))
    cost = priced.groupBy("node", "part", "seg", "need").agg(
        F.sum(F.when(c("level") == 0, c("n")).otherwise(0)).alias("c0"), F.sum(F.when(c("level") == 1, c("n")).otherwise(0)).alias("c1")
    )
    # units that a segment offers: threshold 0 and then 1, or both at once where the second is cheaper
    one = F.struct(F.lit(0).cast("tinyint").alias("level"), F.lit(1).alias("units"), c("c0").cast("double").alias("price"))
    two = F.struct(F.lit(1).cast("tinyint").alias("level"), F.lit(1).alias("units"), c("c1").cast("double").alias("price"))
    both = F.struct(F.lit(1).cast("tinyint").alias("level"), F.lit(2).alias("units"), ((c("c0") + c("c1")) / 2).alias("price"))
    offers = cost.select("node", "part", "seg", "need", F.explode(F.when(c("c1") < c("c0"), F.array(both)).otherwise(F.array(one, two))).alias("o"))
    before = Window.partitionBy("node", "part").orderBy("o.price", "o.level", "seg").rowsBetween(Window.unboundedPreceding, -1)
    taken = offers.withColumn("had", F.coalesce(F.sum("o.units").over(before), F.lit(0))).where("had < need")
    taken = taken.groupBy("node", "part", "seg").agg(F.max("o.level").alias("upto"))
    asked = priced.where("n > 0").join(taken, ["node", "part", "seg"]).where("level <= upto").select("key", "node").distinct()
    wanted = index.join(asked.select("key").distinct(), "key", "left_semi")
    met = asked.select("key", F.lit(0).alias("role"), "node").unionByName(wanted.select("key", F.lit(1).alias("role"), "node"))
    return _compared(met, members.select("node", "label"), held, n, percent)


def _compared(met: DataFrame, members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) across components that meet under a key of ``met`` (key, role, node), one of them in
    role 0 and the other in role 1, unless their sizes or sketches rule the similarity out."""
    known = texts.join(members.select("node"), "node", "left_semi").mapInArrow(lambda x: _sketched(x, n), "node bigint, n int, sketch binary")
    known = checkpoint(known.join(members, "node"))
    rows = met.join(known, "node").repartition("key").sortWithinPartitions("key", "role", F.octet_length("sketch"))
    return rows.mapInArrow(lambda x: _near(x, percent), "a bigint, b bigint").distinct()


def links(docs: DataFrame, named: DataFrame | None = None, n: int = SHINGLE, percent: int = PERCENT, middle_most: int = MIDDLE_GROUP) -> DataFrame:
    """Labels (node, label) of all nodes that are linked with another node."""
    c = F.col
    docs = docs.select("doc_id", "text")
    named = named if named is not None else checkpoint(nodes(docs, n))
    met = candidates(docs, n, percent)
    met = checkpoint(met.select("sig", F.explode(F.array("node", "star")).alias("node")).distinct())
    # first round: each node with the hubs that it shares most signatures with
    counted = met.join(met.groupBy("sig").agg(F.count("*").alias("n")), "sig")
    fame = checkpoint(counted.groupBy("node").agg(F.sum("n").alias("fame")))
    part = F.pmod(F.xxhash64("node"), F.lit(HUBS))
    hubs = met.join(fame, "node").groupBy("sig").agg(
        *[F.max(F.when(part == k, F.struct("fame", "node")))["node"].alias(f"h{k}") for k in range(HUBS)]
    )
    hubs = met.join(hubs, "sig").select("node", F.explode(F.array(*[f"h{k}" for k in range(HUBS)])).alias("hub"))
    shared = hubs.where("hub <> node").groupBy("node", "hub").agg(F.count("*").alias("n"))
    best = shared.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "hub"))).where(c("k") <= HUBS)
    pairs = checkpoint(best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    texts = checkpoint(_texts_of(fame.select("node"), named, docs, n))
    linked = checkpoint(verify(pairs, texts, n, percent))
    labels = components(linked)
    # second round: signatures whose members are still apart, the least of those that have the same members
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    sized = labels.join(sizes, "label").select("node", "label", "size")
    members = met.join(sized, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    members = checkpoint(members)
    sets = members.groupBy("sig").agg(
        F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("size", "label")).alias("top"),
        F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"),
    )
    sets = sets.where("lo < hi").groupBy("n", "s1", "s2").agg(F.min("sig").alias("sig"), F.first("top").alias("top"))
    members = checkpoint(members.join(sets.select("sig", "n", "top"), "sig"))
    middle = members.where(c("n") <= middle_most)
    asking = middle.where(F.struct("size", "label") < c("top"))
    met = asking.select(c("sig").alias("key"), F.lit(0).alias("role"), "node").unionByName(middle.select(c("sig").alias("key"), F.lit(1).alias("role"), "node"))
    more = _compared(met, middle.select("node", "label").distinct(), texts, n, percent)
    many = checkpoint(members.where(c("n") > middle_most).select("node", "label", "size").distinct())
    if not many.isEmpty():
        more = more.unionByName(_searched(many, texts, n, percent))
    more = checkpoint(more.distinct().join(pairs, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return labels
    again = checkpoint(verify(more, texts, n, percent))
    return components(linked.unionByName(again))


def labelled(docs: DataFrame, middle_most: int = MIDDLE_GROUP) -> DataFrame:
    """(doc_id, n_shingles, node, first): first is the least (doc_id, node) of the row's component, by
    which its rows are told apart where texts share an id; null for an empty set."""
    c = F.col
    docs = docs.select("doc_id", "text")
    named = checkpoint(nodes(docs))
    labels = links(docs, named, middle_most=middle_most)
    rows = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # the least id of the nodes first, of the components after
    least = rows.groupBy("label").agg(F.min(F.when(c("doc_id").isNotNull(), F.struct("doc_id", "node"))).alias("first"))
    return rows.join(least, "label", "left").select("doc_id", "n_shingles", "node", "first")


def op4(docs: DataFrame, middle_most: int = MIDDLE_GROUP) -> DataFrame:
    """The contract's columns."""
    c = F.col
    return labelled(docs, middle_most).select("doc_id", "n_shingles", F.when(c("node").isNull(), c("doc_id")).otherwise(c("first.doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
