"""Reading a story sentence by sentence into a concept graph; each function names what it is of the inventory.

``Reader`` is the state machine of one run, a pure class over plain values, so that the
batch plan and the streaming plan share it.  A run's edges are columns, since every sentence
passes all of them; runs are what the cluster spreads.  Ties are broken by name.
"""

from __future__ import annotations

import gc
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fabulagraph.functions.oracle import Oracle, StubOracle
from fabulagraph.functions.tagger import STOP, RuleTagger, Tagger, relations

# fixed values: how long edges last, how far nodes carry over, and what bounds a sentence's additions
VISIBILITY, REACH, NEW_PER_NODE, PRUNE_ABOVE = 2, 2, 3, 5
#: Edges that pruning may keep at once, tries for a label, what a chain's last edge gains and its most.
KEPT_MOST, TRIES, CHAIN_GAIN, CHAIN_MOST = 20, 2, 2, 5
CONTROL = ("user", "system", "assistant")
#: Rows of a sentence that leave at a time, and tasks a core.
ROWS, SPREAD = 1 << 16, 4

SCHEMA = (
    "run_id string, sentence_index int, kind string, subject string, relation string, object string, introduced_at int, active boolean, token string, score double"
)


class Names:
    """Words by number, in the order they came; only ever added to, so a snapshot shares them."""

    def __init__(self) -> None:
        self.all: list[str] = []
        self.ids: dict[str, int] = {}

    def id(self, name: str) -> int:
        i = self.ids.get(name)
        if i is None:
            i = self.ids[name] = len(self.all)
            self.all.append(name)
        return i

    def marked(self, some: set[str]) -> np.ndarray:
        out = np.zeros(len(self.all), bool)
        out[[self.ids[x] for x in some if x in self.ids]] = True
        return out


_COLUMNS = {
    "src": np.int32, "dst": np.int32, "label": np.int32, "made": np.int32, "since": np.int32, "visibility": np.int32, "there": bool, "active": bool,
    "asserted": bool, "reactivated": bool, "inferred": bool, "is_property": bool,
}


class Edges(Mapping):
    """Directed, labelled edges by column; edges are told apart by their id, the place in the columns, so parallel ones may be."""

    def __init__(self) -> None:
        self.n = self.gone = 0
        self.nodes, self.labels = Names(), Names()
        #: A triplet's text, as models are asked about it.
        self.text: list[str] = []
        for name, kind in _COLUMNS.items():
            setattr(self, name, np.zeros(64, kind))

    def copied(self) -> Edges:
        out = object.__new__(Edges)
        out.__dict__.update(self.__dict__ | {"text": list(self.text)} | {name: getattr(self, name).copy() for name in _COLUMNS})
        return out

    def room(self, more: int) -> None:
        if self.n + more > len(self.src):
            for name in _COLUMNS:
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(max(more, len(old)), old.dtype)]))

    def extend(self, keys: list[tuple[int, int, int]], made: int, since: list[int], texts: list[str]) -> None:
        """``insert`` of many."""
        self.room(len(keys))
        new = slice(self.n, self.n + len(keys))
        if keys:
            self.src[new], self.label[new], self.dst[new] = np.array(keys, np.int32).T
        self.made[new], self.since[new], self.visibility[new] = made, since, VISIBILITY
        self.there[new] = self.active[new] = self.asserted[new] = True
        self.text += texts
        self.n += len(keys)

    def insert(self, src: int, label: int, dst: int, made: int, since: int, inferred: bool, is_property: bool) -> int:
        self.room(1)
        i = self.n
        self.src[i], self.dst[i], self.label[i], self.made[i], self.since[i], self.visibility[i] = src, dst, label, made, since, VISIBILITY
        self.there[i] = self.active[i] = self.asserted[i] = True
        if inferred:
            self.inferred[i] = True
        if is_property:
            self.is_property[i] = True
        self.text.append(f"{self.nodes.all[src]}|{self.labels.all[label]}|{self.nodes.all[dst]}")
        self.n += 1
        return i

    def remove(self, i: int) -> None:
        self.there[i] = self.active[i] = False
        self.gone += 1

    def touch(self, i: Any) -> None:
        """STR-4."""
        self.asserted[i] = self.active[i] = True
        self.visibility[i] = VISIBILITY

    # -- of many edges, by id ------------------------------------------------------------
    def all(self) -> np.ndarray:
        return np.flatnonzero(self.there[: self.n])

    def live(self, above: int = 0) -> np.ndarray:
        return np.flatnonzero(self.active[: self.n] & (self.visibility[: self.n] > above))

    def start(self) -> None:
        """STR-2, STR-6."""
        self.asserted[: self.n] = self.reactivated[: self.n] = False
        self.settle()

    def settle(self) -> None:
        """STR-14: edges that show nothing."""
        self.active[: self.n] &= self.visibility[: self.n] > 0

    def fade(self, ids: np.ndarray, by: Any = 1) -> None:
        """STR-3."""
        self.visibility[ids] = np.maximum(0, self.visibility[ids] - by)
        self.active[ids] &= self.visibility[ids] > 0

    def wake(self, ids: Any, visibility: Any = VISIBILITY) -> None:
        """STR-5."""
        self.reactivated[ids] = self.active[ids] = True
        self.visibility[ids] = np.maximum(self.visibility[ids], visibility)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Which nodes the edges have, by number."""
        out = np.zeros(len(self.nodes.all), bool)
        out[self.src[ids]] = out[self.dst[ids]] = True
        return out

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Unordered pairs of ends."""
        a, b = self.src[ids].astype(np.int64), self.dst[ids]
        return np.minimum(a, b) << 32 | np.maximum(a, b)

    def texts(self, ids: np.ndarray) -> list[str]:
        return list(map(self.text.__getitem__, ids.tolist()))

    # -- one edge ------------------------------------------------------------------------
    def __getitem__(self, i: int) -> Edge:
        if not (0 <= i < self.n and self.there[i]):
            raise KeyError(i)
        return Edge(self, i)

    def __iter__(self) -> Iterator[int]:
        return iter(self.all().tolist())

    def __len__(self) -> int:
        return self.n - self.gone


def _cell(name: str, kind: type) -> property:
    def put(edge: Edge, value: Any) -> None:
        getattr(edge.of, name)[edge.id] = value

    return property(lambda edge: kind(getattr(edge.of, name)[edge.id]), put)


class Edge:
    """A row of the columns."""

    __slots__ = ("of", "id")
    made, since, visibility = _cell("made", int), _cell("since", int), _cell("visibility", int)
    active, asserted, reactivated = _cell("active", bool), _cell("asserted", bool), _cell("reactivated", bool)
    inferred, is_property = _cell("inferred", bool), _cell("is_property", bool)

    def __init__(self, of: Edges, id: int):
        self.of, self.id = of, id

    @property
    def src(self) -> str:
        return self.of.nodes.all[self.of.src[self.id]]

    @property
    def dst(self) -> str:
        return self.of.nodes.all[self.of.dst[self.id]]

    @property
    def label(self) -> str:
        return self.of.labels.all[self.of.label[self.id]]


@dataclass
class State:
    nodes: dict[str, dict] = field(default_factory=dict)
    edges: Edges = field(default_factory=Edges)
    carryover: set[str] = field(default_factory=set)
    context: list[str] = field(default_factory=list)
    #: The sentence that first had a (source, label, target), by their numbers.
    introduced: dict[tuple[int, int, int], int] = field(default_factory=dict)
    active_before: set[str] = field(default_factory=set)
    inactive: set[str] = field(default_factory=set)
    sentence: int = 0
    #: Ids of the edges from one node to another, in order.
    pairs: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    #: Nodes of the view before that the last view left out.
    left: set[str] = field(default_factory=set)

    def copied(self) -> State:
        """A snapshot: what changes in place is copied."""
        return State(
            {k: v | {"said": list(v["said"])} for k, v in self.nodes.items()}, self.edges.copied(), set(self.carryover), list(self.context),
            dict(self.introduced), set(self.active_before), set(self.inactive), self.sentence, {k: list(v) for k, v in self.pairs.items()}, set(self.left),
        )


def _near(edges: Edges, sources: set[str], most: int, above: int = 0) -> dict[str, int]:
    """GRA-2, GRA-3: distances over active edges of enough visibility."""
    ids = edges.live(above)
    a, b = edges.src[ids], edges.dst[ids]
    reached = edges.nodes.marked(sources)
    found = dict.fromkeys(sources, 0)
    for far in range(1, most + 1):
        more = np.zeros_like(reached)
        more[b[reached[a]]] = more[a[reached[b]]] = True
        more &= ~reached
        if not more.any():
            break
        found.update((edges.nodes.all[i], far) for i in np.flatnonzero(more).tolist())
        reached |= more
    return found


def _tops(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one that edges from ``a`` to ``b`` join it with."""
    top = np.arange(n)
    while len(a):
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := top[top], top):
            top = up
        a, b = top[a], top[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return top


def _grouped(edges: Edges, ids: np.ndarray, nodes: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the edges' ends and of the nodes, and what ``_tops`` says of each."""
    for x in nodes:
        edges.nodes.id(x)
    n = len(edges.nodes.all)
    there = np.flatnonzero(edges.ends(ids) | edges.nodes.marked(nodes))
    return there, _tops(edges.src[ids], edges.dst[ids], n)[there]


def _parts(edges: Edges, ids: np.ndarray, nodes: set[str]) -> list[set[str]]:
    """GRA-1 of a run's edges and nodes, largest part first, then by least name."""
    out: dict[int, set[str]] = {}
    there, tops = _grouped(edges, ids, nodes)
    for i, t in zip(there.tolist(), tops.tolist()):
        out.setdefault(t, set()).add(edges.nodes.all[i])
    return sorted(out.values(), key=lambda p: (-len(p), min(p)))


def _around(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int], list[int]]:
    """Of each node the places of its edges, in order, and their other ends: where they begin, places, ends."""
    ends, others = np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel()
    order = np.argsort(ends, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    return begin.tolist(), (order >> 1).tolist(), others[order].tolist()


def _bridges(codes: np.ndarray) -> np.ndarray:
    """GRA-30, GRA-31: of unordered pairs of different nodes, those that nothing but their own edges joins.

    What hangs by one edge is taken off first; of what is left, by one depth-first search.
    """
    codes = np.unique(codes)
    names, ends = np.unique(np.concatenate([codes >> 32, codes & 0xFFFFFFFF]), return_inverse=True)
    n, found = len(names), []
    a, b = ends[: len(codes)], ends[len(codes) :]
    while len(codes):
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        hangs = (degree[a] == 1) | (degree[b] == 1)
        if not hangs.any():
            break
        found.append(codes[hangs])
        codes, a, b = codes[~hangs], a[~hangs], b[~hangs]
    if not len(codes):
        return np.concatenate(found) if found else codes
    begin, place, other = _around(a, b, n)
    seen, low, at, came = [0] * n, [0] * n, begin[:-1], [-1] * n
    count, cut = 0, []
    for root in np.unique(a).tolist():
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        stack = [root]
        while stack:
            node = stack[-1]
            i, end, parent, least = at[node], begin[node + 1], came[node], low[node]
            while i < end:
                x = other[i]
                if not seen[x]:
                    break
                if seen[x] < least and place[i] != parent:
                    least = seen[x]
                i += 1
            low[node], at[node] = least, i + 1
            if i < end:
                count += 1
                seen[x] = low[x] = count
                came[x] = place[i]
                stack.append(x)
                continue
            stack.pop()
            if stack:
                up = stack[-1]
                low[up] = min(low[up], least)
                if least > seen[up]:
                    cut.append(parent)
    return np.concatenate([*found, codes[cut]])


def _nameable(lemma: str) -> bool:
    return len(lemma) >= 2 and lemma not in STOP and lemma.replace("'", "").isalpha()


@cache
def _negated(label: str) -> bool:
    return not {"not", "no", "never", "neither", "nor", "without"}.isdisjoint(label.split("_"))


class Reader:
    def __init__(self, run_id: str, tagger: Tagger | None = None, oracle: Oracle | None = None, state: State | None = None, persona: str = ""):
        self.run_id, self.tag, self.oracle, self.persona = run_id, tagger or RuleTagger(), oracle or StubOracle(), persona
        self.s = state or State()
        #: Nodes that a new edge may end in: those said now, those carried over, and the ends of live edges.
        self.reached: set[str] = set()

    # -- graph ---------------------------------------------------------------------------
    def live(self) -> list[Edge]:
        return [Edge(self.s.edges, i) for i in self.s.edges.live().tolist()]

    def _live_ends(self) -> set[str]:
        e = self.s.edges
        return {e.nodes.all[i] for i in np.flatnonzero(e.ends(e.live())).tolist()}

    def node(self, lemma: str, kind: str, explicit: bool) -> bool:
        """GRA-8, FIL-24: makes or meets a node; too short, stop words and names with other signs are refused."""
        if not _nameable(lemma):
            return False
        n = self.s.nodes.setdefault(lemma, {"kind": kind, "said": [], "inferred": not explicit})
        if kind == "PROPERTY":
            n["kind"] = kind
        if explicit:
            n["said"].append(self.s.sentence)
            n["inferred"] = False
        return True

    def add(self, src: str, label: str, dst: str, explicit: set[str], inferred: bool = False, is_property: bool = False, free: bool = False) -> Edge | None:
        """GRA-9, GRA-12: the order of refusals, then refresh, replace or insert."""
        if src == dst or not label or label == dst or src not in self.s.nodes or dst not in self.s.nodes:
            return None
        if _negated(label):
            return None
        if not free and self.reached and not (src in self.reached or dst in self.reached):
            return None
        edges = self.s.edges
        a, r, b = key = edges.nodes.id(src), edges.labels.id(label), edges.nodes.id(dst)
        ids = self.s.pairs.setdefault((a, b), [])
        self.reached.add(src)
        self.reached.add(dst)
        if ids and not inferred:
            i = ids[0]
            if edges.label[i] == r:
                edges.touch(i)
                return Edge(edges, i)
            ids.pop(0)
            edges.remove(i)
        i = edges.insert(*key, self.s.sentence, self.s.introduced.setdefault(key, self.s.sentence), inferred, is_property)
        ids.append(i)
        return Edge(edges, i)

    def add_all(self, triplets: list[tuple[str, str, str]]) -> None:
        """``add`` of many stated edges between a node that was said and another."""
        e, at, labels = self.s.edges, self.s.sentence, {}
        for _, label, _ in triplets:
            if label not in labels:
                labels[label] = e.labels.id(label) if label and not _negated(label) else -1
        known, id_of, pairs, since = self.s.nodes, e.nodes.id, self.s.pairs, self.s.introduced
        new: list[tuple[int, int, int]] = []
        first, touched, gone, texts, sinces = e.n, [], [], [], []
        for src, label, dst in triplets:
            r = labels[label]
            if r < 0 or src == dst or label == dst or src not in known or dst not in known:
                continue
            a, b = id_of(src), id_of(dst)
            ids = pairs.get((a, b))
            if ids:
                i = ids[0]
                if (e.label[i] if i < first else new[i - first][1]) == r:
                    touched.append(i)
                    continue
                gone.append(ids.pop(0))
            else:
                ids = pairs[a, b] = []
            key = (a, r, b)
            ids.append(first + len(new))
            new.append(key)
            sinces.append(since.setdefault(key, at))
            texts.append(f"{src}|{label}|{dst}")
            self.reached.add(src)
            self.reached.add(dst)
        e.extend(new, at, sinces, texts)
        e.touch(touched)
        for i in gone:
            e.remove(i)

    # -- a sentence ----------------------------------------------------------------------
    def read(self, text: str) -> list[tuple]:
        """STR-1 for one sentence: what it emits.  A sentence that a control word opens is skipped."""
        return [row for batch in self.batches(text) for row in zip(*(column.to_pylist() for column in batch.columns))]

    def batches(self, text: str) -> list[pa.RecordBatch]:
        """``read`` by column: what a sentence emits is many times its text."""
        if (text or "").lower().startswith(CONTROL):
            return []
        self.s.sentence += 1
        toks = self.tag(text)
        said = {t.lemma for t in toks if t.pos in ("NOUN", "PROPN", "ADJ") and _nameable(t.lemma)}
        before, carried = self.s.copied() if len(said) <= 1 else None, set(self.s.carryover)  # others are never lost
        self.s.edges.start()
        explicit = {t.lemma for t in toks if t.pos in ("NOUN", "PROPN") and self.node(t.lemma, "CONCEPT", True)}
        explicit |= {t.lemma for t in toks if t.pos == "ADJ" and self.node(t.lemma, "PROPERTY", True)}
        first = self.s.sentence == 1
        self.reached = explicit | self.s.carryover | self._live_ends()
        self._grow(toks, text, explicit, first)
        if not first:
            self._fade(text, explicit)
            self._prune(text, explicit)
        self.s.edges.settle()
        self._repair(explicit, text)
        view = self._view(explicit)
        if self._lost(explicit):  # STR-21, STR-22
            kept = self.s.introduced
            at = self.s.sentence
            self.s = before
            self.s.sentence, self.s.carryover, self.s.introduced = at, carried, kept
            self.s.context = [*self.s.context, text][-1:]
            return self._triplets(explicit)
        self.s.context = [*self.s.context, text][-1:]
        self.s.carryover = set(view) - explicit
        now = set(view)
        self.s.left = self.s.active_before - now  # WIN-14
        self.s.inactive = (self.s.inactive | self.s.left) - now
        self.s.active_before = now
        return self._triplets(explicit) + self._activations(explicit)

    def _grow(self, toks: list, text: str, explicit: set[str], first: bool) -> None:
        for s, r, o, prop in relations(toks):  # NLP-5
            self.add(s, r, o, explicit, is_property=prop, free=first)
        order = [n for n in dict.fromkeys(t.lemma for t in toks) if n in explicit]
        for s, r, o in self.oracle.ask("relationships", nodes=order, text=text, persona=self.persona):  # STR-26
            answer = self.oracle.ask("validate", triplet=(s, r, o), text=text)
            if answer.get("valid", True):
                s, r, o = answer.get("corrected") or (s, r, o)
                self.add(s, r, o, explicit, free=first)
        count: dict[tuple[str, str], int] = {}
        guess = self.oracle.ask("infer", nodes=order, text=text)
        for kind in ("concepts", "properties"):  # STR-28, WIN-7
            for s, r, o in guess[kind]:
                if count.get((s, kind), 0) < NEW_PER_NODE and s in self.s.nodes and self.node(o, "PROPERTY" if kind == "properties" else "CONCEPT", False):
                    if self.add(s, r, o, explicit, inferred=True, is_property=kind == "properties", free=first):
                        count[s, kind] = count.get((s, kind), 0) + 1
        if first:
            return
        wanted = {(a, b) if a < b else (b, a) for a in explicit for b in self.s.left if a != b}  # JOIN-10
        answer = self.oracle.ask("attach", pairs=sorted(wanted), text=text) if wanted else []
        self.add_all([x for x in answer if (x[0], x[2]) in wanted or (x[2], x[0]) in wanted])
        e = self.s.edges
        asleep = np.flatnonzero(e.there[: e.n] & ~e.active[: e.n] & ~e.is_property[: e.n])
        said = e.nodes.marked(explicit)
        for i in self.oracle.ask("relevant", triplets=e.texts(asleep), text=text):  # STR-13
            if 0 <= i < len(asleep) and (said[e.src[asleep[i]]] or said[e.dst[asleep[i]]]):
                e.wake(asleep[i])

    def _fade(self, text: str, explicit: set[str]) -> None:
        """STR-8, STR-9, STR-12: scored decay; bridges are spared."""
        e = self.s.edges
        old = np.flatnonzero(e.there[: e.n] & (e.made[: e.n] != self.s.sentence) & ~e.asserted[: e.n] & ~e.reactivated[: e.n])
        names = e.texts(old)
        try:
            scores = self.oracle.ask("scores", triplets=names, text=text)
        except Exception:  # noqa: BLE001  no answer: all lose one
            scores = None
        spared = np.isin(e.codes(old), _bridges(e.codes(e.live())))
        score = np.fromiter((2 if scores is None else max(0, min(3, int(scores.get(name, 2)))) for name in names), np.int8, len(names))
        more, less = old[score == 3], score < 3
        by = np.select([score == 0, score == 1], [np.where(spared, 1, e.visibility[old]), np.where(spared, 2, 1)], 1)
        e.fade(old[less], by[less])
        e.visibility[more] = np.minimum(VISIBILITY, e.visibility[more] + 1)
        e.wake(more, e.visibility[more])
        self._reinforce()

    def _reinforce(self) -> None:
        """STR-10: from each inferred node along live edges to the first node of the text; the path's last edge gains."""
        e, nodes = self.s.edges, self.s.nodes
        ids = e.live()
        there = e.ends(ids)
        inferred = [there[i] and nodes[x]["inferred"] for i, x in enumerate(e.nodes.all)]
        starts = [i for i, x in enumerate(inferred) if x]
        if not starts:
            return
        begin, place, ends = _around(e.src[ids], e.dst[ids], len(there))
        last: set[int] = set()
        for start in starts:
            seen, queue, found = {start}, deque([start]), False
            while queue and not found:
                node = queue.popleft()
                for i in range(begin[node], begin[node + 1]):
                    other = ends[i]
                    if other in seen:
                        continue
                    if not inferred[other]:
                        last.add(place[i])
                        found = True
                        break
                    seen.add(other)
                    queue.append(other)
        gains = ids[sorted(last)]
        e.visibility[gains] = np.minimum(CHAIN_MOST, e.visibility[gains] + CHAIN_GAIN)
        e.reactivated[gains] |= ~e.is_property[gains]

    def _prune(self, text: str, explicit: set[str]) -> None:
        """STR-11."""
        e = self.s.edges
        live = e.live()
        if len(live) <= PRUNE_ABOVE:
            return
        names = e.texts(live)
        kept = set(self.oracle.ask("keep", triplets=names, text=text))
        if len(kept) > KEPT_MOST:  # still too many: asked again, more strictly
            kept = set(self.oracle.ask("keep", triplets=names, text=text, aggressive=True))
        said = e.nodes.marked(explicit)
        slow = said[e.src[live]] | said[e.dst[live]] | np.isin(e.codes(live), _bridges(e.codes(live)))
        goes = np.fromiter((name not in kept for name in names), bool, len(names)) & (e.made[live] != self.s.sentence)
        e.fade(live[goes], np.where(slow, 1, e.visibility[live])[goes])

    def _view(self, explicit: set[str]) -> dict[str, int]:
        """STR-20: explicit nodes and what is near them."""
        return _near(self.s.edges, explicit, REACH)

    # -- connectivity --------------------------------------------------------------------
    def connected(self, explicit: set[str]) -> bool:
        """GRA-14, GRA-28: the live graph and the explicit nodes are one part."""
        _, tops = _grouped(self.s.edges, self.s.edges.live(), explicit)
        return not len(tops) or bool((tops == tops[0]).all())

    def can_connect(self, required: set[str]) -> bool:
        """GRA-17: all edges, live or not, join the required nodes."""
        return sum(bool(part & required) for part in _parts(self.s.edges, self.s.edges.all(), required)) <= 1

    def _repair(self, explicit: set[str], text: str) -> None:
        """GRA-18, GRA-21, GRA-22: step by step, until the live graph is connected."""
        for step in (self.wake_all, self.wake_paths, self.ask_labels, self.relate):
            if self.connected(explicit):
                return
            step(explicit, text)

    def wake_all(self, explicit: set[str], text: str = "") -> None:
        """GRA-19: if nothing is live, what is visible wakes."""
        e = self.s.edges
        if not len(e.live()):
            e.wake(np.flatnonzero(e.there[: e.n] & (e.visibility[: e.n] > 0)), 0)

    def wake_paths(self, required: set[str], text: str = "") -> None:
        """GRA-16, GRA-20: of every other part, the shortest path over all edges to the largest part wakes."""
        e = self.s.edges
        parts = _parts(e, e.live(), required)
        if len(parts) < 2:
            return
        ids, number = e.all(), e.nodes.ids
        begin, place, ends = _around(e.src[ids], e.dst[ids], len(e.nodes.all))
        main = {number[x] for x in parts[0]}
        for part in parts[1:]:
            came: dict[int, tuple[int, int] | None] = {number[x]: None for x in sorted(part)}
            queue, end = deque(came), None
            while queue and end is None:
                node = queue.popleft()
                for i in range(begin[node], begin[node + 1]):
                    other = ends[i]
                    if other not in came:
                        came[other] = (node, place[i])
                        if other in main:
                            end = other
                            break
                        queue.append(other)
            while end is not None and came[end] is not None:
                end, at = came[end]
                if not e.active[ids[at]]:
                    e.wake(ids[at], 1)

    def _anchored(self, explicit: set[str]) -> tuple[list[str], str]:
        """The first explicit node of every part but the largest, and the largest part's node of most live edges."""
        e = self.s.edges
        ids = e.live()
        parts = _parts(e, ids, explicit)
        degree = np.bincount(np.concatenate([e.src[ids], e.dst[ids]]), minlength=len(e.nodes.all)).tolist()
        anchor = min(parts[0], key=lambda n: (-degree[e.nodes.ids[n]], n))
        return [min(part & explicit) for part in parts[1:] if part & explicit], anchor

    def ask_labels(self, explicit: set[str], text: str) -> None:
        """GRA-26, GRA-27, GRA-29: edges to the anchor with a label that is asked for, twice at most."""
        apart, anchor = self._anchored(explicit)
        for n in apart:
            for attempt in range(TRIES):
                label = self.oracle.ask("label", a=n, b=anchor, text=text, attempt=attempt)
                if label and self.add(n, label, anchor, explicit, free=True):
                    break

    def relate(self, explicit: set[str], text: str = "") -> None:
        """GRA-23: what no label was found for relates to the anchor."""
        apart, anchor = self._anchored(explicit)
        for n in apart:
            self.add(n, "relates_to", anchor, explicit, free=True)

    def _lost(self, explicit: set[str]) -> bool:
        return not explicit or (len(explicit) == 1 and not explicit & self._live_ends())

    # -- what is emitted -----------------------------------------------------------------
    def _rows(self, kind: str, ids: np.ndarray) -> list[pa.RecordBatch]:
        """Edges as rows."""
        e = self.s.edges
        names, labels = pa.array(e.nodes.all, pa.string()), pa.array(e.labels.all, pa.string())
        out = []
        for at in range(0, len(ids), ROWS):
            some = ids[at : at + ROWS]
            ends = [names.take(pa.array(e.src[some])), labels.take(pa.array(e.label[some])), names.take(pa.array(e.dst[some]))]
            out.append(_batch(self.run_id, self.s.sentence, kind, [*ends, pa.array(e.since[some]), pa.array(e.active[some]), None, None], len(some)))
        return out

    def _triplets(self, explicit: set[str]) -> list[pa.RecordBatch]:
        """STR-29."""
        e = self.s.edges
        shown = e.ends(e.live()) | e.nodes.marked(explicit)
        ids = e.all()
        return self._rows("sentence", ids[shown[e.src[ids]] & shown[e.dst[ids]]])

    def _activations(self, explicit: set[str]) -> list[pa.RecordBatch]:
        """STR-18: nodes by distance, labels half a point below their higher end."""
        e, nodes = self.s.edges, self.s.nodes
        raw = _near(e, explicit, REACH, 1)
        live = e.live()
        fresh = np.flatnonzero(e.ends(live[e.made[live] == self.s.sentence]))
        new = {x for i in fresh.tolist() if nodes[x := e.nodes.all[i]]["inferred"]}
        score = {n: max(0.0, min(5.0, 5.0 - (1 if n in new and d > 0 else d))) for n, d in raw.items()}
        of = np.array([score.get(x, 5.0 - REACH - 1) for x in e.nodes.all])
        best = np.full(len(e.labels.all), -1.0)
        np.maximum.at(best, e.label[live], np.maximum(0.0, np.maximum(of[e.src[live]], of[e.dst[live]]) - 0.5))
        labels = {e.labels.all[i]: x for i, x in enumerate(best.tolist()) if x >= 0}
        tokens, scores = zip(*sorted({**labels, **score}.items()))
        return [_batch(self.run_id, self.s.sentence, "activation", [None] * 5 + [pa.array(tokens, pa.string()), pa.array(scores, pa.float64())], len(tokens))]

    def finish(self) -> list[tuple]:
        """Final triplets: live edges between different nodes."""
        return [row for batch in self.last() for row in zip(*(column.to_pylist() for column in batch.columns))]

    def last(self) -> list[pa.RecordBatch]:
        """``finish`` by column."""
        return self._rows("final", self.s.edges.live())


_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])


def _batch(run_id: str, sentence: int, kind: str, columns: list[pa.Array | None], n: int) -> pa.RecordBatch:
    """Rows of one run, sentence and kind; a column that is None is null."""
    same = [pa.repeat(pa.scalar(x, f.type), n) for x, f in zip((run_id, sentence, kind), _ARROW)]
    rest = [pa.nulls(n, f.type) if x is None else x for x, f in zip(columns, list(_ARROW)[3:])]
    return pa.RecordBatch.from_arrays(same + rest, schema=_ARROW)


def read_stories(sentences: DataFrame, tagger: Callable[[], Tagger] = RuleTagger, oracle: Callable[[], Oracle] = StubOracle) -> DataFrame:
    """STR-1, STR-33 in batch: ``sentences`` is (run_id string, sentence_index int, text string).

    A run's failure is a row of kind ``error``; other runs go on.  Rows leave sentence by sentence, so a long run's aren't held.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id = key[0].as_py()
        reader = Reader(run_id, tagger(), oracle())
        rows = pa.Table.from_batches(list(batches))
        collects = gc.isenabled()
        gc.disable()  # a run makes many tuples and no cycles
        try:
            for text in rows.sort_by("sentence_index").column("text").to_pylist():
                yield from reader.batches(text or "")
            yield from reader.last()
        except Exception as error:  # noqa: BLE001  reported as a row
            yield _batch(run_id, reader.s.sentence, "error", [None] * 5 + [pa.array([repr(error)[:200]], pa.string()), None], 1)
        finally:
            if collects:
                gc.enable()

    # texts are small and reading them is slow: a given number of partitions isn't merged by their bytes; several a core, since runs differ in length
    spark = sentences.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sentences.repartition(SPREAD * n, "run_id").groupBy("run_id").applyInArrow(run, SCHEMA)


def resolved(sentences: list[str], oracle: Oracle, context: int = 5) -> list[str]:
    """NLP-1: each sentence with its pronouns replaced; the first stays, and each sees the last original ones."""
    out: list[str] = []
    for i, text in enumerate(sentences):
        names = oracle.ask("pronouns", sentence=text, context=sentences[max(0, i - context) : i]) if i else {}
        names = names if isinstance(names, dict) else {}
        out.append(" ".join(names.get(w, w) for w in text.split(" ")))
    return out


def sentences_of(stories: DataFrame) -> DataFrame:
    """SRC-8: (run_id, sentence_index, text) of (story_id, text): split after sentence ends."""
    return stories.selectExpr(
        "cast(story_id as string) as run_id",
        r"posexplode(filter(split(regexp_replace(trim(text), '\\s+', ' '), '(?<=[.!?])\\s+'), x -> x <> '')) as (sentence_index, text)",
    )
