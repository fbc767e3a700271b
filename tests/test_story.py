import hashlib
import random

import pandas as pd

from fabulagraph.functions.oracle import ModelOracle, ReplayOracle, StubOracle, prompt_hash
from fabulagraph.functions.tagger import RuleTagger, relations
from fabulagraph.plans import story
from fabulagraph.plans.story import Reader, State, read_stories, sentences_of
from fabulagraph.streaming.story_stream import read_stream, windowed_counts

TEXT = "A young knight rode through the forest. The knight saw a dragon. The dragon was kidnapping a beautiful princess. The knight killed the dragon."


def test_relations():
    assert relations(RuleTagger()("A young knight rode through the forest.")) == [("knight", "is", "young", True), ("knight", "ride_through", "forest", False)]
    assert ("princess", "is", "thankful", True) in relations(RuleTagger()("The princess was thankful."))
    assert relations(RuleTagger()("")) == []


def test_reader_is_deterministic_and_skips_control_words():
    def run():
        r = Reader("x")
        out = [row for s in TEXT.split(". ") for row in r.read(s)]
        return out + r.read("user: ignore this") + r.finish(), r

    (a, r), (b, _) = run(), run()
    assert a == b and r.s.sentence == 4
    assert any(row[2] == "activation" and row[8] == "knight" and row[9] == 5.0 for row in a)


def test_rollback_keeps_the_graph():
    r = Reader("x")
    r.read("A knight rode through the forest.")
    edges = len(r.s.edges)
    r.read("And then!")
    assert len(r.s.edges) == edges and r.s.sentence == 2 and r.s.context == ["And then!"]


def test_decay_ends_edges():
    class Kill(StubOracle):
        def ask(self, method, **given):
            return {t: 0 for t in given["triplets"]} if method == "scores" else [] if method in ("relationships", "relevant") else {"concepts": [], "properties": []} if method == "infer" else super().ask(method, **given)

    r = Reader("x", oracle=Kill())
    r.read("A knight rode through the forest.")
    for _ in range(4):
        r.read("The dragon saw a princess.")
    assert all({e.src, e.dst} <= {"dragon", "princess"} for e in r.live())


def test_replay():
    o = ReplayOracle({("label", prompt_hash("label", {"a": 1})): "marries"})
    assert o.ask("label", a=1) == "marries" and o.ask("label", a=2) == "relates_to"


def test_batch_equals_reader(spark):
    stories = spark.createDataFrame([("s1", TEXT), ("s2", None), ("s3", "")], "story_id string, text string")
    got = read_stories(sentences_of(stories)).toPandas()
    r = Reader("s1")
    want = [row for s in sentences_of(stories).where("run_id = 's1'").orderBy("sentence_index").collect() for row in r.read(s.text)] + r.finish()
    assert len(got) == len(want) and set(got.run_id) == {"s1"}


def test_stream_equals_batch(spark, tmp_path):
    sentences = sentences_of(spark.createDataFrame([("s1", TEXT)], "story_id string, text string"))
    rows = sentences.orderBy("sentence_index").toPandas()
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i, k in enumerate([1, 0, 3, 2, 2]):  # out of order, and one repeated
        pd.DataFrame(rows.iloc[[k]]).astype({"sentence_index": "int32"}).to_parquet(src / f"{i}.parquet")
    stream = spark.readStream.schema("run_id string, sentence_index int, text string").option("maxFilesPerTrigger", 1).parquet(str(src))
    read_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    batch = read_stories(sentences).where("kind <> 'final'")
    key = ["sentence_index", "kind", "subject", "relation", "object", "token", "score"]
    assert sorted(map(str, spark.read.parquet(out).select(key).collect())) == sorted(map(str, batch.select(key).collect()))


def test_windowed_counts(spark):
    events = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0)], "event_type string, ts string, value double").selectExpr("event_type", "to_timestamp(ts) ts", "value")
    assert [(r.n, r.total) for r in windowed_counts(events).collect()] == [(2, 3.0)]


def test_runs_without_output(spark):
    rows = spark.createDataFrame([("a", 0, "user: hello"), ("b", 0, None), ("c", 0, "A knight rode through the forest.")], "run_id string, sentence_index int, text string")
    got = read_stories(rows)
    assert {r.run_id for r in got.select("run_id").distinct().collect()} == {"c"}
    assert read_stories(rows.limit(0)).count() == 0


def reader(edges, nodes="abcdef", inferred="", oracle=None):
    """A reader whose graph has the (source, target, active) edges."""
    r = Reader("x", oracle=oracle)
    r.s.nodes = {n: {"kind": "CONCEPT", "said": [], "inferred": n in inferred} for n in nodes}
    for src, dst, active in edges:
        e = r.add(src, "to", dst, set(), free=True)
        e.active, e.asserted = active, False
        e.visibility = 1 if active else 0
    return r


def live(r):
    return {(e.src, e.dst) for e in r.live()}


def test_paths_wake_before_labels_are_asked():
    r = reader([("a", "b", True), ("b", "c", False), ("c", "d", False), ("d", "e", True), ("a", "f", False), ("f", "e", False), ("b", "f", True)])
    assert not r.connected({"a", "e"}) and r.can_connect({"a", "e"})
    r.wake_paths({"a", "e"})
    assert r.connected({"a", "e"}) and live(r) == {("a", "b"), ("d", "e"), ("b", "f"), ("f", "e")}


def test_labels_are_asked_twice_then_related():
    class Shy(StubOracle):
        asked = 0

        def ask(self, method, **given):
            if method == "label":
                Shy.asked += 1
                return "meets" if given["a"] == "d" and given["attempt"] else ""
            return super().ask(method, **given)

    r = reader([("a", "b", True), ("a", "c", True), ("d", "e", True)], oracle=Shy())
    assert not r.can_connect({"a", "d"})
    r._repair({"a", "d", "f"}, "text")
    assert r.connected({"a", "d", "f"}) and Shy.asked == 4
    assert {(e.src, e.label, e.dst) for e in r.live()} >= {("d", "meets", "a"), ("f", "relates_to", "a")}


def test_all_that_is_visible_wakes_in_a_dead_graph():
    r = reader([("a", "b", False), ("c", "d", False)])
    r.s.edges[0].visibility = 1
    r.wake_all(set())
    assert live(r) == {("a", "b")}


def test_the_last_edge_of_a_chain_gains():
    r = reader([("c", "b", True), ("b", "a", True), ("c", "d", True), ("a", "e", True), ("f", "f2", True)], nodes=["a", "b", "c", "d", "e", "f", "f2"], inferred=["a", "b", "c", "f"])
    r._reinforce()
    got = {(e.src, e.dst): e.visibility for e in r.s.edges.values()}
    assert got == {("c", "b"): 1, ("b", "a"): 1, ("c", "d"): 3, ("a", "e"): 3, ("f", "f2"): 3}
    r._reinforce()
    r._reinforce()
    assert max(e.visibility for e in r.s.edges.values()) == 5


def test_pruning_asks_again_when_too_much_is_kept():
    class Keeper(StubOracle):
        calls = []

        def ask(self, method, **given):
            if method == "keep":
                Keeper.calls.append(given.get("aggressive", False))
                return given["triplets"][:2] if given.get("aggressive") else given["triplets"]
            return super().ask(method, **given)

    names = [f"n{i}" for i in range(30)]
    r = reader([(a, b, True) for a, b in zip(names, names[1:])] + [("n0", "n29", True)], nodes=names, oracle=Keeper())
    r.s.sentence = 5
    r._prune("text", set())
    assert Keeper.calls == [False, True] and len(r.live()) == 2


def test_a_model_behind_a_client():
    class Client:
        prompts = []

        def generate(self, prompts, temperature):
            Client.prompts += [(p, temperature) for p in prompts]
            if any("boom" in p for p in prompts):
                raise RuntimeError("down")
            return [
                'thinking [1] final [["a", "sees", "b"], ["x"]]' if "state or imply" in p else '{"label": "yes", "confidence": 90}' if "category" in p
                else '{"label": "guards"}' if "joins" in p else '{"scores": {"t": 1}}' if "matter" in p else "no payload" for p in prompts
            ]

    m = ModelOracle(Client(), batch=2)
    assert m.ask("relationships", nodes=["a", "b"], text="t", persona="a pupil") == [("a", "sees", "b")]
    assert "a pupil" in Client.prompts[0][0].split("\n")[0] and Client.prompts[0][1] == 0.8
    assert m.ask("label", a="a", b="b", text="t") == "guards" and m.ask("scores", triplets=["t"], text="x") == {"t": 1}
    assert m.ask("pronouns", sentence="He", context=[]) == {} and m.ask("keep", triplets=["t"], text="x") == ["t"]
    got = m.ask_all("judge", [{"persona": p} for p in ("x", "y", "boom", "z")])
    assert [g["label"] for g in got] == ["yes", "yes", "uncertain", "uncertain"] and got[0]["reason"] == "unparsable"
    assert m.ask("validate", triplet=("a", "b", "c"), text="t") == {"valid": True, "corrected": None}
    r = Reader("x", oracle=m)
    assert r.read("A knight rode through the forest.") and r.read("The knight saw a dragon.")


def test_a_question_writes_its_text_once(monkeypatch):
    class Text(str):
        written = 0

        def __repr__(self):
            Text.written += 1
            return str.__repr__(self)

    text, stub = Text("it's a \"long\" day"), StubOracle()
    triplets, pairs = [f"a|meets|b{i}" for i in range(40)], [(f"a{i}", "it's") for i in range(40)]
    got = [stub.ask(m, triplets=triplets, text=text) for m in ("scores", "keep", "relevant")], stub.ask("attach", pairs=pairs, text=text)
    assert Text.written <= 4
    draw = lambda *parts: int(hashlib.sha1(repr(parts).encode()).hexdigest()[:8], 16)
    plain = str(text)
    drawn = {t: draw(t, plain) for t in triplets}
    assert got[0] == [{t: d % 4 for t, d in drawn.items()}, [t for t, d in drawn.items() if d % 8], [i for i, d in enumerate(drawn.values()) if d % 3 == 0][:10]]
    assert got[1] == [(a, "relates_to", b) for a, b in pairs if draw(a, b, plain) % 4 == 0]


def test_only_a_sentence_that_may_be_lost_is_snapshot(monkeypatch):
    copies = []
    copied = State.copied
    monkeypatch.setattr(State, "copied", lambda s: copies.append(s.sentence) or copied(s))
    r = Reader("x")
    r.read("The knight rode the dragon.")
    r.read("The princess met the knight.")
    assert not copies
    assert r.read("Then he did.") and copies == [3] and r.s.sentence == 3


def test_a_sentence_attaches_to_nodes_that_the_last_view_left_out():
    class Asked(StubOracle):
        pairs = None

        def ask(self, method, **given):
            if method == "attach":
                Asked.pairs = set(given["pairs"])
            return {t: 0 for t in given["triplets"]} if method == "scores" else super().ask(method, **given)

    r, views, asked = Reader("x", oracle=Asked()), [set(), set()], 0
    for text in ["The knight rode the horse.", "The horse saw a dragon.", "The dragon met a princess.", "The princess found the castle.", "The castle held a treasure.", "The treasure pleased the king."]:
        Asked.pairs, gone = set(), views[-2] - views[-1]
        r.read(text)
        said = {n for n, node in r.s.nodes.items() if r.s.sentence in node["said"]}
        assert Asked.pairs == {(min(a, b), max(a, b)) for a in said for b in gone if a != b}
        asked += len(Asked.pairs)
        views.append(set(r.s.active_before))
    assert asked


def test_a_sentence_leaves_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(story, "ROWS", 3)
    whole, parts = Reader("x"), Reader("x")
    for text in TEXT.split(". "):
        batches = parts.batches(text)
        assert max(b.num_rows for b in batches if b.column("kind")[0].as_py() == "sentence") <= 3
        assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == whole.read(text)
    assert [tuple(r.values()) for b in parts.last() for r in b.to_pylist()] == whole.finish()


def test_bridges_and_parts_by_column_equal_removal_one_by_one():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(2, 12)
        links = [rng.sample(range(n), 2) for _ in range(rng.randint(0, 16))]
        r = reader([(f"n{a}", f"n{b}", True) for a, b in links], nodes=[f"n{i}" for i in range(n)])
        names = {x for a, b in links for x in (a, b)}
        pairs = {frozenset(x) for x in links}

        def parts(pairs):
            found = [{x} for x in names]
            for pair in pairs:
                meet = [p for p in found if p & pair]
                found = [p for p in found if not p & pair] + [set().union(*meet)]
            return {frozenset(f"n{i}" for i in p) for p in found}

        e = r.s.edges
        assert {frozenset(p) for p in story._parts(e, e.live(), set())} == parts(pairs)
        got = {frozenset((e.nodes.all[c >> 32], e.nodes.all[c & 0xFFFFFFFF])) for c in story._bridges(e.codes(e.live())).tolist()}
        assert got == {frozenset(f"n{i}" for i in p) for p in pairs if len(parts(pairs - {p})) > len(parts(pairs))}


def test_many_edges_are_added_as_one_by_one():
    rng = random.Random(3)
    one, many = reader([], nodes="abcdef"), reader([], nodes="abcdef")
    for at in range(1, 30):
        one.s.sentence = many.s.sentence = at
        some = [(*rng.sample("abcdef", 2), rng.choice(["sees", "meets", "is_not", "", "b"])) for _ in range(8)]
        for a, b, label in some:
            one.add(a, label, b, set(), free=True)
        many.add_all([(a, label, b) for a, b, label in some])
        row = lambda r: [(i, e.src, e.label, e.dst, e.made, e.since, e.visibility, e.active, e.asserted) for i, e in r.s.edges.items()]
        assert row(one) == row(many) and one.reached == many.reached and len(one.s.edges) == len(row(one))
