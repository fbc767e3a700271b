"""Decontamination, the n-gram join, repeated passages and language ID against plain Python."""

import random
import re
import zlib
from collections import Counter
from math import log2

import numpy as np
import pytest

from fabulagraph.llm import decontaminate, hashing, language, ngram_join, suffixes
from fabulagraph.llm.components import components


def prose(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def test_decontamination(spark, make, edge_rows):
    rng = random.Random(1)
    items = [(i, " ".join(prose(rng, rng.choice((3, 13, 20, 60))))) for i in range(12)] + [(20, None), (21, "..."), (None, "some lost words"), (3, "Again, a THIRD item here")]
    docs = [*edge_rows]
    for i in range(60):
        w = prose(rng, rng.choice((5, 40, 400)))
        if i % 2:
            part = (items[i % 12][1] or "").split()
            k = rng.randrange(len(w))
            w[k:k] = part[: rng.choice((8, 13, 15, 60))]
        docs.append((100 + i, ("—" if i % 3 else ", ").join(w).replace("w", "W") if i % 5 == 1 else " ".join(w)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = decontaminate.brute_force([(i, t) for i, t in enumerate(t for _, t in docs)], items)
    rows = [(i, t) for i, (_, t) in enumerate(docs)]
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.op3(make(rows), bench).collect()}
    assert got == want and any(v[4] for v in want.values())
    named = spark.createDataFrame([(f"q-{i}" if i is not None else None, t, 1, "x") for i, t in items], "item_id string, text string, n_words int, hits string")
    want_named = decontaminate.brute_force(rows, [(r.item_id, r.text) for r in named.collect()])
    assert {r.doc_id: tuple(r)[1:] for r in decontaminate.op3(make(rows), named).collect()} == want_named
    small = decontaminate.judged(decontaminate.scan(make(rows), bench, block_chars=300)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in small} == {k: v[:3] for k, v in want.items()}
    for r in decontaminate.spans(decontaminate.scan(make(rows), bench)).collect():
        covered = "".join(rows[r.doc_id][1][s.start : s.end] + " " for s in r.spans)
        assert len(decontaminate.normalised(covered.encode())) == want[r.doc_id][1]
    assert decontaminate.op3(make(rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.op3(make(rows).limit(0), bench).count() == 0


def test_matches_are_windows():
    """Few different words, so that matches overlap, repeat and touch the ends of texts and items."""
    rng = random.Random(2)
    for _ in range(150):
        text = lambda n: " ".join(rng.choices("ab", [9, 1], k=n))
        items = [(i, text(rng.choice((1, 7, 12, 13, 14, 20, 40)))) for i in range(4)]
        docs = [(0, text(60)), (1, items[0][1]), (2, text(9) + " " + items[1][1] + " " + text(3)), (3, items[2][1][4:] + " b " + items[3][1])]
        matcher, want = decontaminate.Matcher(items), decontaminate.brute_force(docs, items)
        for i, t in docs:
            n, ranges, ids = matcher.scan(t.encode())
            assert (n, sum(b - a for a, b in ranges), len(ids)) == want[i][:3]


def near_copies(seed, groups=6, copies=14, words=120):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        w = prose(rng, rng.choice((4, 9, 30, words, 3 * words)), 5000)
        for _ in range(copies):
            x = list(w)
            for _ in range(rng.randrange(0, 1 + len(x) // 14)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(x).upper() if rng.random() < 0.1 else " ".join(x))
    rows += [" ".join(prose(rng, 40, 5000)) for _ in range(40)]
    common = " ".join(prose(rng, 30, 5000))
    rows += [common + " " + " ".join(prose(rng, rng.choice((3, 10, 30)), 5000)) for _ in range(60)]
    return rows


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("middle", [8192, 3])
def test_ngram_join(make, edge_rows, middle):
    texts = near_copies(5)
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + edge_rows + [(7, "one TWO"), (8, "one two"), (9, " ".join(f"r{i}" for i in range(3000)))]
    long = [f"q{i}" for i in range(100)]
    rows += [(None, " ".join(long)), (None, " ".join([*long[:-1], "z"])), (20, " ".join([*long[:-2], "y", "z"])), (21, texts[0]), (21, " ".join(f"u{i}" for i in range(50))), (22, " ".join(f"u{i}" for i in range(49)) + " v")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.op4(make(rows), middle).collect())
    assert got == brute_components(rows)


def test_candidates_of_a_large_group(make, monkeypatch):
    """2,000 near copies of one text: what is verified grows with the group, not with its square."""
    rng = random.Random(9)
    base = prose(rng, 150, 5000)
    rows = []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    asked = []

    def counted(pairs, *rest, verify=ngram_join.verify):
        asked.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(ngram_join, "verify", counted)
    ngram_join.op4(make(rows)).count()
    assert sum(asked) <= 4 * 2000


def test_sketches_never_rule_out_what_is_similar():
    rng = np.random.default_rng(3)
    for n in (5, 60, 130, 700, 20000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for drop in (0, n // 14, n // 7):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop // 9, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            differ = len(a) + len(b) - 2 * both
            size = min(ngram_join._sketch_size(len(a)), ngram_join._sketch_size(len(b)))
            x, y = (ngram_join._folded(ngram_join.sketch(s), size) for s in (a, b))
            assert (x != y).sum() <= differ


def test_ngram_join_of_nothing(make):
    assert ngram_join.op4(make([(1, "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in ngram_join.op4(make([(1, None), (None, "  ")])).orderBy("doc_id").collect()] == [(None, 0, None), (1, 0, 1)]


def test_allocation_covers_the_difference():
    for band in range(60):
        m, ones, loss = ngram_join.allocate(band)
        if m > 1:
            assert (m - ones) + 2 * ones > ngram_join.most_different(band) + loss and m >= ones
    for n in (1, 2, 5, 6, 7, 50, 1000, 30000):
        bands = ngram_join.bands_of(n)
        lo, hi = ngram_join._sizes(bands[-1])
        assert lo <= n <= hi and ngram_join._sizes(bands[0])[0] <= -(-85 * n // 100)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 5), (None, 1)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect():
        got.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5, 9]]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_word_hashes_do_not_depend_on_place():
    a = hashing.word_hashes("ab  ünï ab\x00 AB".encode())[0]
    assert a[0] == a[3] and len(set(a.tolist())) == 3
    long = ("x" * (hashing.CHUNK + 5) + " y").encode()
    assert len(hashing.word_hashes(long)[0]) == 2 and hashing.word_hashes(b"y")[0][0] == hashing.word_hashes(long)[0][1]
    assert len(hashing.word_hashes(b"")[0]) == 0


def covered(spans):
    return {i for s in spans.split(",") if s for i in range(*map(int, s.split(":")))}


def test_passages(make, edge_rows):
    rng = random.Random(3)
    shared = [prose(rng, n, 10**6) for n in (49, 50, 51, 70, 200)]
    rows = list(edge_rows)
    for i in range(60):
        w = prose(rng, rng.choice((10, 60, 300)), 10**6)
        for s in rng.sample(shared, rng.choice((0, 1, 2))):
            k = rng.randrange(len(w))
            w[k:k] = s
        rows.append((100 + i, " ".join(w)))
    rows += [(200, rows[-1][1]), (201, " ".join(rows[-1][1].split()[:90])), (202, " ".join(shared[3] * 3))]
    known = [(i, t) for i, t in rows if i is not None and i != 4]
    want = suffixes.brute_force(known)
    got = {r.doc_id: r for r in suffixes.op8(make(rows)).collect()}
    assert len(got) == len({i for i, _ in rows})
    for i, t in known:
        assert covered(got[i].spans) == want[i], i
        assert got[i].n_repeated == len(want[i]) and (got[i].n_spans > 0) == bool(want[i])
    assert suffixes.op8(make(rows).limit(0)).count() == 0


def ppm_bits(training, text):
    """PPM of order 3 with escape C, byte by byte."""
    counts = [{} for _ in range(4)]
    for t in training:
        data = bytes(3) + t
        for i in range(3, len(data)):
            for k in range(4):
                counts[k].setdefault(data[i - k : i], Counter())[data[i]] += 1
    data, bits = bytes(3) + text, 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                bits += 8
                break
            seen = counts[k].get(data[i - k : i])
            if seen:
                n, q = sum(seen.values()), len(seen)
                if data[i] in seen:
                    bits -= log2(seen[data[i]] / (n + q))
                    break
                bits -= log2(q / (n + q))
    return bits


def test_ppm_is_exact():
    training = {"x": [b"the cat sat on the mat", b"that cat"], "y": ["die Katze saß".encode(), b"der Hund"], "z": [b"q"]}
    model = language.Model(training)
    texts = ["the hat".encode(), "Katze ß".encode(), b"", b"\xff\x00zz", b"cat " * 50]
    got = model.bits(texts)
    for i, t in enumerate(texts):
        for j, name in enumerate(model.languages):
            assert got[i, j] == pytest.approx(ppm_bits(training[name], t), rel=1e-4, abs=1e-3)


def test_ppm_over_chunks(monkeypatch):
    model = language.Model({"x": [b"abc abd"], "y": [b"xyz"]})
    text = b"abc xyz abd " * 40
    whole = model.bits([text, b"ab"])
    monkeypatch.setattr(language, "CHUNK", 7)
    assert model.bits([text, b"ab"]) == pytest.approx(whole, rel=1e-5)


def test_language(make, edge_rows):
    rng = random.Random(4)
    bits = {"en": "th er ing and the of".split(), "de": "sch ung ein der ü".split()}
    rows = [(i, " ".join("".join(rng.choices(bits[k], k=3)) for _ in range(20)), k) for i, k in ((1000 + i, ("en", "de")[i % 2]) for i in range(120))]
    rows += [(*r, None) for r in edge_rows] + [(500, "123 !?", "en"), (501, "thering andof", None)]
    got = language.op9(make(rows)).collect()
    named = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(named[i].lang_pred == k for i, _, k in rows[:120])
    assert [named[i].lang_pred for i in (1, 2, 3, 500)] == ["und"] * 4 and named[501].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language.op9(make([(1, "abc")])).collect()} == {"und"}
    assert language.op9(make(rows).limit(0)).count() == 0


def test_language_of_many_models_and_by_brute_force(make, monkeypatch):
    """Code lengths byte by byte give the query's language and score, whether languages share a model or not."""
    rng = random.Random(8)
    bits = {f"l{k:02d}": ["".join(rng.choices("abcdefghäß", k=3)) for _ in range(5)] for k in range(7)}
    rows = [(i, " ".join(rng.choices(bits[k], k=12)), k) for i, k in enumerate(sorted(bits) * 9)]
    rows += [(900, "x" * 3000 + "a", "l00"), (901, " ".join(rng.choices(bits["l03"], k=12)), None)]
    training = {}
    for i, t, k in rows:
        if k and zlib.crc32(str(i).encode()) % 3 != 1:
            training.setdefault(k, set()).add(t.encode())
    want = {}
    for i, t, _ in rows:
        cost = {k: ppm_bits(sorted(x), t.encode()) for k, x in training.items()}
        least = min(cost.values())
        want[i] = (min(k for k in cost if cost[k] == least), 1 / sum(2 ** (-(c - least) / len(t.encode()) ** 0.5) for c in cost.values()))
    for per, most in ((16, 1 << 28), (2, 1 << 28), (2, 1)):
        monkeypatch.setattr(language, "LANGUAGES_PER_MODEL", per)
        monkeypatch.setattr(language, "MODEL_BYTES", most)
        for r in language.op9(make(rows)).collect():
            assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], rel=1e-3), r


def test_training_texts_are_whole_and_bounded(make, monkeypatch):
    monkeypatch.setattr(language, "MOST_BYTES", 500)
    monkeypatch.setattr(language, "BYTES_PER_LANGUAGE", 1200)
    rows = [(i, f"text {i} " * (100 if i < 10 else 10), "en") for i in range(60)]
    got = [bytes(r.text).decode() for r in language.training_rows(make(rows).select("doc_id", "text", "lang")).collect()]
    assert got and set(got) <= {t for _, t, _ in rows[10:]} and sum(map(len, got)) <= 1200
    monkeypatch.setattr(language, "BYTES_PER_LANGUAGE", 1 << 20)
    assert len(language.training_rows(make(rows).select("doc_id", "text", "lang"), 20).collect()) == 20
