"""HTML extraction, URL filters and toxicity."""

import math
import random
import re
import zlib

import numpy as np

from fabulagraph.llm import hashing, html, toxicity, urls


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


CASES = {
    "plain": (page("<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><article><h1>Head</h1><p>One  two<br>three</p><p>Four &amp; five</p></article><footer>&copy; me</footer>"), "Head\n\nOne two three\n\nFour & five"),
    "unclosed": (page("<div class='ad'>Buy</div><article><h1>H</h1><p><b>H<br><p>A &lt;b&gt; c</p></article>"), "H\n\nH\n\nA <b> c"),
    "script": (page("<script>var x='<p>no</p>';</script><style>p{}</style><article><p>Yes</p><script>1<2</script><p>More</p></article>"), "Yes\n\nMore"),
    "aside": (page("<header><h1>Site</h1></header><article><p>Short.</p><p>Text with <a href='x'>a link</a> inside.</p></article><aside class='sidebar'><p>Related</p></aside><section id='comments'><p>Nice!</p></section>"), "Short.\n\nText with a link inside."),
    "notice": (page("<div class='cookie-notice'><p>We use cookies</p></div><div id='content'><p>Main text here.</p></div><form class='search'><label>Find</label><input></form>"), "Main text here."),
    "comment": (page("<!-- <p>hidden</p> --><article><p>Seen</p></article>"), "Seen"),
    "cut": ("<html><body><article><p>All of th", "All of th"),
    "cut tag": ("<html><body><article><p>All</p><p cla", "All"),
    "entities": (page("<article><p>&#233;&eacute;&nbsp;x &unknown; &amp</p></article>"), "éé x &unknown; &"),
}


def test_extraction():
    model = html.trained()
    for name, (source, want) in CASES.items():
        assert model.extract(source) == want, name
    assert model.extract(None) == model.extract("") == model.extract("<p") == ""


def test_marginals_are_those_of_enumeration():
    """Messages give what summing over all states gives."""
    from itertools import product

    model = html.Model(html.labelled_pages(60, 3))
    p = html.Page("<div class='nav'><p>x</p></div><article><p class='ad'>y</p></article>")
    unary = []
    for found in p.features():
        b = [1.0, 1.0, 1.0]
        for f in found:
            b = [x * u for x, u in zip(b, model.unary.get(f, [1, 1, 1]))]
        unary.append(b)
    unary[0] = [1.0, 0.02, 0.001]
    n, total, content = len(p.tags), 0.0, [0.0] * len(p.tags)
    for states in product(range(3), repeat=n):
        w = unary[0][states[0]]
        for e in range(1, n):
            w *= unary[e][states[e]] * model.pairs.get(html._kind(p.tags[e]), model.other)[states[p.parents[e]]][states[e]]
        total += w
        for e in range(n):
            content[e] += w * (states[e] == html.CONTENT)
    for got, want in zip(model.marginals(p), content):
        assert abs(got - want / total) < 1e-9


def test_held_out_pages():
    model, right, seen = html.trained(), 0, 0
    for source in html.labelled_pages(150, 12345):
        p, states = html.Page(source), []
        for e, parent in enumerate(p.parents):
            states.append(p.states[e] if p.states[e] is not None else states[parent] if e else 0)
        for m, s in list(zip(model.marginals(p), states))[1:]:
            seen += 1
            right += (m > 0.5) == (s == html.CONTENT)
    assert right / seen > 0.95


def test_html_query(spark):
    rows = [(1, "u", CASES["plain"][0], 5), (1, "u", CASES["plain"][0], 5), (None, None, None, 1), (3, "v", "", 2), (4, "w", "<p>" + "long " * 50000, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted(html.op2(pages).collect(), key=str)
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and sum(r.page_id == 1 for r in got) == 2
    assert html.op2(pages.limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, "http://a.NET/x", "a.net", "/x", "net/", "block"), (2, "https://www.example.net/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "http://badexample.net/en/", "badexample.net", "/en/", "net/", "block"), (4, "http://x.example.com/de/#a", "x.example.com", "/de/", "example.com/de/", "block"),
        (5, "http://y.org/fr/a", "y.org", "/fr/a", "org/fr/", "allow"), (6, "http://net", "net", "", None, None), (7, None, "", "", None, "allow"), (8, "no scheme.net/x", "", "", None, "allow"),
        (9, "http://HÉ.com?x://y.net/z", "hÉ.com", "", None, None), (10, "http://adult-casino.example.com/xxx", "adult-casino.example.com", "/xxx", None, "block"),
        (11, "http://a://b.net/p", "a:", "//b.net/p", None, None), (11, "http://a://b.net/p", "a:", "//b.net/p", None, None),
        (12, "https://long.org/" + "a" * 100000, "long.org", "/" + "a" * 100000, None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1], 7) for r in rows], "page_id bigint, url string, host int")
    got = {r.page_id: tuple(r)[1:] for r in urls.op7(pages).collect()}
    for r in rows:
        assert got[r[0]][:3] == r[2:5], r
        assert r[5] is None or got[r[0]][3] == r[5], r
    assert urls.op7(pages.limit(0)).count() == 0


#: Urls of no host in the training table, for measuring.
HELD_OUT_BLOCKED = """
casino-royale.com/roulette  slotsparadise.com/jackpot  pokernight.net/play  bets4you.com/odds  livebetting.com/football  adultchat.com/room  xxx-tube.com/video  sexshop.com/toys
teenporn.com/watch  viagra-discount.com/order  pills4less.com/cheap  instantloans.com/apply  easy-cash-loans.com/now  replica-bags.com/sale  seolinks.com/buy  spammer.com/list
crackz.com/keygen  warezone.com/download  verify-your-account.com/login  ad-banner.com/click  freeprize.com/claim  win-big-lottery.com/ticket  nudecams.com/live  escortservice.com/girls
"""
HELD_OUT_ALLOWED = """
harvard.edu/library  lemagazine.fr/cuisine  tagesschau.de/inland  gardens.org/tulips  numpy.org/doc/stable  mozilla.org/firefox  cityofboston.gov/parks  britishmuseum.org/collection
www.cookbooks.com/stew  cathedral.org/history  physics-lectures.edu/optics  m.weather.gov/rain  blog.travelling.com/peru  football.org/rules  swimming.org/lessons  dictionary.com/browse/house
orchestra.org/brahms  farmers-market.org/apples  railway.co.uk/stations  en.wikibooks.org/wiki/Chess  children.org/stories  wildlife.org/otters  castle.de/besuch  poems.es/lorca
"""


def test_url_model():
    right = (urls.probabilities([u for u, _ in urls.LABELLED]) >= 0.5) == [bool(y) for _, y in urls.LABELLED]
    assert right.mean() > 0.97
    hosts = {u.partition("/")[0] for u, _ in urls.LABELLED}
    held = [(u, y) for text, y in ((HELD_OUT_BLOCKED, 1), (HELD_OUT_ALLOWED, 0)) for u in text.split()]
    assert not hosts & {u.partition("/")[0] for u, _ in held}
    got = urls.probabilities([u for u, _ in held]) >= 0.5
    recall = np.mean([g for g, (_, y) in zip(got, held) if y])
    alarms = np.mean([g for g, (_, y) in zip(got, held) if not y])
    assert recall >= 0.9 and alarms <= 0.1, (recall, alarms, [u for g, (u, y) in zip(got, held) if g != y])


def test_url_features_by_brute_force():
    some = ["a.b/cé", "", "host", "a.b/c" * 40, "x/y/z"]
    row, slot = urls.features(some)
    for i, u in enumerate(some):
        name, cut, rest = u.partition("/")
        marked = f"^{name}${cut}{rest}"
        grams = {marked[k : k + n] for n in urls.SIZES for k in range(len(marked) - n + 1)}

        def hashed(gram):
            h = np.array([len(gram)], np.uint64)
            for c in gram:
                h = hashing.mix(h + np.uint64(ord(c)))
            return int(h[0]) % (1 << urls.BITS)

        assert sorted(slot[row == i].tolist()) == sorted({hashed(g) for g in grams}), u


def texts(n, seed):
    rng = random.Random(seed)
    bad = ["idiot", "moron", "scumbag", "worthless", "stupid"]
    rows = []
    for i in range(n):
        w = ["".join(rng.choices(["the", "an", "ing", "er", "on", "st", "re"], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        y = i % 4 == 0
        if y:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), int(y)))
    return rows


def test_restoring():
    scorer = toxicity.fit([(t, y) for _, t, y in texts(200, 1)])
    restored = toxicity.Restorer(scorer.model)
    for hidden, plain in (("1d10t", "idiot"), ("m0r0n!", "moron!"), ("w0rthl3ss", "worthless"), ("s t u p i d", "stupid"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("st*pid", "stupid")):
        assert restored(hidden) == plain, hidden
    for hidden, plain in (("s  t  u  p  i  d", "stupid"), ("i. d. i. o. t", "idiot")):  # with wider gaps
        assert restored(hidden) == plain, hidden
    for same in ("the an ing", "2020", "on 12 the", "er*** the$$$", ""):
        assert restored(same) == same


def test_viterbi_is_the_least_of_all_readings():
    scorer = toxicity.fit([(t, y) for _, t, y in texts(200, 1)])
    m = scorer.model

    def all_readings(token):
        out = [(0.0, "")]
        for i in range(len(token)):
            out = [(c + p, t + x) for c, t in out for x, p in toxicity._options(token, i)]
        return out

    def cost(text):
        total = 0.0
        for w in text.split(" "):
            padded = f"^^{w}$"
            total += sum(m.cost(padded[i - 2 : i], padded[i]) for i in range(2, len(padded)))
        return total

    for token in ("1d10t", "s.t.0", "aaab6", "t|1!"):
        best = min((c + cost(t), t) for c, t in all_readings(token))
        assert abs(min(c + cost(t) for c, t in all_readings(token) if t == toxicity.restore(token, m)) - best[0]) < 1e-9


def test_long_stretches_are_read_whole():
    scorer = toxicity.fit([(t, y) for _, t, y in texts(200, 1)])
    long = "1d10t." * 400
    assert toxicity.restore(long, scorer.model).replace(" ", "") == "idiot" * 400
    assert toxicity.Restorer(scorer.model)("s t u p i d " * 300).replace(" ", "") == "stupid" * 300


def test_scores_by_brute_force():
    """A score is the logistic function of the weights of the distinct words and beginnings of the restored text."""
    rows = [(t, y) for _, t, y in texts(200, 1)]
    scorer = toxicity.fit(rows)
    restored = toxicity.Restorer(scorer.model)
    for text in ("you 1d10t", "m o r o n the an", "the an ing", "", "w0rthl3ss " * 50 + "scumbag"):
        found = set()
        for w in re.findall(r"[^\W\d_]+", restored(text)):
            found |= {w} | {w[:k] + "-" for k in (4, 5, 6) if len(w) > k}
        total = scorer.intercept + sum(scorer.features.get(f, 0.0) for f in found)
        assert abs(scorer.score(text) - 1 / (1 + math.exp(-total))) < 1e-9


def test_toxicity_query(spark, make, edge_rows):
    rows = texts(400, 2)
    extra = [(9000, "you 1d10t, you m o r o n", 0), (9001, "the an ing on", 0)]
    docs = make([(i + 100, t) for i, t, _ in rows] + [(i, t) for i, t, _ in extra] + edge_rows)
    labels = spark.createDataFrame([(i + 100, 1, y) for i, _, y in rows] + [(1, 0, 0), (77777, 0, 1), (None, 0, 1), (2, 0, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.op6(docs, labels).collect()
    assert len(got) == 400 + 2 + len(edge_rows)
    by = {r.doc_id: r for r in got}
    held = [(by[i + 100], y) for i, _, y in rows if zlib.crc32(str(i + 100).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and len(held) > 50
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.95
    assert by[9000].predicted == 1 and by[9001].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in toxicity.op6(docs, labels.limit(0)).collect()} == {1 / (1 + math.exp(30))}
    assert {r.predicted for r in toxicity.op6(docs, labels.where("toxic = 1")).collect()} == {1}
    assert toxicity.op6(docs.limit(0), labels).count() == 0


def test_texts_of_any_length_train(spark, make):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    plain = [i for i in range(1, 60) if not held(i)]
    long = [i for i in range(100, 120) if not held(i)][:4]
    docs = make([(i, "the an ing on er") for i in plain] + [(i, "the an idiot on " * 70_000) for i in long] + [(900, "an idiot"), (901, "an ing")])
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in plain + long], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.op6(docs, labels).collect()}
    assert got[900] == 1 and got[901] == 0


def test_tasks_fit_what_memory_fits(spark):
    """All rows train, near copies and more than 3,000 of a label too, as they do in memory."""
    rows = [(t, y) for _, t, y in texts(4400, 3)] + [("you 1d10t and you m o r o n " * 3, 1)] * 30
    want, got = toxicity.fit(rows), toxicity.fit_table(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    assert got.model.tri == want.model.tri and got.model.uni == want.model.uni
    assert sum(got.model.uni.values()) > 4400 * 20
    assert got.features.keys() == want.features.keys()
    assert max(abs(got.features[f] - w) for f, w in want.features.items()) < 1e-3 and abs(got.intercept - want.intercept) < 1e-3
