"""Registered queries judge whole tables and whole values, against plain Python."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

from fabulagraph.plans import views as V
from fabulagraph.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def parts():
    """Per run, the components of all its edges: least node to number of nodes."""
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    above = defaultdict(dict)

    def top(up, x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for run, src, dst in con.execute(f"WITH {V.V_EDGES} SELECT run_id, src, dst FROM v_edges").fetchall():
        a, b = sorted((top(above[run], src), top(above[run], dst)))
        above[run][b] = a
    return {run: Counter(top(up, x) for x in list(up)) for run, up in above.items()}


def test_connectivity_of_whole_runs(spark, parts):
    got = {r.run_id: r.connected for r in QUERIES["connectivity"](spark, DATA).collect()}
    assert got == {run: len(n) <= 1 for run, n in parts.items()}


def test_bridges_of_whole_runs(spark, parts):
    want = set()
    for run, n in parts.items():
        largest = min(n, key=lambda x: (-n[x], x))
        want |= {(run, x, largest) for x in n if x != largest}
    assert want and {tuple(r) for r in QUERIES["connect_components"](spark, DATA).collect()} == want


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    """Conversations whose telling words lie beyond the first 24 characters."""
    at = str(tmp_path_factory.mktemp("talk"))
    far = "a long and plain beginning that "
    rows = [(1, 0, "asker", far + "would never end"), (1, 1, "asker", far + "ends"), (2, 0, "asker", far + "likes trees"), (2, 1, "user", far + "holds <s> here"), (3, 0, "user", far + "ends"), (3, 1, "asker", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at, rows


def test_negation_in_whole_texts(spark, talk):
    got = {(r.conv_id, r.turn): (r.negation, r.has_letter) for r in QUERIES["negation_filter"](spark, talk[0]).collect()}
    assert got == {(i, k): ("never" in (t or ""), t is not None) for i, k, _, t in talk[1]}


def test_labels_of_whole_texts(spark, talk):
    got = {(r.conv_id, r.turn): r.label for r in QUERIES["edge_label_norm"](spark, talk[0]).collect()}
    assert got[1, 0] == "a_long_and_plain_beginning_that_would_never_end" and got[2, 0] == "enjoys" and got[3, 1] == ""


def test_triplets_of_whole_texts(spark, talk):
    got = {(r.conv_id, r.turn): (r.s, r.r) for r in QUERIES["repair_triplets"](spark, talk[0]).collect()}
    plain = {(i, k): t.replace(" ", "_") for i, k, _, t in talk[1] if t}
    assert got[1, 1] == ("asker", plain[1, 1]) and got[2, 1] == ("UNKNOWN", "related_to") and got[3, 0] == (plain[3, 0], plain[3, 0])
