"""Graph operators over edges (run_id, src, dst, ...); each names what it is of the inventory."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulagraph.functions import text as T
from fabulagraph.operators.lineage import Tables, components

RUN = "run_id"


def both_ways(edges: DataFrame) -> DataFrame:
    """(run_id, node, near): each edge from either end, once."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near")))
    return edges.select(RUN, F.explode(ends).alias("e")).select(RUN, "e.node", "e.near").distinct()


def active(edges: DataFrame, above: int = 0) -> DataFrame:
    """GRA-6: active edges of a visibility above ``above``."""
    return edges.where(F.col("active") & (F.col("visibility") > above))


def endpoints(edges: DataFrame) -> DataFrame:
    """GRA-25: distinct ends of the edges."""
    return edges.select(RUN, F.explode(F.array("src", "dst")).alias("node")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """GRA-34: (run_id, node, near_nodes) with sorted neighbours."""
    return both_ways(edges).groupBy(RUN, "node").agg(F.array_sort(F.collect_set("near")).alias("near_nodes"))


def distances(edges: DataFrame, sources: DataFrame, most: int = 2, directed: bool = False) -> DataFrame:
    """GRA-2, GRA-3, GRA-5: (run_id, node, distance) up to ``most`` steps from ``sources`` (run_id, node).

    The steps are unrolled joins; nodes reached before are merged by their least distance.
    """
    c = F.col
    steps = edges.select(RUN, c("src").alias("node"), c("dst").alias("near")).distinct() if directed else both_ways(edges)
    found = sources.select(RUN, "node").distinct().withColumn("distance", F.lit(0))
    front = found
    for k in range(1, most + 1):
        front = front.select(RUN, "node").join(steps, [RUN, "node"]).select(RUN, c("near").alias("node"), F.lit(k).alias("distance")).distinct()
        found = found.unionByName(front)
    return found.groupBy(RUN, "node").agg(F.min("distance").alias("distance"))


def carryover(edges: DataFrame, explicit: DataFrame, most: int = 2) -> DataFrame:
    """GRA-2, JOIN-11: nodes near explicit ones over active edges that aren't explicit."""
    near = distances(active(edges), explicit, most)
    return near.join(explicit.select(RUN, "node"), [RUN, "node"], "left_anti")


def view_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOIN-11: active edges whose ends both lie in ``nodes``."""
    kept = edges.where("active")
    for end in ("src", "dst"):
        kept = kept.join(nodes.select(RUN, F.col("node").alias(end)), [RUN, end], "left_semi")
    return kept


def best_of_pair(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """GRA-36: one edge per undirected pair, active ones first, then the earliest."""
    best = F.min_by(F.struct("src", "dst", "label", "active", order), F.struct((~F.col("active")).cast("int"), order, "src", "dst", "label"))
    pairs = edges.groupBy(RUN, F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).agg(best.alias("e"))
    return pairs.select(RUN, "e.*")


def simple(edges: DataFrame) -> DataFrame:
    """GRA-11: undirected pairs without direction and repeats."""
    return edges.where("src <> dst").select(RUN, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def is_connected(edges: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """GRA-14, GRA-35: (run_id, connected) of the edges and required nodes; one node or none is connected."""
    loops = edges.select(RUN, "src", "dst")
    if required is not None:
        loops = loops.unionByName(required.select(RUN, F.col("node").alias("src"), F.col("node").alias("dst")))
    return components(loops, RUN).groupBy(RUN).agg((F.count_distinct("component") <= 1).alias("connected"))


def focus_component(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """GRA-15: per run, the component with most focus nodes; of equal ones the least."""
    parts = components(edges, RUN)
    hits = parts.join(focus.select(RUN, "node").distinct().withColumn("hit", F.lit(1)), [RUN, "node"], "left")
    counts = hits.groupBy(RUN, "component").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("n"))
    first = counts.groupBy(RUN).agg(F.max("n").alias("n"))
    return counts.join(first, [RUN, "n"]).groupBy(RUN).agg(F.min("component").alias("component"), F.max("n").alias("n_focus"))


def bridging_edges(edges: DataFrame, label: str = "relates_to") -> DataFrame:
    """GRA-24: edges from every other component's least node to that of the largest component."""
    sizes = components(edges, RUN).groupBy(RUN, F.col("component").alias("node")).agg(F.count("*").alias("n"))
    largest = sizes.groupBy(RUN).agg(F.max("n").alias("n")).join(sizes, [RUN, "n"]).groupBy(RUN).agg(F.min("node").alias("dst"))
    return sizes.join(largest, RUN).where("node <> dst").select(RUN, F.col("node").alias("src"), "dst", F.lit(label).alias("label"))


def backbone(edges: DataFrame) -> DataFrame:
    """GRA-23's anchor: per run, the node of most active edges, then of most edges, then by name."""
    ends = edges.select(RUN, "active", F.explode(F.array("src", "dst")).alias("node"))
    degree = ends.groupBy(RUN, "node").agg(F.sum(F.col("active").cast("int")).alias("a"), F.count("*").alias("n"))
    return degree.groupBy(RUN).agg(F.min_by("node", F.struct(-F.col("a"), -F.col("n"), "node")).alias("node"))


def found_edges(edges: DataFrame, wanted: DataFrame, order: str = "edge_id") -> DataFrame:
    """JOIN-6, JOIN-7: of each (run_id, src, dst) that is asked for, the first edge with these ends; those without one fall out."""
    first = edges.groupBy(RUN, "src", "dst").agg(F.min(order).alias(order))
    return wanted.join(first, [RUN, "src", "dst"])


def nodes_by_text(rows: DataFrame, known: DataFrame, lemma: str) -> DataFrame:
    """JOIN-9: adds ``node``, the known node whose lemma is the row's canonical one; null if there is none."""
    nodes = known.select(F.col(lemma).alias("node")).distinct()
    return rows.join(nodes, rows[lemma] == nodes["node"], "left")


def reinforced(edges: DataFrame, again: DataFrame, most: int, order: str = "edge_id") -> DataFrame:
    """JOIN-8: edges, of which the first equal one (ends and label but for case and outer blanks) of each edge
    of ``again`` is one more visible, up to ``most``, active, and ``current``."""
    c = F.col
    label = T.strip(F.lower("label"))
    keys = [RUN, "src", "dst", "_label"]
    said = again.select(RUN, "src", "dst", label.alias("_label")).where("_label is not null").distinct()
    named = edges.withColumn("_label", label)
    first = named.groupBy(*keys).agg(F.min(order).alias(order)).join(said, keys, "left_semi").select(*keys, order, F.lit(True).alias("_hit"))
    out = named.join(first, [*keys, order], "left").withColumn("current", F.coalesce("_hit", F.lit(False)))
    out = out.withColumn("visibility", F.when(c("current"), F.least(F.lit(most), c("visibility") + 1)).otherwise(c("visibility")))
    return out.withColumn("active", c("active") | c("current")).drop("_label", "_hit")


def activation_scores(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """AGG-41: (run_id, src, dst, label, score, parts): the last edge's visibility by ends and label (3 parts), and by ends alone (2)."""
    last = lambda keys: edges.groupBy(RUN, *keys).agg(F.max_by("visibility", order).cast("int").alias("score"))
    three = last(["src", "dst", "label"]).withColumn("parts", F.lit(3))
    two = last(["src", "dst"]).withColumns({"label": F.lit(None).cast("string"), "parts": F.lit(2)})
    return three.select(RUN, "src", "dst", "label", "score", "parts").unionByName(two.select(RUN, "src", "dst", "label", "score", "parts"))


def can_connect(edges: DataFrame, required: DataFrame) -> DataFrame:
    """GRA-17: (run_id, possible): whether the edges, live or not, join all required nodes."""
    parts = components(edges, RUN).join(required.select(RUN, "node").distinct(), [RUN, "node"])
    return parts.groupBy(RUN).agg((F.count_distinct("component") <= 1).alias("possible"))


def stabilized(edges: DataFrame) -> DataFrame:
    """GRA-19: in runs without a live edge, visible edges wake."""
    alive = edges.where("active").select(RUN).distinct().withColumn("_alive", F.lit(True))
    out = edges.join(alive, RUN, "left")
    return out.withColumn("active", F.col("active") | (F.col("_alive").isNull() & (F.col("visibility") > 0))).drop("_alive")


def forced_edges(edges: DataFrame, label: Callable[[Column, Column], Column]) -> DataFrame:
    """GRA-23, GRA-27, GRA-29: per run, an edge from the least node of every live part but the largest to the
    largest part's node of most live edges; ``label`` gives its label from both ends."""
    live = edges.where("active").select(RUN, "src", "dst")
    parts = components(live, RUN)
    sizes = parts.groupBy(RUN, "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy(RUN).agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("component"))
    degree = live.select(RUN, F.explode(F.array("src", "dst")).alias("node")).groupBy(RUN, "node").agg(F.count("*").alias("d"))
    anchor = parts.join(largest, [RUN, "component"]).join(degree, [RUN, "node"]).groupBy(RUN).agg(
        F.first("component").alias("_main"), F.min_by("node", F.struct(-F.col("d"), "node")).alias("dst")
    )
    rest = sizes.join(anchor, RUN).where("component <> _main").select(RUN, F.col("component").alias("src"), "dst")
    return rest.withColumn("label", label(F.col("src"), F.col("dst")))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA-26, GRA-28: nodes that no edge ends in."""
    return nodes.join(endpoints(edges), [RUN, "node"], "left_anti")


def around(edges: DataFrame, anchors: DataFrame, hops: int = 2) -> DataFrame:
    """GRA-37: edges among the nodes within some hops of the anchors."""
    near = distances(edges, anchors, hops).select(RUN, "node")
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(near.select(RUN, F.col("node").alias(end)), [RUN, end], "left_semi")
    return kept


# fixed values: the layout's first ring and step, room of a node, and how far parallel edges bend and spread
RING, STEP, ROOM, SLACK = 4, 4.5, 1.8, 1.5
BEND, MOST_BEND = 0.15, 0.35


def radial_layout(levels: DataFrame) -> DataFrame:
    """GRA-38: x and y of (run_id, node, distance): rings around the hub, names in order."""
    c = F.col
    ring = Window.partitionBy(RUN, "distance")
    i, n = F.row_number().over(ring.orderBy("node")) - 1, F.count("*").over(ring)
    golden = math.pi * (3 - math.sqrt(5))
    radius = F.greatest(RING + STEP * c("distance"), n * ROOM * SLACK / (2 * math.pi))
    angle = 2 * math.pi * i / n + golden * c("distance")
    at = lambda f: F.when(c("distance") == 0, F.lit(0.0)).otherwise(radius * f(angle))
    return levels.select(RUN, "node", "distance", at(F.cos).alias("x"), at(F.sin).alias("y"))


def curvatures(edges: DataFrame, order: str | Column = "edge_id") -> DataFrame:
    """GRA-40: curvature and label place of edges that share their ends; those against the names' order bend the other way."""
    pair = Window.partitionBy(RUN, F.least("src", "dst"), F.greatest("src", "dst"))
    k, n = F.row_number().over(pair.orderBy(order)) - 1, F.count("*").over(pair)
    share = F.when(n > 1, k / (n - 1)).otherwise(0.5)
    spread = F.least(F.lit(MOST_BEND), BEND * (n - 1) / 2)
    bend = F.when(n == 1, 0.0).when(n == 2, F.when(k == 0, BEND).otherwise(-BEND)).otherwise(-spread + 2 * spread * share)
    low, high = F.greatest(F.lit(0.3), 0.5 - BEND * (n - 1) / 2), F.least(F.lit(0.7), 0.5 + BEND * (n - 1) / 2)
    place = F.when(n == 1, 0.5).when(n == 2, F.when(k == 0, 0.4).otherwise(0.6)).otherwise(low + (high - low) * share)
    return edges.withColumn("curvature", F.when(F.col("src") > F.col("dst"), -bend).otherwise(bend)).withColumn("t", place)


def bezier(x0: Column, y0: Column, x1: Column, y1: Column, curvature: Column, t: Column) -> tuple[Column, Column]:
    """GRA-41: the point at ``t`` of a curve bent to the side by ``curvature`` of its length."""
    mx, my = (x0 + x1) / 2 - curvature * (y1 - y0), (y0 + y1) / 2 + curvature * (x1 - x0)
    at = lambda a, m, b: (1 - t) * (1 - t) * a + 2 * (1 - t) * t * m + t * t * b
    return at(x0, mx, x1), at(y0, my, y1)


def label_angle(x0: Column, y0: Column, x1: Column, y1: Column, curvature: Column, t: Column) -> Column:
    """GRA-42: degrees of the curve's direction at ``t``, turned so that text is readable."""
    mx, my = (x0 + x1) / 2 - curvature * (y1 - y0), (y0 + y1) / 2 + curvature * (x1 - x0)
    angle = F.degrees(F.atan2((1 - t) * (my - y0) + t * (y1 - my), (1 - t) * (mx - x0) + t * (x1 - mx)))
    return F.when((x0 == x1) & (y0 == y1), 0.0).when(angle > 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)


def bfs_levels(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """GRA-4: (run_id, node, distance) along the edges' direction, as far as it goes."""
    t = Tables(edges.sparkSession)
    steps = t.write("steps", edges.select(RUN, F.col("src").alias("node"), F.col("dst").alias("near")).distinct())
    found = t.write("found", hubs.select(RUN, "node").distinct().withColumn("distance", F.lit(0)))
    front, k = found, 0
    while not front.isEmpty():
        k += 1
        ahead = front.join(steps, [RUN, "node"]).select(RUN, F.col("near").alias("node")).distinct()
        front = t.write(f"front{k % 2}", ahead.join(found, [RUN, "node"], "left_anti").withColumn("distance", F.lit(k)))
        found = t.write("found", found.unionByName(front))
    return found


def by_score(nodes: DataFrame, most: int, text_only: bool = False) -> DataFrame:
    """GRA-7: nodes (…, score, source) up to a score."""
    kept = nodes.where(F.col("score") <= most)
    return kept.where("source = 'TEXT_BASED'") if text_only else kept


def node_scores(nodes: DataFrame, edges: DataFrame, critical: DataFrame | None = None) -> DataFrame:
    """WIN-13: additive score of (run_id, node, source, active): active degree, kind, ties to the text, activity, centrality;
    infinite for ``critical`` nodes (run_id, node), as ``cut_points`` gives them."""
    c = F.col
    ends = edges.where("active").select(RUN, F.explode(F.array(F.struct(c("src").alias("node"), c("dst").alias("near")), F.struct(c("dst").alias("node"), c("src").alias("near")))).alias("e"))
    ends = ends.select(RUN, "e.*").join(nodes.select(RUN, c("node").alias("near"), (c("source") == "TEXT_BASED").alias("text")), [RUN, "near"], "left")
    degree = ends.groupBy(RUN, "node").agg(F.count("*").alias("n"), F.max(F.coalesce("text", F.lit(False)).cast("int")).alias("tied"), F.count_distinct("near").alias("d"))
    size = degree.groupBy(RUN).agg(F.count("*").alias("size"))
    joined = nodes.join(degree, [RUN, "node"], "left").join(size, RUN, "left").na.fill(0, ["n", "tied", "d"])
    inferred = c("source") == "INFERENCE_BASED"
    score = 3 * c("n") + F.when(inferred, 20).otherwise(5) + F.when(inferred & (c("tied") == 1), 15).otherwise(0) + F.when(c("active"), 8).otherwise(0)
    out = joined.select(RUN, "node", "source", "active", (score + F.when(c("size") > 1, 5 * c("d") / (c("size") - 1)).otherwise(0.0)).alias("score"))
    if critical is None:
        return out
    marked = out.join(critical.select(RUN, "node").distinct().withColumn("_cut", F.lit(True)), [RUN, "node"], "left")
    return marked.withColumn("score", F.when(c("_cut"), F.lit(float("inf"))).otherwise(c("score"))).drop("_cut")


def removal_candidates(scores: DataFrame, most: int) -> DataFrame:
    """WIN-12: what exceeds ``most`` nodes of a run, text-based nodes first, lowest scores first."""
    w = Window.partitionBy(RUN)
    rank = F.row_number().over(w.orderBy((F.col("source") != "TEXT_BASED").cast("int"), "score", "node"))
    return scores.withColumn("_i", rank).withColumn("_n", F.count("*").over(w)).where(F.col("_i") <= F.col("_n") - most).drop("_i", "_n")


def by_degree(edges: DataFrame) -> DataFrame:
    """WIN-11: (run_id, node, degree, place) by falling degree and name."""
    degree = edges.select(RUN, F.explode(F.array("src", "dst")).alias("node")).groupBy(RUN, "node").agg(F.count("*").alias("degree"))
    return degree.withColumn("place", F.row_number().over(Window.partitionBy(RUN).orderBy(F.desc("degree"), "node")))


def node_listing(nodes: DataFrame) -> DataFrame:
    """WIN-8: a run's nodes (node, kind, score) as lines, by score and name."""
    line = F.format_string("- %s (type: %s) (score: %d)", "node", "kind", F.col("score").cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("score", "node", line.alias("line"))))
    return nodes.groupBy(RUN).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("nodes"))


def edge_listing(edges: DataFrame, only_active: bool = True, order: str = "edge_id") -> DataFrame:
    """WIN-9: a run's edges as numbered lines; the number is the place in the list."""
    kept = edges.where("active") if only_active else edges
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, "src", "label", "dst"))), lambda r, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), r["src"], F.lit(" - "), r["label"], F.lit(" (edge) - "), r["dst"]))
    return kept.groupBy(RUN).agg(F.array_join(rows, "\n").alias("edges"))


def representers(mentions: DataFrame) -> DataFrame:
    """WIN-10: the commonest text of (run_id, node, text, seen); of equal ones the first seen, without articles."""
    counts = mentions.groupBy(RUN, "node", "text").agg(F.count("*").alias("n"), F.min("seen").alias("first"))
    best = counts.groupBy(RUN, "node").agg(F.min_by("text", F.struct(-F.col("n"), "first", "text")).alias("text"))
    return best.withColumn("text", F.regexp_replace("text", r"(?i)^((the|a|an)\s+)+", ""))


def newly_inferred(now: DataFrame, before: DataFrame) -> DataFrame:
    """WIN-15: inferred nodes that weren't there before."""
    return now.where("source = 'INFERENCE_BASED'").join(before.select(RUN, "node"), [RUN, "node"], "left_anti")


def shown_triplets(triplets: DataFrame, nodes: DataFrame) -> DataFrame:
    """STR-31: triplets whose ends are both among ``nodes``."""
    for end in ("subject", "object"):
        triplets = triplets.join(nodes.select(RUN, F.col("node").alias(end)), [RUN, end], "left_semi")
    return triplets


def replay(snapshots: DataFrame, positions: DataFrame) -> DataFrame:
    """STR-32: rows of snapshots (run_id, sentence, node), last sentence first, at the final positions."""
    w = Window.partitionBy(RUN).orderBy(F.desc("sentence"), "node")
    return snapshots.join(positions, [RUN, "node"]).withColumn("step", F.row_number().over(w))


def snapshots(triplets: DataFrame) -> DataFrame:
    """SRC-24: one row per (run_id, sentence_index): its triplets and the nodes they end in, in order."""
    triple = F.struct("subject", "relation", "object")
    both = F.array_union(F.collect_set("subject"), F.collect_set("object"))
    return triplets.groupBy(RUN, "sentence_index").agg(F.array_sort(F.collect_set(triple)).alias("triplets"), F.array_sort(both).alias("nodes"))


def parted_nodes(before: Column, now: Column) -> tuple[Column, Column, Column]:
    """SET-2, SET-4 over arrays of nodes: those that left, those that came, those that stayed."""
    return F.array_except(before, now), F.array_except(now, before), F.array_intersect(before, now)


def cut_points(edges: DataFrame) -> DataFrame:
    """GRA-32, GRA-33: (run_id, node) of nodes whose loss parts a run's graph.

    A run's graph is small; runs are spread over the cluster.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        links: dict[str, set[str]] = {}
        for a, b in zip(rows["src"], rows["dst"]):
            if a != b:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
        found, seen, low = set(), {}, {}
        for root in sorted(links):
            if root in seen:
                continue
            seen[root] = low[root] = len(seen)
            stack, children = [(root, None, iter(sorted(links[root])))], 0
            while stack:
                node, parent, rest = stack[-1]
                for other in rest:
                    if other not in seen:
                        seen[other] = low[other] = len(seen)
                        children += node == root
                        stack.append((other, node, iter(sorted(links[other]))))
                        break
                    if other != parent:
                        low[node] = min(low[node], seen[other])
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[node])
                        if parent != root and low[node] >= seen[parent]:
                            found.add(parent)
            if children > 1:
                found.add(root)
        # one row more and cut off again, so that columns without rows have a type
        return pd.DataFrame({RUN: [key[0]] * (len(found) + 1), "node": [*sorted(found), ""]}).iloc[:-1]

    kind = edges.schema[RUN].dataType.simpleString()
    return active(edges, -1).select(RUN, "src", "dst").groupBy(RUN).applyInPandas(run, f"{RUN} {kind}, node string")


def nudged(positions: DataFrame, threshold: float = 0.97, by: float = 0.15) -> DataFrame:
    """GRA-39: moves the farther of two nodes that lie in one line with the centre aside, once each, in order of names."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        at = {n: (x, y) for n, x, y in zip(rows["node"], rows["x"], rows["y"])}
        moved: set[str] = set()
        names = [n for n in at if math.hypot(*at[n]) >= 1e-6]
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                (ax, ay), (bx, by_) = at[a], at[b]
                la, lb = math.hypot(ax, ay), math.hypot(bx, by_)
                far = b if lb >= la else a
                if abs((ax * bx + ay * by_) / (la * lb)) >= threshold and far not in moved:
                    x, y = at[far]
                    at[far] = x - y * by, y + x * by
                    moved.add(far)
        return rows.assign(x=[at[n][0] for n in rows["node"]], y=[at[n][1] for n in rows["node"]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in positions.schema)
    return positions.groupBy(RUN).applyInPandas(run, schema)


def first_introductions(triplets: DataFrame) -> DataFrame:
    """GRA-13: the first sentence of each (run_id, subject, relation, object)."""
    return triplets.groupBy(RUN, "subject", "relation", "object").agg(F.min("sentence_index").alias("introduced_at"))


def upto(triplets: DataFrame, sentence: int) -> DataFrame:
    """WIN-16: triplets made by a sentence, or at no known one."""
    return triplets.where(F.col("introduced_at").isNull() | (F.col("introduced_at") <= sentence))


def semantic_triplets(edges: DataFrame, only_active: bool = True) -> DataFrame:
    """STR-30: (subject, relation, object) of labelled edges between different nodes."""
    kept = edges.where("src <> dst and label is not null and trim(label) <> ''")
    kept = kept.where("active") if only_active else kept
    return kept.select(RUN, F.col("src").alias("subject"), F.col("label").alias("relation"), F.col("dst").alias("object"))


def decayed(edges: DataFrame, at: Column, start: int = 2, step: int = 1) -> DataFrame:
    """STR-7 in closed form: visibility at a sentence, from the last one that touched the edge."""
    left = F.greatest(F.lit(0), F.lit(start) - step * F.greatest(F.lit(0), at - F.col("touched_at")))
    return edges.withColumn("visibility", left).withColumn("active", left > 0)


def activations(levels: DataFrame) -> DataFrame:
    """STR-18: landscape score of (…, raw) distances."""
    return levels.withColumn("score", T.landscape(F.col("raw")))


def landscape_matrix(records: DataFrame, sentences: list[int]) -> DataFrame:
    """AGG-36: token by sentence, mean scores, 0.0 where there is none, highest rows first."""
    wide = records.groupBy("token").pivot("sentence", sentences).agg(F.avg("score")).na.fill(0.0)
    names = [str(s) for s in sentences]
    total = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))
    top = F.greatest(*[F.col(f"`{n}`") for n in names]) if len(names) > 1 else F.col(f"`{names[0]}`")
    return wide.orderBy(top.desc(), total.desc(), "token")


def inactive_sets(views: DataFrame) -> DataFrame:
    """WIN-14, WIN-22: per (run_id, sentence): nodes that left since the sentence before, and all that
    were active once and aren't now; ``views`` is (run_id, sentence, node).

    Node by node: an appearance's next one tells when the node is gone, so no set of a run is held.
    """
    c = F.col
    w = Window.partitionBy(RUN, "node").orderBy("sentence")
    spans = views.distinct().withColumn("next", F.lead("sentence").over(w))
    ends = views.groupBy(RUN).agg(F.min("sentence").alias("lo"), F.max("sentence").alias("hi"))
    until = F.coalesce(c("next"), c("hi") + 1) - 1
    gone = spans.join(ends, RUN).where(until > c("sentence")).select(RUN, "node", "sentence", F.explode(F.sequence(c("sentence") + 1, until)).alias("at"))
    return gone.groupBy(RUN, c("at").alias("sentence")).agg(
        F.array_sort(F.collect_set(F.when(c("at") == c("sentence") + 1, c("node")))).alias("left_now"), F.array_sort(F.collect_set("node")).alias("inactive")
    )
