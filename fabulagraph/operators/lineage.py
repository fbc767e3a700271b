"""Cutting lineage in the shared folder, and connected components by contraction."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that a task contracts at once.
CONTRACTED = 1 << 18


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; of this machine only where that is unset and all executors are on it."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Tables written and read again, for loops: their sizes are those of their files, while a
    checkpoint keeps the plan's estimate, which joins multiply round by round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes the table ``name`` anew; the one of that name before it goes."""
        path = f"{folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    def drop(self, name: str) -> None:
        if old := self.paths.pop(name, None):
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _ranked(values: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order, and the place of each row's among them."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy(zero_copy_only=False)]


def contracted(rows: pa.Table) -> pa.Table:
    """(g, a, b) edges to (g, a, b): every node a of a group with the least node b that the edges join it with."""
    _, g = _ranked(rows["g"])
    names, ends = _ranked(pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks], rows["a"].type))
    keys, place = np.unique(np.concatenate([g, g]) * len(names) + ends, return_inverse=True)  # in the order of names within a group
    a, b = place[: len(g)], place[len(g) :]
    label = np.arange(len(keys))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    row = np.empty(len(keys), np.int64)
    row[place] = np.tile(np.arange(len(g)), 2)  # some row of each node's group
    take = lambda at: names.take(pa.array(keys[at] % len(names)))
    return pa.table({"g": rows["g"].take(pa.array(row)), "a": take(np.arange(len(keys))), "b": take(label)})


def _contract(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Contracts what a task has, ``most`` edges at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch.select(["g", "a", "b"]))
        if sum(x.num_rows for x in held) >= most:
            yield from contracted(pa.Table.from_batches(held)).to_batches()
            held = []
    if sum(x.num_rows for x in held):
        yield from contracted(pa.Table.from_batches(held)).to_batches()


def _contract_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From rows in the order of groups: labels, and whether the group has rows that were contracted apart."""
    held, size, last_open = [], 0, None

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        done = contracted(table)
        open_ = pc.fill_null(pc.equal(done["g"], last_open), False) if last_open is not None else pa.chunked_array([pa.array([False] * done.num_rows)])
        yield from done.append_column("open", open_).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch.select(["g", "a", "b"]))
        size += batch.num_rows
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        final = table["g"][-1]
        going_on = pc.equal(table["g"], final)
        before = table.filter(pc.invert(going_on))
        if before.num_rows:  # whole groups; the last one waits for its other rows
            yield from out(before)
            rest = table.filter(going_on)
        else:
            last_open = final
            yield from out(table)
            rest = table.slice(0, 0)
        held, size = rest.to_batches(), rest.num_rows
    if held:
        yield from out(pa.Table.from_batches(held))


def components(edges: DataFrame, group: str, src: str = "src", dst: str = "dst", most: int = CONTRACTED) -> DataFrame:
    """GRA-1: (group, node, component) for the nodes of ``edges``, by group; the component is its least node.

    Tasks contract the edges that they read, and then the edges of whole groups, ``most`` at a time.  Groups
    with more go through rounds over all executors.  Rows with a null group or end have no node.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    schema = f"g {kinds[group]}, a {kinds[src]}, b {kinds[src]}"
    rows = edges.select(F.col(group).alias("g"), F.col(src).alias("a"), F.col(dst).cast(kinds[src]).alias("b")).dropna()
    few = rows.mapInArrow(lambda x: _contract(x, most), schema).repartition("g").sortWithinPartitions("g")
    done = cut(few.mapInArrow(lambda x: _contract_groups(x, most), f"{schema}, open boolean"))
    named = lambda x: x.select(F.col("g").alias(group), F.col("a").alias("node"), F.col("b").alias("component"))
    large = done.where("open").select("g").distinct()
    if large.isEmpty():
        return named(done)
    rest = _rounds(done.join(large, "g", "left_semi").select(F.col("g").alias(group), F.col("a").alias("src"), F.col("b").alias("dst")), group)
    return named(done.join(large, "g", "left_anti")).unionByName(rest)


def _rounds(edges: DataFrame, group: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Components by contraction over all executors.

    A round points each node at its least neighbour, follows the pointers, and replaces the
    ends of edges; edges inside one node vanish.  Rounds are logarithmic in the longest path.
    """
    c = F.col
    t = Tables(edges.sparkSession)
    nodes = edges.select(group, F.explode(F.array(src, dst)).alias("node")).distinct()
    labels = t.write("labels", nodes.select(group, "node", c("node").alias("component")))
    tidy = lambda x: x.where("a <> b").select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = t.write("rest", tidy(edges.select(group, c(src).alias("a"), c(dst).alias("b"))))
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(group, c("b").alias("a"), c("a").alias("b")))
        up = both.groupBy(group, c("a").alias("node")).agg(F.min("b").alias("up")).withColumn("up", F.least("node", "up"))
        up = t.write("first", up)
        for _ in range(2):
            up = up.join(up.select(group, c("node").alias("up"), c("up").alias("next")), [group, "up"]).select(group, "node", c("next").alias("up"))
        up = t.write("up", up)
        to = up.select(group, c("node").alias("component"), "up")
        labels = t.write("labels", labels.join(to, [group, "component"], "left").select(group, "node", F.coalesce("up", "component").alias("component")))
        for end in ("a", "b"):
            rest = rest.join(up.select(group, c("node").alias(end), c("up").alias("to")), [group, end]).withColumn(end, c("to")).drop("to")
        rest = t.write("rest", tidy(rest))
    # pointers of pointers may still lie above the least node
    least = labels.groupBy(group, "component").agg(F.min("node").alias("least"))
    return labels.join(least, [group, "component"]).select(group, "node", c("least").alias("component"))
