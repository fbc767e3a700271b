"""The story reader over a stream: one state per run, sentences in order.

A sentence that comes early waits in the state until those before it have come; one that was
read already is left out, so a source that repeats rows does no harm.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fabulagraph.plans.story import SCHEMA, Reader, State

_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, expected, waiting = pickle.loads(held.get[0]) if held.exists else (State(), None, {})
    reader = Reader(key[0], state=state)
    for rows in batches:
        waiting.update({int(i): t for i, t in zip(rows["sentence_index"], rows["text"])})
    if expected is None and waiting:
        expected = 0  # a run begins at sentence 0
    out: list[tuple] = []
    while expected in waiting:
        out += reader.read(waiting.pop(expected) or "")
        expected += 1
    waiting = {i: t for i, t in waiting.items() if expected is None or i >= expected}
    held.update((pickle.dumps((reader.s, expected, waiting)),))
    frame = pd.DataFrame(out, columns=_NAMES).astype({"introduced_at": "Int32", "active": "boolean", "score": "float64"})
    yield frame


def read_stream(sentences: DataFrame) -> DataFrame:
    """Rows of kinds ``sentence`` and ``activation`` as sentences (run_id, sentence_index, text) arrive."""
    return sentences.groupBy("run_id").applyInPandasWithState(_step, SCHEMA, "state binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: watermarked counts and sums of events by type and tumbling window."""
    return (
        events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("event_type", F.col("w.start").alias("hour"), "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: session windows by user."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )
