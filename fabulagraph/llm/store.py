"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, read from the session.

    A folder of this machine is taken only where none is named and all executors are on this machine, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder.  Its files stay until the folder is emptied, or until nothing refers
    to them if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; ``removed`` deletes its files."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.written_to = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes the files of what ``written`` gave, when nothing reads them any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(conf).delete(path, True)


#: Rows of a few numbers or short names that are sent to every executor at most (some 16 MB).
BROADCAST_ROWS = 1_000_000


def sent(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, computed once, and marked for broadcast if it has at most ``most`` rows."""
    df = checkpoint(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of texts that go to a Python worker at once: texts are long, and a worker holds a few copies of a batch.
TEXT_ROWS = 1024
TEXT_BYTES = 64 << 20


def map_texts(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` for rows that hold texts; the session's Arrow batches come down to ``TEXT_ROWS`` rows and
    ``TEXT_BYTES`` bytes, or one row that has more, if they are larger or have no bound."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        if not 0 < int(conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(function, schema)
