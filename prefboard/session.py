"""Session settings and the shared folder for written intermediate tables."""

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows a file of a table of numbers holds at least, where their number is known.
ROWS_PER_FILE = 1 << 16

#: For sessions within one machine that set no folder.
LOCAL_FOLDER = "file:/tmp/prefboard-shared"

#: Long texts: small Arrow batches keep the memory of executors and Python workers flat.
TEXT_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    TEXT_BATCHES[0]: TEXT_BATCHES[1],
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app="prefboard", master=None, **extra) -> SparkSession:
    """A session with the library's settings; `extra` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` of the session.

    A session without that setting, such as a test's, uses one fixed folder if it
    runs within one machine; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return LOCAL_FOLDER


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/prefboard/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name="stage", rows=None) -> DataFrame:
    """Write `df` once and read it back.

    Used behind caller-supplied model calls, which are costly and need not be
    repeatable: a lost executor re-reads the table and never repeats the calls.
    `rows` says how many there may be: the last step of `df` then runs in as many
    tasks as these need, one for each core at least, instead of one for every
    shuffle partition, each with a file of its own.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession):
    """What is written inside goes to Python in small batches, whatever the session's setting."""
    before = spark.conf.get(TEXT_BATCHES[0])
    spark.conf.set(*TEXT_BATCHES)
    try:
        yield
    finally:
        spark.conf.set(TEXT_BATCHES[0], before)


def spread(df: DataFrame, tasks=None) -> DataFrame:
    """Rows dealt evenly to `tasks` tasks, for a costly function behind it.

    Input splits are cut by bytes; a model call per row needs more and evener
    tasks than that. Without `tasks` nothing is moved.
    """
    return df.repartition(tasks) if tasks else df
