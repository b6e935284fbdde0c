"""Tables that grow by batches, each visible as a whole or not at all.

A batch has a folder of its own, `<path>/batch=<id>`, and an entry in the manifest
`<path>.batches`, which is written behind its files. Readers take the folders of the
manifest only, so what a stopped job left behind is never read, nor looked at.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def has_files(spark: SparkSession, path) -> bool:
    """Whether `path` exists; Spark looks that up when a frame over it is made."""
    try:
        spark.read.format("binaryFile").load(str(path))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


class Batches:
    """A table of batches at `path`; `fmt` is the format of its files."""

    def __init__(self, spark: SparkSession, path, fmt="parquet"):
        self._spark, self._fmt = spark, fmt
        self._base = str(path).rstrip("/")
        self._manifest = f"{self._base}.batches"

    def closed(self) -> list:
        """Names of all finished batches: as many as there were calls of `write`, however large these were."""
        if not has_files(self._spark, self._manifest):
            return []
        rows = self._spark.read.schema("batch string").json(self._manifest)
        return sorted(r.batch for r in rows.where("batch is not null").distinct().collect())

    def write(self, df: DataFrame, partition_by=()) -> str:
        """Adds the rows of `df` as one batch and returns its name."""
        batch = uuid.uuid4().hex
        self.store(df, batch, partition_by)
        self.close(batch)
        return batch

    def store(self, df: DataFrame, batch: str, partition_by=()) -> None:
        """Writes the files of a batch; it is no part of the table until it is closed."""
        df.write.partitionBy(*partition_by).format(self._fmt).save(f"{self._base}/batch={batch}")

    def close(self, batch: str) -> None:
        """Enters a batch in the manifest."""
        entry = self._spark.createDataFrame([(batch,)], "batch string").coalesce(1)
        entry.write.mode("append").json(self._manifest)

    def read(self, schema, batches=None) -> DataFrame:
        """Rows of all finished batches, or of some of them; none: no rows."""
        names = self.closed() if batches is None else batches
        if not names:
            return self._spark.createDataFrame([], schema)
        folders = [f"{self._base}/batch={b}" for b in names]
        found = self._spark.read.schema(schema).option("basePath", self._base).format(self._fmt).load(folders)
        return found.select(*[F.col(f"`{n}`") for n in self._spark.createDataFrame([], schema).columns])
