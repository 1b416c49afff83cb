"""What the corpus operators share: tables, Arrow batch bounds and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes of an Arrow batch.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

#: Java and RE2 spelling of a word between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name. The path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds the rows and bytes of each Arrow batch, and so the memory of Python workers. The session keeps these settings."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of this process's own only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext.getCheckpointDir()
    return found


def row_key(*columns: str) -> Column:
    """128 bits of a row's columns; nulls differ from empty ones."""
    said = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\0", *map(said, columns)).cast("binary")))


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until the frame has no such column."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive executors and are read back with fresh statistics.

    drop() removes those that no returned frame reads any more; the others stay for the folder's own clean-up.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.held: set[str] = set()

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").parquet(path)
        self.held.add(name)
        return self.spark.read.schema(frame.schema).parquet(path)

    def add(self, frame: DataFrame, name: str) -> None:
        """Adds the frame's rows to a table, which read() gives."""
        frame.write.mode("append").parquet(f"{self.root}/{name}")
        self.held.add(name)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.held.discard(name)

    def drop_all_but(self, *names: str) -> None:
        """Removes what the frame that an operator returns does not read; it reads the tables named."""
        for name in self.held - set(names):
            self.drop(name)


def lower_ascii(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
