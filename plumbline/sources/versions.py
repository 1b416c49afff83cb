"""Versioned tables: each write goes to a folder of its own, and one small file a version says which folders count.

A version's file is written aside and renamed to its number without overwriting, the compare-and-set of the file system:
of two writers that start from one version, one gets the next number and the other is told. Readers follow the newest
number; between any two steps of a write they see the tables of the version before, whole. A writer that dies leaves a
folder that no version names; clean() removes such folders.

The rename refuses an existing target in one step on HDFS; on a local disk two processes could pass its test at once.

Defined cases: version 0 has no tables. Tables that a write does not name stay as they are. An empty table is a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another writer published first, or the source of a plan has changed."""


class Versions:
    """Tables by name below a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.conf)

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _text(self, *parts: str) -> str:
        stream = self._fs().open(self._path(*parts))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return max((int(n) for n in self._names("versions") if n.isdigit()), default=0)

    def tables(self, version: int | None = None) -> dict[str, dict]:
        """folder and schema of each table of a version."""
        n = self.version() if version is None else version
        return json.loads(self._text("versions", f"{n:012}")) if n else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the newest, or of a certain, version; what is read stays that version's."""
        held = self.tables(version)[name]
        return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(f"{self.root}/data/{held['folder']}/{name}")

    def stage(self, tables: dict[str, DataFrame]) -> dict[str, dict]:
        """Writes tables to a folder that no version names yet."""
        folder = uuid.uuid4().hex
        for name, frame in tables.items():
            frame.write.parquet(f"{self.root}/data/{folder}/{name}")
        return {name: {"folder": folder, "schema": frame.schema.jsonValue()} for name, frame in tables.items()}

    def commit(self, staged: dict[str, dict], after: int) -> int:
        """Makes staged tables the version after a certain one; ConflictError if there is one already."""
        said = json.dumps(self.tables(after) | staged)
        aside, target = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{after + 1:012}")
        stream = self._fs().create(aside, False)
        try:
            stream.write(bytearray(said.encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(aside, target, options)
        except Exception as error:
            self._fs().delete(aside, False)
            if self._fs().exists(target):
                raise ConflictError(f"version {after + 1} was published by another writer") from error
            raise
        return after + 1

    def publish(self, tables: dict[str, DataFrame], *, after: int | None = None, check: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> int:
        """Stages, checks and commits. check gets the staged tables and those that stay, and gives rows that say what is wrong."""
        base = self.version() if after is None else after
        staged = self.stage(tables)
        try:
            if check is not None:
                held = self.tables(base) | staged
                whole = {n: self.spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{self.root}/data/{t['folder']}/{n}") for n, t in held.items()}
                if faults := [tuple(r) for r in check(whole).limit(5).collect()]:
                    raise ValueError(f"not published: {faults}")
            return self.commit(staged, base)
        except Exception:
            for folder in {t["folder"] for t in staged.values()}:
                self._fs().delete(self._path("data", folder), True)
            raise

    def apply(self, plan: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], source: dict[str, str], *, check=None) -> int:
        """Publishes what a plan makes of the tables, if these still have the digests that the plan was made from."""
        base = self.version()
        now = {name: self.read(name, base) for name in self.tables(base)}
        changed = sorted(n for n, d in source.items() if n not in now or digest(now[n]) != d)
        if changed:
            raise ConflictError(f"source changed after the plan was made: {', '.join(changed)}")
        return self.publish(plan(now), after=base, check=check)

    def clean(self, keep: int = 2) -> list[str]:
        """Removes the folders that none of the last versions names, and says which; not to be called while another writes."""
        newest = self.version()
        named = {t["folder"] for n in range(max(1, newest - keep + 1), newest + 1) for t in self.tables(n).values()}
        gone = sorted(set(self._names("data")) - named)
        for folder in gone:
            self._fs().delete(self._path("data", folder), True)
        for n in self._names("versions"):
            if n.startswith(".") or (n.isdigit() and int(n) <= newest - keep):
                self._fs().delete(self._path("versions", n), False)
        return gone


def digest(table: DataFrame) -> str:
    """What a table holds, whatever the order of its rows: their number, and sum and exclusive or of their hashes."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"}))
    n, total, mixed = table.select(row.alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)), F.coalesce(F.bit_xor("h"), F.lit(0))).first()
    return f"{n:x}-{int(total):x}-{mixed & (2**64 - 1):016x}"
