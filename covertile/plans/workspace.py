"""Written tables that cut lineage between the rounds of an iterative operator.

Each round of an iterative operator is written as Parquet below the shared folder the cluster
names in ``spark.checkpoint.dir`` and read back. Compared with keeping the round in executor
storage this survives the loss of executors, and compared with ``checkpoint()`` it is columnar
and gives the planner the true size of every round, so that joins are chosen from real numbers.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rounds whose results are kept apart at most, before they are written together.
FOLD = 64

_local_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only for an unconfigured local session.

    A configured folder is taken as it is: a ``file:`` one may be a mount all executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    configured = sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = sc.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="covertile-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return "file://" + _local_roots[app]


class Workspace:
    """One folder per operator call, holding its stages by name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/covertile/{label}-{uuid.uuid4().hex}"
        self._written: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, split: str | None = None) -> DataFrame:
        """Materialise ``df`` and return a scan of the written files.

        ``split`` names a boolean column that becomes a directory, so that both halves can be
        read, and dropped, apart from each other (see :meth:`half`).
        """
        self._written.append(name)
        writer = df.write.option("compression", "snappy")
        if split:
            writer = writer.partitionBy(split)
        writer.parquet(self.path(name))
        return self.read(df.schema, name)

    def measured(
        self, df: DataFrame, name: str, split: str | None = None, **metrics: Column
    ) -> tuple[DataFrame, dict]:
        """Like :meth:`write`, with aggregates taken in the same pass.

        The metrics sit on top of the plan, in the writing tasks, and Spark adds those up once
        per finished partition, so a repeated task does not count twice.
        """
        seen = Observation()
        metrics = {"rows": F.count(F.lit(1)), **metrics}
        watched = df.observe(seen, *[m.alias(k) for k, m in metrics.items()])
        return self.write(watched, name, split), {k: v or 0 for k, v in seen.get.items()}

    def read(self, schema, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.path(n) for n in names])

    def half(self, schema, names: list[str], split: str, value: bool) -> DataFrame:
        """The rows of the named stages whose ``split`` column had ``value``.

        Name only stages that have such rows; without any the frame is empty.
        """
        kept = type(schema)([f for f in schema.fields if f.name != split])
        if not names:
            return self.spark.createDataFrame([], kept)
        return self.read(kept, *[f"{n}/{split}={str(value).lower()}" for n in names])

    def fold(self, schema, names: list[str], split: str, value: bool, name: str) -> list[str]:
        """Write the halves of many rounds as one stage, so that results read few folders.

        Returns the names that stand for ``names`` from now on.
        """
        if len(names) < FOLD:
            return names
        kept = self.half(schema, names, split, value)
        self.write(kept.withColumn(split, F.lit(value)).select(*schema.names), name, split)
        for n in names:
            self.drop(f"{n}/{split}={str(value).lower()}")
        return [name]

    def drop(self, name: str) -> None:
        """Delete a stage no later stage or result reads (through the session's JVM)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)

    def bytes(self, name: str) -> int:
        """Size of the files of a stage."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return path.getFileSystem(conf).getContentSummary(path).getLength()

    def finish(self, *kept: str) -> None:
        """Delete all stages but those the result reads."""
        for name in self._written:
            if name not in kept:
                self.drop(name)
        self._written = list(kept)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind, error, trace) -> None:
        """After a failure no result reads any stage."""
        if kind is not None:
            self.finish()
