"""Cutting lineage by written tables in the folder that all machines share.

Iterative plans (region merging, components, tree descents) write each round as
Parquet and read it back: a lost executor then costs a re-read, not a re-run of
all rounds, and the planner sees real sizes again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


#: Folders of tables written inside each open ``scratch``, innermost last.
_SCRATCH: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` and ``Rounds`` write inside is deleted at its end, shuffle files too: write or collect all results before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)
        # Spark deletes the shuffle files of finished jobs once the driver's heap has let go of their plans.
        spark._jvm.java.lang.System.gc()


def _fresh(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/mosaiq-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


#: Bytes that Spark may plan to broadcast while tables are written here.
BROADCAST = 2 << 20


@contextmanager
def sized(spark: SparkSession) -> Iterator[None]:
    """Inside, a join side is broadcast only if its planned size is at most ``BROADCAST`` (or what the session allows, if less).

    Spark plans with the sizes of files, which are packed; a row of a broadcast takes some ten times as much of the driver's heap.
    """
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, allowed = spark.conf.get(name), spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if allowed > BROADCAST:
        spark.conf.set(name, str(BROADCAST))
    try:
        yield
    finally:
        if allowed > BROADCAST:
            spark.conf.set(name, before)


def unsized(df: DataFrame) -> DataFrame:
    """``df`` so that joins don't broadcast it: rows of ``explode`` or ``mapInArrow`` are planned as if there were one for each row read."""
    return df.hint("merge")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; it stays until ``scratch`` or the user deletes it."""
    path = _fresh(df.sparkSession)
    with sized(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written as by ``materialize``; what ``make`` wrote on the way is deleted."""
    path = _fresh(spark)
    with scratch(spark):
        made = make()
        with sized(spark):
            made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


class Rounds:
    """Written tables of an iterative plan; those older than ``keep`` rounds are deleted."""

    def __init__(self, spark: SparkSession, keep: int = 2):
        self.spark, self.keep, self.paths = spark, keep, []
        self.base = _fresh(spark)

    def cut(self, *frames: DataFrame) -> list[DataFrame]:
        """Write the frames of one round; return them read back."""
        made = [f"{self.base}/{len(self.paths)}-{k}" for k in range(len(frames))]
        with sized(self.spark):
            for df, path in zip(frames, made):
                df.write.parquet(path)
        out = [self.spark.read.schema(df.schema).parquet(path) for df, path in zip(frames, made)]
        self.paths.append(made)
        if len(self.paths) > self.keep:
            for path in self.paths[-self.keep - 1]:
                _delete(self.spark, path)
        return out
