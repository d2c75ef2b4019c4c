"""Tables between runs: Parquet stores and checkpoints in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="binloom-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one step, written to the shared folder, each computed once, that go together when the step is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, last: bool = False) -> DataFrame:
        """The table written and read back; the last one of a step stays until the process ends."""
        path = f"{shared_dir(self.spark)}/binloom-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        if last:
            atexit.register(_remove, self.spark, path)
        else:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, shuffles: bool = False) -> None:
        """With `shuffles` also the files of shuffles that no table needs any more, which else wait for the driver's memory to
        be collected: for steps of many rounds."""
        for path in self.paths:
            _remove(self.spark, path)
        self.paths = []
        if shuffles:
            self.spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:  # a stopped session leaves its files to the folder's owner
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def save_dataset(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def has_tables(spark: SparkSession, path: str, names: list[str]) -> bool:
    """Whether all tables of a dataset are there, each written to its end."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = [jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.parquet/_SUCCESS") for name in names]
    return all(mark.getFileSystem(conf).exists(mark) for mark in marks)


def cached_dataset(spark: SparkSession, path: str, make: Callable[[], dict[str, DataFrame]], names: list[str]) -> dict[str, DataFrame]:
    """The tables of a dataset, made and saved if they are not all there yet."""
    if not has_tables(spark, path, names):
        save_dataset({name: df for name, df in make().items() if name in names}, path)
    return {name: load_table(spark, path, name) for name in names}


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")
