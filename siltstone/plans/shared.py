"""Tables that outlive the executor that made them.

Iterative plans and plans that read one result several times write it to the folder
that all executors share and read it again, so that a lost executor costs one task and
not the whole lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all runs on this machine (tests), one of our own."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="siltstone-")
    return _OWN[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back (lineage ends here)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, least: int = 1 << 20, per_core: int = 32 << 20) -> DataFrame:
    """Deal a small input over all cores before work that costs more than reading it: its few row groups would keep
    few cores busy. An input of `per_core` bytes a core or more is read as it lies, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # by the row's place, which a second attempt of the task finds again: dealing in turns would sort all rows for that
    return df.repartition(cores, F.monotonically_increasing_id()) if least <= size < cores * per_core else df


@contextmanager
def open_writers(spark: SparkSession, folders: int) -> Iterator[None]:
    """Within it, a task that writes into at most so many folders keeps a file open in each and need not sort its rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(folders))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_shared(spark: SparkSession) -> None:
    """Delete what this application has materialized; results that read it must be done."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siltstone/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_bounds(spark: SparkSession, rows: int = 512, size: int = 32 << 20) -> None:
    """Small Arrow batches for this session, by rows and by bytes: a batch of very long texts must still fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
