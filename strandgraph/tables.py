"""Tables in the shared folder, to cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where the session names none and all executors are threads of the driver, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder; on a cluster it must name one that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="strandgraph-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


_made: set[str] = set()


def _drop(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new name below the application's own folder in the shared one, which goes when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/strandgraph/{spark.sparkContext.applicationId}"
    if folder not in _made:
        _made.add(folder)
        atexit.register(_drop, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: cuts the lineage and outlives a lost executor.

    The tables of an application stand in a folder of its own, which goes when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """`df` as a table of the shared folder, hashed into buckets by `key` and sorted: a join on the key shuffles its other side only."""
    spark = df.sparkSession
    path = scratch(spark)
    name = f"strandgraph_{path.rpartition('/')[2]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        spark.sql(f"DROP TABLE IF EXISTS {name}")
