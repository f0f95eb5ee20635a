"""Tables, shared storage and bounded collection.

Intermediate results that several plans read are written as Parquet below the folder named by
``spark.checkpoint.dir``, which every executor shares, so they survive the loss of executors and
cut the lineage. Only where that setting is absent and the master is local (tests) an own folder is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []


class TooLarge(ValueError):
    """A side that must stay small has more rows than its documented bound."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="leafwright-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/leafwright-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; no result read from it may be used after."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Run ``df`` once, keep it as a Parquet table in the shared folder and return the read table."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a side whose size is proven: at most ``limit`` rows, else ``TooLarge`` is raised."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"{what} has more than {limit} rows; raise the limit or join it as a table")
    return rows


def hinted(df: DataFrame, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unchanged (then Spark shuffles)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def require(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns. Further columns are ignored, even those whose names differ only in case."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    places = [df.columns.index(n) for n in names]
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{i}").alias(n) for i, n in zip(places, names, strict=True)])
