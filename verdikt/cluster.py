"""Getting this package to executors, and the folder that they share with the driver."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once an application: their Python workers import it by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="verdikt-"))  # Spark's file server hands it to executors
    atexit.register(shutil.rmtree, folder, True)
    archive = folder / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir).

    Only a local master may do without that setting: its tasks all see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _local:
            own = tempfile.TemporaryDirectory(prefix="verdikt-")
            atexit.register(own.cleanup)
            _local[key] = own.name
        root = _local[key]
    return f"{root.rstrip('/')}/verdikt-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads that.

    Unlike a cache it outlives executors, and what stands above never runs twice.
    """
    path = shared_dir(df.sparkSession)
    out = df.write
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int = 250_000) -> DataFrame:
    """df dealt by keys over so many partitions that each has about ``rows`` rows, whatever there are:
    what a task holds of them does not grow with the input. df is counted first, so write it before."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def beside(rows: DataFrame, one_each: DataFrame, key: str | list[str], how: str = "inner", most: int = 100_000) -> DataFrame:
    """rows joined with a written table of a row a key. It travels to the rows if it is counted at ``most``
    rows or fewer, so a key that many rows have is not one task; else Spark splits what is skewed."""
    return rows.join(F.broadcast(one_each) if one_each.limit(most + 1).count() <= most else one_each, key, how)
