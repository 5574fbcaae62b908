"""What every operator needs of the cluster: shipped code, a shared folder, tables by name."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Narrow rows that a task takes for one file. For every file, its folder and its checksum Hadoop starts a chmod, where it has no native
#: library; so a table made of few rows isn't spread over as many files as a shuffle has partitions.
FILE_ROWS = 20_000


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_pipehat_shipped", None) == sc.applicationId:
        return
    files = sorted(p for p in PACKAGE.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    target = os.path.join(tempfile.mkdtemp(prefix="pipehat-"), f"pipehat-{digest}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(target)
    sc._pipehat_shipped = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session makes one of its own; on a
    cluster it has to be set."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not getattr(sc, "_pipehat_shared", None):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc._pipehat_shared = "file://" + tempfile.mkdtemp(prefix="pipehat-shared-")
        sc.setCheckpointDir(sc._pipehat_shared)
    return sc._pipehat_shared


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared one; nothing is made yet."""
    return f"{shared_dir(spark)}/pipehat/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again. `.path` tells where. rows: how many narrow rows the
    last step to df reads at most, if that is known; it then has a task for each core, or for each FILE_ROWS, but no more than before."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM for a path in any store that Spark reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str | None) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for path in paths:
        if path:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
