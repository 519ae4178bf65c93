"""Stage tables in the folder all executors share, so that a table several branches read is computed once and lost executors cost a re-read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme, as Spark resolves it: the default file system where it names none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made and set, for ``local`` masters only: on a cluster it would be each machine's own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cadenza-shared-"))
        place = spark.sparkContext.getCheckpointDir()
    return qualified(spark, place)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unique path in the shared folder, deleted when the driver exits at the latest."""
    path = f"{shared_dir(spark)}/cadenza-{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        discard(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def staged(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where it lies, for whoever can ``discard`` it early."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, label: str) -> DataFrame:
    return staged(df, label)[0]
