"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "vecspark", cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .getOrCreate()
    )


_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master: on a cluster
    executors do not share one, so an unset folder is an error there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id", "app")
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="vecspark-")
    return _local_scratch[app]


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_file(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False where there is one already."""
    files, at = _file_system(spark, path)
    return files.createNewFile(at)


def path_modified(spark: SparkSession, path: str) -> float:
    """When a file was last written, in seconds; now, if it is gone."""
    files, at = _file_system(spark, path)
    return files.getFileStatus(at).getModificationTime() / 1000 if files.exists(at) else time.time()


def remove_path(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def remove_matching(spark: SparkSession, pattern: str) -> None:
    files, at = _file_system(spark, pattern)
    for found in files.globStatus(at) or []:
        files.delete(found.getPath(), True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no such folder."""
    files, at = _file_system(spark, path)
    return [found.getPath().getName() for found in files.listStatus(at)] if files.exists(at) else []


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
