"""Column helpers, scratch tables and sizes that the operators share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vecspark.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Java patterns of separators: white space of ASCII, and all of ASCII but digits and lower-case letters.
SPACES = "[\\x20\\x09-\\x0D]+"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text) -> Column:
    """A-Z lower-cased, every other character as it is."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def words(text, separators: str = SPACES) -> Column:
    """The words between separators; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


#: Shuffle files go when the job that needed them ends, so a chain of jobs takes the disk of its largest one.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """``df`` written to the shared scratch folder and read back, and where it lies."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.options(**{k.replace("__", "."): v for k, v in options.items()})
    with settings(df.sparkSession, {CLEAN_UP: "true"}):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str):
    """Deletes scratch tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Bounds what a Python worker holds: so many texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the jobs run inside; the session's own come back."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20):
    """Bounds the rows and bytes a Python worker is handed at once, for the jobs run inside."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
