"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Setting under which a query deletes its shuffle files at its end (since Spark 4.1; earlier versions ignore it).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "sitegrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; a local session may make its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what runs inside as soon as it has ended."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df: DataFrame, lean: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Survives the loss of executors, and unlike an RDD checkpoint it keeps column pruning, filter pushdown and a known size, so
    a small result is joined by broadcast without a hint. ``lean`` saves disk in jobs of many steps: the files are packed tighter, and shuffle files
    of the write are deleted after it instead of when the driver's memory is next cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if lean:
        with _shuffles_dropped(spark):
            df.write.option("compression", "zstd").parquet(path)
    else:
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.settled_path = path
    return table


def bucketed(df: DataFrame, *keys: str, buckets: int | None = None) -> DataFrame:
    """The rows as a table bucketed by ``keys``, in the shared folder: joins and groupings on these keys, or on more, read it without a shuffle.

    Tables that meet must have as many buckets; by default that is the number of shuffle partitions. The session's catalog holds the table's
    name until ``forget``, so with a metastore of its own the user must be allowed to create tables.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write_buckets(df, name, path, n, keys, "errorifexists")
    return _bucketed_table(spark, name, path, n, keys)


def append(table: DataFrame, more: DataFrame, dealt: bool = False) -> DataFrame:
    """A table that ``bucketed`` made, with further rows in their buckets; ``more`` may be read from the table itself. Rows that are ``dealt``
    over as many partitions by the same keys aren't shuffled again."""
    path, name, n, keys = table.settled_path, table.settled_name, table.settled_buckets, table.settled_keys
    _write_buckets(more.select(*table.columns), name, path, n, keys, "append", dealt)
    return _bucketed_table(table.sparkSession, name, path, n, keys)


def _write_buckets(df: DataFrame, name: str, path: str, n: int, keys: tuple[str, ...], mode: str, dealt: bool = False) -> None:
    (df if dealt else df.repartition(n, *keys)).write.mode(mode).bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)


def _bucketed_table(spark: SparkSession, name: str, path: str, n: int, keys: tuple[str, ...]) -> DataFrame:
    table = spark.table(name)
    table.settled_path, table.settled_name, table.settled_buckets, table.settled_keys = path, name, n, keys
    return table


def forget(table: DataFrame) -> None:
    """Delete the files of a table ``cut_lineage`` wrote, once nothing reads it any more."""
    path, name = getattr(table, "settled_path", None), getattr(table, "settled_name", None)
    if name:
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        jvm = table.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def balanced(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores is dealt over all cores; a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
