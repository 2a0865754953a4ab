"""Session helpers: tables in the shared folder that end the lineage of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a folder of our own only on one machine, where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = sc._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else ""
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="resgraph-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, *by: str) -> DataFrame:
    """df as a table written once to the shared folder, in folders by columns: later reads prune, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/resgraph-{uuid.uuid4().hex}"
    _made.append((spark, path))
    # shuffle files of the write go with its end, as nothing reads them again
    was = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.cut_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session has ended
            _delete(spark, path)
