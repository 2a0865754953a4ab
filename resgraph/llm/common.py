"""Helpers shared by the corpus operators: shared-folder tables, batch bounds, components."""

from __future__ import annotations

import atexit
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resgraph.session import shared_dir

#: ASCII white space: 0x20 and 0x09-0x0D; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
REPO = str(Path(__file__).resolve().parents[2])
FOLD_EDGES = 1_000_000
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers import this package, and keep Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/resgraph-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session has ended
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame | None) -> None:
    if df is not None and hasattr(df, "staged_path"):
        drop_path(df.sparkSession, df.staged_path)


def _forest(batches):
    """Union-find over one partition's edges, giving a star for each local component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x] = top
            x = p
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if (ra := find(a)) != (rb := find(b)):
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in list(parent) if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step (Kiveris et al., 2014) as a grouped minimum and a join."""
    if large:
        pairs = edges.union(edges.select("v", "u"))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = pairs.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        out = out.select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of an edge table (u long, v long); component is its smallest node.

    Tasks of FOLD_EDGES edges first fold them to spanning forests; where there are several, alternating star steps join
    the forests.
    Self loops and repeated edges are harmless; nodes without edges don't appear.
    """
    held = staged(edges.toDF("u", "v").where("u is not null and v is not null and u <> v"), "edges")
    parts = max(1, -(-held.count() // FOLD_EDGES))
    raw, held = held, staged(held.repartition(parts).mapInArrow(_forest, "u long, v long"), "forest")
    unstage(raw)
    if parts == 1:  # one fold has seen every edge
        tops = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
    before = None
    while True:
        small = staged(_star(_star(held, True), False), "stars")
        unstage(held)
        held = small
        sign = held.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or tuple(sign) == before:
            break
        before = tuple(sign)
    tops = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
