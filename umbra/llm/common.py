"""What the operators of this folder share: reading, cutting lineage, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows hold whole texts, and a worker holds two batches of them and what it makes of one.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python of ``BATCH_BYTES`` at most (or one row), where the session has Spark's own, far larger bound."""
    if spark.conf.get(BATCH, None) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than the cluster has cores, as a single small file is, is dealt out first."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder. Where it is unset, a temporary one, but only if all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later stages survive lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, root)``, root the smallest node reachable.

    Alternating large-star and small-star steps; each is one pre-aggregated shuffle, the edge list does not
    grow, and only its size and sum reach the driver. An empty edge list gives no rows.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node, and the node itself, point at the node's smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: smaller neighbours of a node, and the node, point at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum("b"), F.countDistinct("a")).first()
        if now == before and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
