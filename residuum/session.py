"""Session settings and the few cluster-facing helpers every module shares."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Everything here is a runtime SQL setting, so it can be applied to a session
#: somebody else created (a notebook, a job server) as well as to our own.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when the aggregate after it then needs
    # one more exchange: a hot grid cell costs far more than that exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Catalyst takes compressed Parquet for its size in memory and would broadcast staged relations of up to
    # 300 times that; larger ones are left to adaptive execution, which knows the bytes shuffled.
    "spark.sql.sources.fileCompressionFactor": "300.0",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, so that Arrow functions can be loaded there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/residuum", "zip", root.parent, root.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "residuum", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="residuum-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def stage(df: DataFrame) -> DataFrame:
    """Write a relation to the shared folder and read it back.

    For relations that several branches or rounds read. Later plans start from a
    columnar scan with a known size: nothing is recomputed per branch, plans stay
    small however often the relation is joined, and a lost executor costs a re-read.
    """
    if getattr(df, "_staged", False):
        return df
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = True
    return out


def merged(df: DataFrame) -> DataFrame:
    """Join this relation by sorted merge, never by sending it through the driver.

    For relations that grow with the input but look small to Catalyst: it takes a column of compressed
    Parquet for its bytes in memory, and exploded rows for no more than their source.
    """
    return df.hint("merge")


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Rows by the hash of ``key`` over all shuffle partitions.

    Adaptive execution merges partitions by their compressed bytes, and ids that follow each other compress so
    well that one task would sort all of them; it leaves partitions alone whose number is given.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Below this many input bytes per core, work that is heavy per row is spread explicitly.
NARROW_BYTES = 8 << 20


def widened(df: DataFrame) -> DataFrame:
    """Spread the rows of a small input before work that is heavy per row.

    A large input already has more splits than cores and passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) < cores * NARROW_BYTES else df


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of two single-row relations next to each other."""
    return one.selectExpr("*", "1 AS _row").join(other.selectExpr("*", "1 AS _row"), "_row").drop("_row")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate for a plan, of files as they are stored; no job is run."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(int(str(stats.sizeInBytes())) / float(df.sparkSession.conf.get("spark.sql.sources.fileCompressionFactor")))
