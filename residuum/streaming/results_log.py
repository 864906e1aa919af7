"""The append-only results log as a stream: each stored attempt is scored once as it arrives.

The log is a folder of JSON lines. Rows are deduplicated by attempt over the whole log, so a restarted
writer that appends a row twice does not have it scored twice, and a row that comes late or is replayed
is still scored. :func:`score_log` holds no state: what is scored already is read from its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..plans import scoring
from ..sources.records import RESULT


def results_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(RESULT).option("maxFilesPerTrigger", max_files).option("mode", "FAILFAST").json(folder)


def first_arrivals(results: DataFrame) -> DataFrame:
    """One row per attempt, however late it arrives."""
    return results.dropDuplicates(["run_id", "render_id", "completion_index", "attempt"])


def score_stream(results: DataFrame, renders: DataFrame) -> DataFrame:
    """Join arriving results to the static renders and score them. Unknown renders are an error, not a loss."""
    known = renders.select("render_id", F.lit(True).alias("known"), *[c for c in renders.columns if c != "render_id"])
    joined = results.withColumnRenamed("raw_response", "response").withColumnRenamed("refusal", "provider_refusal").join(known, "render_id", "left").filter(
        "known OR raise_error(concat('response refers to an unknown render: ', coalesce(render_id, 'null')))").drop("known")
    for step in scoring.an.final_columns("response"):
        joined = joined.selectExpr(*step)
    return scoring.with_score(scoring.with_parsed(joined))


def start(scored: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows to a Parquet folder exactly once, for everything available now."""
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start()


ATTEMPT = ["run_id", "render_id", "completion_index", "attempt"]


def scored_before(spark: SparkSession, out: str, number: int) -> DataFrame:
    """Attempts that earlier micro-batches have scored; none before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], T.StructType([RESULT[c] for c in ATTEMPT]))
    return spark.read.parquet(out).filter(F.col("batch") < number).select(*ATTEMPT)


def score_log(results: DataFrame, renders: DataFrame, instances: DataFrame, out: str, checkpoint: str, fields: DataFrame | None = None) -> StreamingQuery:
    """Score every attempt of the log once, answers with several fields too, for everything available now.

    Each micro-batch drops attempts that it has twice or that are scored already, and writes its own folder ``batch=<n>``;
    a batch that is repeated after a failure overwrites what it had written. Unknown renders are an error, not a loss.
    """
    def score(rows: DataFrame, number: int) -> None:
        known = scored_before(rows.sparkSession, out, number)
        fresh = rows.dropDuplicates(ATTEMPT).join(known, ATTEMPT, "left_anti")
        scoring.score_run(fresh, renders, instances, fields, every_attempt=True).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return results.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
