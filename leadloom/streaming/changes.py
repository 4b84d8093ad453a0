"""Structured Streaming forms: windowed counts of events, and snapshot changes as runs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.operators.snapshots import snapshot_changes


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total: events by tumbling windows; events later than the watermark are dropped by the stream, a batch keeps all."""
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    return counted.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def follow_snapshots(arriving: DataFrame, runs_path: str, changes_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a log of changes up to date while snapshot rows arrive.

    Every micro-batch is appended under its number to the run table, and the
    changes of its runs, and of the runs right behind them (a late run changes what follows
    it), are computed from them and the runs before them alone and logged under the
    same number; a retried batch writes the same again. Each such run has a row
    without id too, so that a run whose changes vanish replaces its earlier ones.
    A run must arrive within one micro-batch, as its absences can't be seen otherwise.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        by_batch = lambda rows, path: rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        by_batch(batch, runs_path)
        stored = spark.read.parquet(runs_path).filter((F.col("batch") <= number) & (F.col("run_status") == "success"))
        in_order = Window.partitionBy("board_id").orderBy("run_seq")
        runs = stored.groupBy("board_id", "run_seq").agg((F.max("batch") == number).alias("new"))
        told = runs.withColumn("told", F.col("new") | F.coalesce(F.lag("new").over(in_order), F.lit(False)))
        needed = told.withColumn("before", F.coalesce(F.lead("told").over(in_order), F.lit(False))).filter("told or before")
        rows = stored.drop("batch").join(needed.select("board_id", "run_seq"), ["board_id", "run_seq"], "left_semi")
        runs_told = needed.filter("told").select("board_id", F.col("run_seq").cast("bigint").alias("run_seq"))
        changed = snapshot_changes(rows).join(runs_told, ["board_id", "run_seq"], "left_semi")
        by_batch(changed.unionByName(runs_told, allowMissingColumns=True), changes_path)

    return arriving.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_changes(spark: SparkSession, changes_path: str) -> DataFrame:
    """board_id, run_seq, id, change as of now: of every run those told last."""
    log = spark.read.parquet(changes_path)
    last = log.groupBy("board_id", "run_seq").agg(F.max("batch").alias("batch"))
    return log.join(last, ["board_id", "run_seq", "batch"], "left_semi").filter(F.col("change").isNotNull()).select("board_id", "run_seq", "id", "change")
