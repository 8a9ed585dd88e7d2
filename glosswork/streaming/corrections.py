"""Streams of corrections and refreshed catalogues; every one has a batch twin that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from glosswork.streaming.views import INPUT, Stage, Views

RECORD = "seq long, ts string, unit_id long, step_no int, field string, new_value string"
FIELDS = ("title", "label")
KEYS = ["unit_id", "step_no"]


def judged(records: DataFrame, steps: DataFrame) -> DataFrame:
    """Every record with applied and message: all four fields are needed, the field listed, and unit and step present."""
    asked = steps.select(*KEYS).join(records.select("unit_id").distinct(), "unit_id", "left_semi")  # of few units, so that the rest is not shuffled
    units = asked.select("unit_id").distinct().withColumn("_unit", F.lit(True))
    known = asked.withColumn("_step", F.lit(True))
    j = records.join(units, "unit_id", "left").join(known, KEYS, "left")
    missing = F.col("unit_id").isNull() | F.col("step_no").isNull() | F.col("field").isNull() | F.col("new_value").isNull()
    message = (
        F.when(missing, "missing field").when(~F.col("field").isin(*FIELDS), "unknown field")
        .when(F.col("_unit").isNull(), "no such unit").when(F.col("_step").isNull(), "no such step").otherwise("ok")
    )
    return j.select(*records.columns, message.alias("message")).withColumn("applied", F.col("message") == "ok")


def latest(log: DataFrame) -> DataFrame:
    """The last applied value of every unit, step and field."""
    w = Window.partitionBy(*KEYS, "field").orderBy(F.desc("ts"), F.desc("seq"))
    return log.where("applied").withColumn("k", F.row_number().over(w)).where("k = 1").select(*KEYS, "field", "new_value")


def snapshot(steps: DataFrame, log: DataFrame) -> DataFrame:
    """Steps with their last applied corrections."""
    last = latest(log).groupBy(*KEYS).agg(*[F.max(F.when(F.col("field") == f, F.col("new_value"))).alias(f"_{f}") for f in FIELDS])
    return steps.join(last, KEYS, "left").select(*KEYS, *[F.coalesce(f"_{f}", f).alias(f) for f in FIELDS])


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Handle all files there are now, in micro-batches, and stop; a later call goes on where this one ended."""
    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def correction_stream(spark: SparkSession, source: str, steps: DataFrame, log_path: str, checkpoint: str, files_per_batch: int = 4) -> DataFrame:
    """Log every correction that arrives below ``source`` with its outcome; returns the log.

    Each micro-batch overwrites its own part of the log, named by the batch's number, so a batch that is run again
    after a failure changes nothing.
    """
    records = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).json(source)

    def each(batch: DataFrame, number: int) -> None:
        judged(batch, steps).write.mode("overwrite").parquet(f"{log_path}/batch={number}")

    run_available(records, each, checkpoint)
    return spark.read.parquet(log_path).drop("batch")


def recent_corrections(log: DataFrame, n: int = 10) -> DataFrame:
    """The n newest corrections, with the number of all."""
    total = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(n).withColumn("total", total)


def one_view(spark: SparkSession, key: str, refresh: Callable[[DataFrame], DataFrame], target: str) -> Views:
    """A single derived table at ``target``; ``refresh`` keeps the key column."""
    return Views(spark, target, key, [Stage("table", (INPUT,), lambda tables: refresh(tables[INPUT]))])


def refreshed_table(spark: SparkSession, source: str, schema: str, key: str, refresh: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataFrame:
    """Bring a derived table up to date with the files below ``source`` that have arrived since the last call; returns it.

    The rows of the keys that arrived are computed again from all their input, which is kept in buckets by key; the
    others stay as they are.
    """
    views = one_view(spark, key, refresh, target)
    run_available(spark.readStream.schema(schema).json(source), views.apply, checkpoint)
    return views.table("table")


def refresh_periodically(spark: SparkSession, source: str, schema: str, views: Views, checkpoint: str, every: str = "90 seconds") -> StreamingQuery:
    """A running query that looks for new files ``every`` so often and brings all views up to date with them."""
    stream = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(views.apply)
    return stream.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def resume_stage(pending: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], target: str) -> DataFrame:
    """Run ``work`` on the rows whose key is not in the table at ``target`` yet and append the results; returns the table."""
    spark = pending.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        pending = pending.join(spark.read.parquet(target).select(key).distinct(), key, "left_anti")
    work(pending).write.mode("append").parquet(target)
    return spark.read.parquet(target)
