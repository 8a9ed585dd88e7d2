"""Live views of running jobs: the newest messages of each run, kept by run, with a clock that ends a finished run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glosswork.streaming.corrections import run_available
from glosswork.streaming.views import INPUT, Views

LOG = "run_id bigint, seq bigint, ts timestamp, msg string"
TAIL = "run_id bigint, live boolean, last_ts timestamp, last_msg string, seqs array<bigint>, msgs array<string>"


@dataclass(frozen=True)
class Tails:
    """What ``follow_tails`` keeps of a stream of messages (run_id, seq, ts, msg); see ``live_tails``."""

    log: DataFrame
    keep: int
    quiet_seconds: int
    done: str
    lateness: str


def live_tails(log: DataFrame, keep: int = 200, quiet_seconds: int = 30, done: str = "purchase", lateness: str = "1 hour") -> Tails:
    """The tails (run_id, live, last_ts, last_msg, seqs, msgs) of a stream of messages (run_id, seq, ts, msg).

    A run has its newest ``keep`` messages, newest first, whatever the order of arrival. Once the watermark, which is
    ``lateness`` behind the newest message of all, is more than ``quiet_seconds`` past the last message of a run that is
    ``done``, live is false; a run that comes back later starts a new tail. Late messages count like others.
    """
    return Tails(log, keep, quiet_seconds, done, lateness)


def follow_tails(tails: Tails, root: str, checkpoint: str) -> DataFrame:
    """Bring the view of the tail of every run below ``root`` up to date with the stream; returns it.

    The view is the state: a micro-batch merges its own newest messages with the stored ones of the runs that it names.
    ``due`` is the last millisecond of the watermark at which a finished run is live; ``newest`` is a run's newest moment
    ever, so that the watermark, of all of them, never goes back.
    """
    spark = tails.log.sparkSession
    view = Views(spark, root, "run_id", [], identity=("run_id",), version="batch")
    sorted_tail = lambda c: F.slice(F.sort_array(c, False), 1, tails.keep)

    def watermark(stored: DataFrame | None) -> int | None:
        return None if stored is None else stored.agg(F.unix_millis(F.max("newest") - F.expr(f"interval '{tails.lateness}'"))).first()[0]

    def each(batch: DataFrame, number: int) -> None:
        if number <= view.committed():
            return
        stored = view.table(INPUT)
        clock = watermark(stored)
        order = Window.partitionBy("run_id").orderBy(F.desc("ts"), F.desc("seq"))
        last = batch.where("run_id is not null").withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= tails.keep)
        rows = last.groupBy("run_id").agg(F.max("ts").alias("newest"), sorted_tail(F.collect_list(F.struct("ts", "seq", "msg"))).alias("tail"))
        if stored is not None:
            live = F.coalesce(F.col("due") >= F.lit(clock), F.lit(True))
            before = stored.select("run_id", F.col("newest").alias("_newest"), F.when(live, F.col("tail")).alias("_tail"))
            merged = F.when(F.col("_tail").isNull(), F.col("tail")).otherwise(sorted_tail(F.concat("tail", "_tail")))
            rows = rows.join(before, "run_id", "left").select("run_id", F.greatest("newest", "_newest").alias("newest"), merged.alias("tail"))
        top = F.col("tail")[0]
        due = 1000 * (F.floor(F.unix_millis(top["ts"]) / 1000) + tails.quiet_seconds + 1) - 1
        due = F.when(top["msg"] == tails.done, due if clock is None else F.greatest(due, F.lit(clock + 1)))
        view.apply(rows.withColumns({"due": due, "batch": F.lit(number)}), number)

    run_available(tails.log, each, checkpoint)
    stored = view.table(INPUT)
    if stored is None:
        return spark.createDataFrame([], TAIL)
    live = F.coalesce(F.col("due") >= F.lit(watermark(stored)), F.lit(True))
    top = F.col("tail")[0]
    return stored.select("run_id", live.alias("live"), top["ts"].alias("last_ts"), top["msg"].alias("last_msg"), F.col("tail.seq").alias("seqs"), F.col("tail.msg").alias("msgs"))


def recent_with_total(spark: SparkSession, records: DataFrame, root: str, checkpoint: str, n: int = 10) -> DataFrame:
    """The n newest records of a stream (ts, seq, ...) with the running total of all, kept up to date below ``root``.

    A micro-batch merges its own n newest with those of the batch before it, so it reads 2 n rows whatever came before.
    Each batch writes a version of its own number; one that is run again starts from the same predecessor.
    """
    view = Views(spark, root, "slot", [], identity=("slot",), version="total", buckets=1)

    def each(batch: DataFrame, number: int) -> None:
        if number <= view.committed():
            return
        stored = view.table(INPUT)
        before = 0 if stored is None else stored.agg(F.max("total")).first()[0]
        newest = lambda df: df.orderBy(F.desc("ts"), F.desc("seq")).limit(n)
        rows = newest(batch)
        if stored is not None:
            rows = newest(rows.unionByName(stored.select(F.inline("records"))))
        total = before + batch.count()
        if total > before:
            view.apply(rows.agg(F.lit(0).alias("slot"), F.lit(total).cast("bigint").alias("total"), F.collect_list(F.struct(*batch.columns)).alias("records")), number)

    run_available(records, each, checkpoint)
    found = view.table(INPUT)
    return found.select(F.inline("records"), "total") if found is not None else spark.createDataFrame([], records.schema.add("total", "bigint"))


def usage_ledger(calls: DataFrame, root: str, checkpoint: str, sums: tuple[str, ...] = ("seconds", "input_tokens", "output_tokens")) -> DataFrame:
    """Totals per user_id, pass and day of a stream of calls (user_id, pass, ts and the summed columns), kept below ``root``.

    A micro-batch adds its own totals to those of the users that it names, and the sums are committed under its number:
    a batch that is run again adds nothing. Calls without a pass are unknown; those without a user are left out.
    """
    groups = ["user_id", "pass", "day"]
    view = Views(calls.sparkSession, root, "user_id", [], identity=tuple(groups), version="batch")

    def each(batch: DataFrame, number: int) -> None:
        if number <= view.committed():
            return
        named = batch.where("user_id is not null").withColumns({"pass": F.coalesce("pass", F.lit("unknown")), "day": F.to_date("ts"), "calls": F.lit(1).cast("bigint")})
        added = named.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in (*sums, "calls")])
        stored = view.table(INPUT)
        if stored is not None:
            earlier = stored.join(named.select("user_id").distinct(), "user_id", "left_semi").select(added.columns)
            added = added.unionByName(earlier).groupBy(*groups).agg(*[F.sum(c).alias(c) for c in (*sums, "calls")])
        view.apply(added.withColumn("batch", F.lit(number)), number)

    run_available(calls, each, checkpoint)
    return view.table(INPUT).drop("batch")
