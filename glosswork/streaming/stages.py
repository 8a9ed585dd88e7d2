"""Work in stages over windows of units, with a checkpoint after each: what a broken run leaves, and how the next goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glosswork.sources.scratch import fixed
from glosswork.streaming.views import INPUT, Views

# The stages in their order; only the last can be taken up again.
STAGES = ("segmented", "structured", "phrased", "linked", "polished")
DONE = "done"
Work = Callable[[DataFrame], DataFrame]


class StagedRun:
    """Runs ``stages``, (name, work) in order, over the rows of each window of ``key``; ``work`` keeps the key column.

    A window's rows after a stage are one row of that stage's table, as a window has few units, so a window is replaced
    as a whole. A window whose last stage was reached goes straight to the output; one that broke off earlier starts
    again; one with output is not touched.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, stages: list[tuple[str, Work]], buckets: int = 64):
        self.spark, self.root, self.key, self.stages = spark, root.rstrip("/"), key, stages
        view = lambda name: Views(spark, f"{self.root}/{name}", key, [], identity=(key,), version="attempt", buckets=buckets)
        self.tables = {name: view(name) for name in (*[n for n, _ in stages], "status", "output")}

    def _attempt(self) -> int:
        return 1 + max(v.committed() for v in self.tables.values())

    def _put(self, table: str, rows: DataFrame, attempt: int) -> None:
        self.tables[table].apply(rows.withColumn("attempt", F.lit(attempt)), attempt)

    def _keep(self, stage: str, rows: DataFrame, attempt: int) -> DataFrame:
        """Write the windows' rows, then their status; returns the rows as they were written."""
        whole = rows.groupBy(self.key).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
        self._put(stage, whole, attempt)
        self._put("status", rows.select(self.key).distinct().withColumn("stage", F.lit(stage)), attempt)
        return self._rows(stage).where(F.col("attempt") == attempt).select(F.inline("rows"))

    def _rows(self, table: str) -> DataFrame | None:
        return self.tables[table].table(INPUT)

    def output(self) -> DataFrame | None:
        """The rows of all windows that are complete."""
        found = self._rows("output")
        return None if found is None else found.select(F.inline("rows"))

    def run(self, pending: DataFrame, stop_after: str | None = None) -> None:
        """Bring the windows of ``pending`` to the output. ``stop_after`` breaks off when that stage is written, for tests."""
        done, status = self._rows("output"), self._rows("status")
        if done is not None:
            pending = pending.join(done.select(self.key), self.key, "left_anti")
        last = self.stages[-1][0]
        if status is not None:
            ready = status.where(F.col("stage") == last).select(self.key)
            ready = fixed(ready.join(pending, self.key, "left_semi"), "windows")
            if not ready.isEmpty():
                self._finish(self._rows(last).join(ready, self.key, "left_semi").select(F.inline("rows")))
                pending = pending.join(ready, self.key, "left_anti")
        rows = fixed(pending, "windows")
        if rows.isEmpty():
            return
        for name, work in self.stages:
            rows = self._keep(name, work(rows), self._attempt())
            if name == stop_after:
                return
        self._finish(rows)

    def _finish(self, rows: DataFrame) -> None:
        attempt = self._attempt()
        whole = rows.groupBy(self.key).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
        self._put("output", whole, attempt)
        self._put("status", whole.select(self.key, F.lit(DONE).alias("stage")), attempt)
