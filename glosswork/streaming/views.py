"""Derived tables that follow their input: only changed keys pass on, and one pointer commits all tables of a batch.

Every table is kept in buckets by a hash of its key, each bucket in the version of the batch that wrote it last. A batch
reads and writes the buckets of its keys only. The pointer of a batch names the version of every bucket of every table;
readers follow the newest pointer, so they see the tables of one batch or of the one before, never a mixture.

An input that only grows, or whose rows are too large to be written again, is kept in parts instead: each batch adds the
rows that came, and a bucket is all its parts. Which rows are the newest is told by identities and versions, without the
other columns. A bucket is written as one part again when it has many of them, or more replaced rows than others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from glosswork.sources.scratch import fixed

INPUT = "input"
#: Columns that name a row of an input in parts: the batch it came with, and a number in that batch.
MARKS = ("_batch", "_row")
MOST_PARTS = 8
#: So many rows at most are left out of a batch by a copy of their numbers in every task.
MOST_SENT = 1_000_000
_MOMENT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


@dataclass(frozen=True)
class Stage:
    """A derived table: ``compute`` makes the rows of some keys from the rows of these keys in the tables it ``reads``.

    The tables are the input and earlier stages. Its rows must hold the key and depend on rows of their own key only.
    """

    name: str
    reads: tuple[str, ...]
    compute: Callable[[dict[str, DataFrame]], DataFrame]


class Views:
    """The input and the stages below a folder that the cluster shares.

    ``identity`` names the columns that make an input row: of equal ones the row of the highest ``version`` column stays.
    Without it all rows are kept. Rows without a key are left out.

    With ``in_parts``, and always without an identity, a batch's rows are added to the input and move through no shuffle;
    of equal versions the first to come stays. That is for large rows of which few are replaced: readers of the input
    sort out the replaced ones.
    """

    def __init__(
        self, spark: SparkSession, root: str, key: str, stages: list[Stage], identity: tuple[str, ...] = (), version: str = "", buckets: int = 64, in_parts: bool = False
    ):
        self.spark, self.root, self.key, self.stages = spark, root.rstrip("/"), key, stages
        self.identity, self.version, self.buckets = identity, version, buckets
        self.in_parts = in_parts or not identity

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, files = self._path(*parts)
        return [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []

    def committed(self) -> int:
        """The number of the newest batch that all tables have, -1 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names("pointers") if n.endswith(".json")), default=-1)

    def _pointer(self, number: int) -> dict:
        if number < 0:
            return {}
        path, files = self._path("pointers", f"{number}.json")
        with_text = self.spark._jvm.org.apache.commons.io.IOUtils
        opened = files.open(path)
        try:
            return json.loads(with_text.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def _commit(self, number: int, pointer: dict) -> None:
        draft, files = self._path("pointers", f"{number}.draft")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        if not files.rename(draft, self._path("pointers", f"{number}.json")[0]):
            raise RuntimeError(f"batch {number} is already committed")

    def _forget(self, number: int) -> None:
        """Delete the versions that only the pointers before ``number``'s predecessor name."""
        numbers = sorted(int(n.removesuffix(".json")) for n in self._names("pointers") if n.endswith(".json"))
        named = lambda n: {(t, b, k) for t, x in self._pointer(n).items() for k, parts in x["buckets"].items() for b in parts}
        kept = named(numbers[-1]).union(*map(named, numbers[-2:-1]))
        for old in numbers[:-2]:
            for table, batch, bucket in named(old) - kept:
                path, files = self._path("data", table, f"batch={batch}", f"bucket={bucket}")
                files.delete(path, True)
            path, files = self._path("pointers", f"{old}.json")
            files.delete(path, False)

    def _read(self, pointer: dict, table: str, buckets: set[str] | None = None) -> DataFrame | None:
        """The rows of some buckets, of an input in parts the replaced ones too; none of a table that has never been written."""
        if table not in pointer:
            return None
        schema = StructType.fromJson(pointer[table]["schema"])
        paths = [
            f"{self.root}/data/{table}/batch={batch}/bucket={k}"
            for k, parts in pointer[table]["buckets"].items() if buckets is None or k in buckets for batch in parts
        ]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame | None:
        """A stage's rows, or the input's, as of the newest pointer."""
        pointer = self._pointer(self.committed())
        if name == INPUT and self.in_parts and name in pointer:
            return self._newest(pointer, set(pointer[name]["buckets"])).drop(*MARKS)
        return self._read(pointer, name)

    def _in_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """The rows dealt by bucket, so that a write makes one file a bucket, not one for each task and bucket."""
        return self._in_bucket(rows).repartition("bucket")

    def _save(self, table: str, part: int | str, rows: DataFrame) -> list[str]:
        """Write rows that have their bucket; returns the buckets that they fill."""
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{table}/batch={part}", compression="zstd")
        return sorted(n.removeprefix("bucket=") for n in self._names("data", table, f"batch={part}") if n.startswith("bucket="))

    def _write(self, pointer: dict, table: str, number: int, rows: DataFrame, touched: set[str]) -> None:
        known = dict(pointer.get(table, {"buckets": {}})["buckets"])
        buckets = {k: parts for k, parts in known.items() if k not in touched} | {k: [number] for k in self._save(table, number, rows)}
        pointer[table] = {"schema": rows.drop("bucket").schema.jsonValue(), "buckets": buckets}

    def _told(self, pointer: dict, buckets: set[str]) -> DataFrame:
        """Bucket, key and marks of an input's rows, and whether each is the newest of its identity."""
        names = list(dict.fromkeys((self.key, *self.identity)))
        newest = Window.partitionBy(*names).orderBy(F.desc(self.version), *MARKS)
        rows = self._read(pointer, INPUT, buckets).select(*dict.fromkeys((*names, self.version, *MARKS)))
        return self._in_bucket(rows).select("bucket", self.key, *MARKS, (F.row_number().over(newest) == 1).alias("newest"))

    def _newest(self, pointer: dict, buckets: set[str]) -> DataFrame:
        """The rows of some buckets, with their marks, without those that are replaced."""
        mixed = {k for k in buckets if pointer[INPUT]["replaced"].get(k, [0])[0]}
        rows = self._read(pointer, INPUT, buckets - mixed)
        if not mixed:
            return rows
        gone = self._told(pointer, mixed).where("not newest").select(*MARKS)
        return rows.union(self._read(pointer, INPUT, mixed).join(gone, list(MARKS), "left_anti").select(rows.columns))

    def _add(self, pointer: dict, number: int, batch: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """Add a part with the batch's rows; returns the keys that it changes, and the newest rows of these keys."""
        rows = batch if INPUT not in pointer else batch.select([n for n in self._read(pointer, INPUT).columns if n not in MARKS])
        rows = self._in_bucket(rows.withColumns({"_batch": F.lit(number).cast("long"), "_row": F.monotonically_increasing_id()}))
        touched = self._save(INPUT, number, rows)  # the only pass over the batch
        if not touched:
            return None
        known = pointer.setdefault(INPUT, {"schema": rows.drop("bucket").schema.jsonValue(), "buckets": {}, "replaced": {}})
        full = {k for k, parts in known["buckets"].items() if len(parts) > MOST_PARTS or 2 * known["replaced"].get(k, [0, 0])[0] > known["replaced"].get(k, [0, 0])[1]}
        if full:
            whole = self._save(INPUT, f"{number}-whole", self._bucketed(self._newest(pointer, full)))
            known["buckets"] |= {k: [f"{number}-whole"] for k in whole}
            known["replaced"] = {k: x for k, x in known["replaced"].items() if k not in full}
        earlier = {k: list(known["buckets"].get(k, [])) for k in touched}
        known["buckets"] |= {k: [*earlier[k], number] for k in touched}
        part = {INPUT: known | {"buckets": {k: [number] for k in touched}}}
        if not self.identity:
            keys = fixed(self._read(part, INPUT).select(self.key).distinct(), "changed-keys")
            return keys, self._read(pointer, INPUT, set(touched)).drop(*MARKS).join(keys, self.key, "left_semi")
        told = fixed(self._told(pointer, set(touched)), "row-marks")
        came = F.col("_batch") == number
        counted = told.groupBy("bucket").agg(F.count_if(~F.col("newest")), F.count(F.lit(1)), F.count_if(~F.col("newest") & came)).collect()
        known["replaced"] |= {str(k): [gone, n] for k, gone, n, _ in counted}
        keys = fixed(told.where(F.col("newest") & came).select(self.key).distinct(), "changed-keys")
        late, new = sum(r[3] for r in counted), self._read(part, INPUT)
        if late:  # rows of the batch that are no newer than others
            gone = told.where(~F.col("newest") & came).select("_row")
            new = new.join(F.broadcast(gone) if late <= MOST_SENT else gone, "_row", "left_anti").select(new.columns)
        others = told.where(F.col("newest") & ~came).join(keys, self.key, "left_semi").select(*MARKS)
        if not others.isEmpty():  # earlier rows of the same keys, of other identities
            old = self._read({INPUT: known | {"buckets": earlier}}, INPUT)
            new = new.union(old.join(others, list(MARKS), "left_semi").select(new.columns))
        return keys, new.drop(*MARKS)

    def _buckets_of(self, keys: DataFrame) -> set[str]:
        found = keys.select(F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string")).distinct().collect()
        return {r[0] for r in found}

    def _changed(self, new: DataFrame, old: DataFrame | None, keys: DataFrame) -> DataFrame:
        """The keys, of ``keys``, whose rows differ; digests stand for the rows, so that these stay where they are."""
        written = F.to_json(F.struct(*new.columns), {"timestampFormat": _MOMENT, "timestampNTZFormat": _MOMENT.removesuffix("XXX")})
        digests = lambda df: df.select(self.key, F.sha2(written, 256).alias("digest")).join(keys, self.key, "left_semi")
        if old is None:
            return new.select(self.key).join(keys, self.key, "left_semi")
        new, old = digests(new), digests(old)
        return new.exceptAll(old).select(self.key).union(old.exceptAll(new).select(self.key))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take up one batch of input rows. A batch that is committed already changes nothing."""
        before = self.committed()
        if number <= before:
            return
        pointer = self._pointer(before)
        batch = batch.where(F.col(self.key).isNotNull())
        added = self._add(pointer, number, batch) if self.in_parts else self._replace(pointer, number, batch)
        if added is None:
            return
        changed, arrived = {INPUT: added[0]}, added[1]
        for stage in self.stages:
            changed[stage.name] = self._refresh(pointer, stage, number, changed, arrived)
        self._commit(number, pointer)
        self._forget(number)

    def _replace(self, pointer: dict, number: int, batch: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """Write the buckets of the batch's keys anew; returns as ``_add`` does."""
        batch = batch.persist()
        try:
            keys = batch.select(self.key)
            touched = self._buckets_of(keys)
            if not touched:
                return None
            stored = self._read(pointer, INPUT, touched)
            rows = batch if stored is None else stored.unionByName(batch.select(stored.columns))
            # in the partitions of the buckets, so that rows move once
            newest = Window.partitionBy("bucket", *self.identity).orderBy(F.desc(self.version))
            rows = self._bucketed(rows).withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
            self._write(pointer, INPUT, number, rows, touched)
            rows = self._read(pointer, INPUT, touched)
            if self.stages:
                keys = fixed(keys.distinct(), "changed-keys")
                keys = fixed(self._changed(rows, stored, keys).distinct(), "changed-keys")
            return keys, rows.join(keys, self.key, "left_semi")
        finally:
            batch.unpersist()

    def _refresh(self, pointer: dict, stage: Stage, number: int, changed: dict[str, DataFrame], arrived: DataFrame) -> DataFrame:
        """Compute a stage's rows of the keys that changed in what it reads; returns the keys of which they differ now.

        All changes begin in the input, so a stage that reads it is asked for all keys of ``arrived``, its rows of changed keys;
        what changed in other tables matters to the other stages only.
        """
        keys = changed[INPUT]
        if INPUT not in stage.reads:
            keys = changed[stage.reads[0]]
            for name in stage.reads[1:]:
                keys = keys.union(changed[name])
            keys = fixed(keys.distinct(), "changed-keys")
        touched = self._buckets_of(keys)
        if not touched:
            return keys
        read = lambda t: arrived if t == INPUT else self._read(pointer, t, touched).join(keys, self.key, "left_semi")
        made = stage.compute({t: read(t) for t in stage.reads})
        stored = self._read(pointer, stage.name, touched)
        rows = made if stored is None else made.unionByName(stored.join(keys, self.key, "left_anti"))
        self._write(pointer, stage.name, number, self._bucketed(rows), touched)
        differ = self._changed(self._read(pointer, stage.name, touched), stored, keys).distinct()
        return fixed(differ, "changed-keys") if any(INPUT not in s.reads and stage.name in s.reads for s in self.stages) else differ
