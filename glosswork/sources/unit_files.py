"""A data source of one document a unit: files named by collection, number and side, each written whole or not at all."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from glosswork.sources.analyses import PUBLISHED, UNIT_FILE, as_documents, judged_documents

FILES = "file string, value string"
# Parts of the names of side files that a catalogue passes over.
SIDE_FILES = (".review", ".bak", "preprompt", "lookupbug", "demo")


def unit_file(collection: Column, unit_no: Column, side: Column) -> Column:
    """The name of a unit's file; what a name cannot hold becomes an underscore, a missing side is a."""
    safe = F.regexp_replace(F.coalesce(collection, F.lit("_")), "[^A-Za-z_]", "_")
    return F.concat(safe, F.lit("_"), F.coalesce(unit_no, F.lit(0)).cast("string"), F.coalesce(side, F.lit("a")), F.lit(".json"))


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class SomeFiles(InputPartition):
    names: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class UnitFilesReader(DataSourceReader):
    """Files are chosen by their names, before any is opened: by the pattern and by ``names``."""

    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("filespertask", 256))
        self.pattern = options.get("pattern", UNIT_FILE)
        self.names = set(options["names"].split("/")) if options.get("names") else None

    def partitions(self) -> Sequence[InputPartition]:
        files, folder = _folder(self.path)
        found = (x for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.type == fs.FileType.File)
        names = sorted(x.base_name for x in found if re.search(self.pattern, x.base_name) and not any(s in x.base_name for s in SIDE_FILES))
        names = [n for n in names if self.names is None or n in self.names]
        return [SomeFiles(tuple(names[i : i + self.per_task])) for i in range(0, len(names), self.per_task)] or [SomeFiles(())]

    def read(self, partition: SomeFiles) -> Iterator[tuple]:
        files, folder = _folder(self.path)
        for name in partition.names:
            with files.open_input_file(f"{folder}/{name}") as f:
                yield name, f.read().decode("utf-8", "replace")


class UnitFilesWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the job; the driver moves their files into place when all have ended well."""

    def __init__(self, path: str):
        self.path, self.job = path, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = _folder(self.path)
        own, names = f"{self.job}/{uuid.uuid4().hex}", []
        files.create_dir(f"{folder}/{own}", recursive=True)
        for batch in iterator:
            for name, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                with files.open_output_stream(f"{folder}/{own}/{name}") as out:
                    out.write((value or "").encode())
                names.append(f"{own}/{name}")
        return Written(tuple(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _folder(self.path)
        drafts = [n for m in messages if m is not None for n in m.names]
        twice = [n for n, k in Counter(d.rpartition("/")[2] for d in drafts).items() if k > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several documents of one unit: {sorted(twice)[:5]}")
        for draft in drafts:
            files.move(f"{folder}/{draft}", f"{folder}/{draft.rpartition('/')[2]}")
        files.delete_dir(f"{folder}/{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _folder(self.path)
        if files.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.job}")


class UnitFiles(DataSource):
    """``format("unit_files")``: rows (file, value) of the files of one folder, which every machine can open."""

    @classmethod
    def name(cls) -> str:
        return "unit_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return UnitFilesReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> UnitFilesWriter:
        return UnitFilesWriter(self.options["path"])


def write_unit_files(analyses: DataFrame, path: str, keys: dict[str, str] = PUBLISHED) -> None:
    """One JSON document a unit, at ``unit_file`` of its collection, number and side; units that are there are replaced.

    If a task fails, or two rows are of one unit, no unit's file is written; a task that outlives its job may leave a
    draft folder ``_job-...``, which readers pass over.
    """
    analyses.sparkSession.dataSource.register(UnitFiles)
    named = analyses.select(unit_file(F.col("collection"), F.col("unitNo"), F.col("side")).alias("file"), *[F.col(c) for c in analyses.columns if c != "file"])
    as_documents(named, keys, carry=("file",)).write.format("unit_files").mode("append").save(path)


def read_unit_files(spark: SparkSession, path: str, names: list[str] | None = None, keys: dict[str, str] = PUBLISHED) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) analyses as ``read_analyses`` gives them; with ``names`` only these files are opened."""
    spark.dataSource.register(UnitFiles)
    reader = spark.read.format("unit_files")
    rows = (reader if names is None else reader.option("names", "/".join(names) or "/")).load(path)
    return judged_documents(rows, keys)
