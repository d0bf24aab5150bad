"""A Spark data source for tab-separated knowledge-graph records, plain or zipped.

    register(spark)
    spark.read.format("gkg").option("path", "/data/raw").option("glob", "*.gkg.csv.zip").load()
    spark.read.format("gkg").option("paths", json.dumps([...])).load()   # in this order, repeats allowed
    spark.readStream.format("gkg").option("path", ...).load()

Each file is one partition. Rows carry the file's name, its place in the list
and the row's place in the file, which decide between duplicates later.
Options: path and glob, or paths; columns, a JSON list of the fields to read.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import os
import sys
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewatch.schemas import GKG_FIELDS, RECORDS


def find_inputs(folder: str, pattern: str = "*") -> list[str]:
    """Files of a folder that match, sorted; an error if there is no folder or no file."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    found = sorted(os.path.join(folder, x) for x in os.listdir(folder) if fnmatch.fnmatch(x, pattern) and os.path.isfile(os.path.join(folder, x)))
    if not found:
        raise FileNotFoundError(f"no file matches {pattern} in {folder}")
    return found


def _opened(path: str) -> tuple[io.TextIOBase, list]:
    as_text = {"encoding": "utf-8", "errors": "replace", "newline": ""}
    if not path.lower().endswith(".zip"):
        return open(path, **as_text), []
    archive = zipfile.ZipFile(path)
    member = next((x for x in archive.namelist() if x.lower().endswith((".csv", ".tsv"))), None)
    if member is None:
        archive.close()
        raise ValueError(f"no CSV or TSV member in {path}")
    return io.TextIOWrapper(archive.open(member), **as_text), [archive]


def read_records(path: str) -> Iterator[dict[str, str]]:
    """Records of one file. The first row is a header if it names the id and the document, else a record like any other."""
    csv.field_size_limit(min(sys.maxsize, 2**31 - 1))
    stream, more = _opened(path)
    try:
        names = None
        for row in csv.reader(stream, delimiter="\t"):
            if names is None:
                names = row if {"GKGRECORDID", "V2DOCUMENTIDENTIFIER"} <= set(row) else GKG_FIELDS
                if names is row:
                    continue
            elif not any(row):
                continue
            yield dict(zip(names, row))  # noqa: B905  short rows lack fields, long ones lose some
    finally:
        for x in (stream, *more):
            x.close()


class FilePartition(InputPartition):
    def __init__(self, path: str, place: int):
        self.path, self.place = path, place


def _rows(partition: FilePartition, schema: T.StructType) -> Iterator[tuple]:
    name = os.path.basename(partition.path)
    for k, record in enumerate(read_records(partition.path)):
        own = {"_source_file": name, "_file_ord": partition.place, "_row_ord": k}
        yield tuple(own.get(f, record.get(f)) for f in schema.names)


class GkgReader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: list[str]):
        self.schema, self.paths = schema, paths

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p, k) for k, p in enumerate(self.paths)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return _rows(partition, self.schema)


class GkgStreamReader(DataSourceStreamReader):
    """An offset is the last file by time of arrival and name, whatever their number; a file that arrives late under an early name has a later time. Executors read the files."""

    def __init__(self, schema: T.StructType, folder: str, pattern: str):
        self.schema, self.folder, self.pattern = schema, folder, pattern

    def _files(self) -> list[tuple[int, str]]:
        with os.scandir(self.folder) as entries:
            return sorted((x.stat().st_ctime_ns, x.name) for x in entries if fnmatch.fnmatch(x.name, self.pattern) and x.is_file())

    def initialOffset(self) -> dict:
        return {"at": 0, "name": ""}

    def latestOffset(self) -> dict:
        at, name = max(self._files(), default=(0, ""))
        return {"at": at, "name": name}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        new = sorted(name for at, name in self._files() if (start["at"], start["name"]) < (at, name) <= (end["at"], end["name"]))
        return [FilePartition(os.path.join(self.folder, name), k) for k, name in enumerate(new)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return _rows(partition, self.schema)

    def commit(self, end: dict) -> None:
        pass


class GkgSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gkg"

    def schema(self) -> T.StructType:
        wanted = json.loads(self.options.get("columns", "null"))
        return RECORDS if wanted is None else T.StructType([f for f in RECORDS.fields if f.name in wanted or f.name.startswith("_")])

    def _paths(self) -> list[str]:
        if "paths" in self.options:
            paths = json.loads(self.options["paths"])
            for p in paths:
                if not os.path.exists(p):
                    raise FileNotFoundError(p)
        else:
            path = self.options["path"]
            paths = [path] if os.path.isfile(path) else find_inputs(path, self.options.get("glob", "*"))
        if not paths:
            raise ValueError("at least one input file is needed")
        return paths

    def reader(self, schema: T.StructType) -> GkgReader:
        return GkgReader(schema, self._paths())

    def streamReader(self, schema: T.StructType) -> GkgStreamReader:
        return GkgStreamReader(schema, self.options["path"], self.options.get("glob", "*"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GkgSource)


def read_gkg(spark: SparkSession, paths: list[str] | str, pattern: str = "*"):
    register(spark)
    reader = spark.read.format("gkg")
    if isinstance(paths, str):
        return reader.option("path", paths).option("glob", pattern).load()
    if not paths:
        raise ValueError("at least one input file is needed")
    return reader.option("paths", json.dumps(list(paths))).load()
