"""SQLite files as a Spark data source, read and written by Python's own SQLite module.

The format's engine opens files by path, so each file must lie where all executors reach it by
the same path. Tables without a row number (WITHOUT ROWID) are read in one part.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Keys of one point query; SQLite takes some hundreds of parameters.
KEYS = 500


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def store_files(path: str) -> list[str]:
    """The files of a store: the file itself, or those of a folder."""
    return sorted(glob.glob(os.path.join(path, "*.db"))) if os.path.isdir(path) else [path]


@dataclass
class Rows(InputPartition):
    path: str
    first: int | None
    last: int | None


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self) -> list[Rows]:
        table, parts, out = quoted(self.options.get("table", "documents")), int(self.options.get("parts", "8")), []
        for path in store_files(self.options["path"]):
            with opened(path) as con:
                try:
                    lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(Rows(path, None, None))
                    continue
            if lo is not None:
                width = -(-(hi - lo + 1) // parts)
                out += [Rows(path, a, min(a + width - 1, hi)) for a in range(lo, hi + 1, width)]
        return out

    def read(self, part: Rows) -> Iterator[tuple]:
        columns = ", ".join(map(quoted, self.names))
        where = "" if part.first is None else f" WHERE rowid BETWEEN {part.first} AND {part.last}"
        with opened(part.path) as con:
            yield from con.execute(f"SELECT {columns} FROM {quoted(self.options.get('table', 'documents'))}{where}")


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceWriter):
    """A file for each task; all are given their names when every task is done."""

    def __init__(self, schema: StructType, options: dict):
        self.fields, self.options = [(f.name, f.dataType.typeName()) for f in schema], options
        if os.path.exists(options["path"]):
            raise FileExistsError(f"{options['path']} exists")

    def write(self, rows: Iterator) -> Written:
        kinds = {"string": "TEXT", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        key, table = self.options.get("key"), quoted(self.options.get("table", "documents"))
        columns = ", ".join(f"{quoted(n)} {kinds.get(t, 'INTEGER')}" + (" PRIMARY KEY" if n == key else "") for n, t in self.fields)
        folder = self.options["path"] + ".part"
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{uuid.uuid4().hex}.db")
        con = sqlite3.connect(path)
        with con:
            con.execute(f"CREATE TABLE {table} ({columns})")
            con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(self.fields))})", (tuple(r) for r in rows))
        con.close()
        return Written(path)

    def commit(self, messages: list) -> None:
        os.makedirs(self.options["path"])
        for m in messages:
            if m is not None:
                os.replace(m.path, os.path.join(self.options["path"], os.path.basename(m.path)))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        raise ValueError("name the columns by .schema(...)")

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options)


def read_store(spark: SparkSession, path: str, schema: str, table: str = "documents", parts: int = 8) -> DataFrame:
    """A table of an SQLite file, or of all files of a folder, read by ranges of its row number."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).options(path=path, table=table, parts=parts).load()


def write_store(df: DataFrame, path: str, table: str = "documents", key: str | None = None) -> None:
    """A table with its primary key in new SQLite files, one for each task; an existing store is left alone."""
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("sqlite").mode("append").options(path=path, table=table, **({"key": key} if key else {})).save()


def find(keys: DataFrame, path: str, schema: str, table: str = "documents", key: str = "title") -> DataFrame:
    """The rows of the keys by point queries on the primary key, null in the other columns where there is none."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = [opened(p) for p in store_files(path)]
        for b in batches:
            wanted = b.column(0).to_pylist()
            for i in range(0, len(wanted), KEYS):
                part, got = wanted[i : i + KEYS], {}
                marks = ", ".join("?" * len(part))
                for con in stores:
                    for row in con.execute(f"SELECT {', '.join(map(quoted, names))} FROM {quoted(table)} WHERE {quoted(key)} IN ({marks})", part):
                        got[row[names.index(key)]] = row
                rows = [got.get(k) or tuple(k if n == key else None for n in names) for k in part]
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=kinds)

    kinds = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}[c.strip().split(" ")[1]]) for n, c in zip(names, schema.split(","), strict=True)])
    return keys.select(key).distinct().mapInArrow(look, schema)
