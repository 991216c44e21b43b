"""Relational files: a data source over SQLite files, read in ranges of row ids within a scope that their own queries
apply, and a writer that makes a file for each task.

The scope is an option, not a filter that Spark hands over: in 4.1 a Python source keeps the filters of one query for the
next one on the same DataFrame, which then lacks rows.
"""

from __future__ import annotations

import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Row ids of a split, rows handed on at once.
SPLIT, BATCH = 200_000, 10_000
#: Declared types by what they begin with, as the files' own rules read them.
KINDS = (("INT", "bigint"), ("BIGINT", "bigint"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"), ("BOOL", "boolean"))
#: What a scope may ask of a column, and how the files' queries say it; values are bound, never written out.
SIGNS = {
    **{sign: lambda c, _, sign=sign: f"{c} {sign} ?" for sign in ("<", "<=", ">", ">=")},
    "=": lambda c, v: f"{c} IS ?" if v is not None else f"{c} IS NULL",
    "!=": lambda c, v: f"{c} IS NOT ?" if v is not None else f"{c} IS NOT NULL",
    "in": lambda c, v: f"{c} IN ({', '.join('?' * len(v))})",
    "contains": lambda c, _: f"instr({c}, ?) > 0",
    "starts": lambda c, _: f"instr({c}, ?) = 1",
}


def local(path: str) -> str:
    """The path as the operating system names it. The files must be on a disk that all executors mount."""
    if "://" in path.removeprefix("file://"):
        raise ValueError(f"a relational file is opened by its library, which doesn't reach {path}")
    return path.removeprefix("file://").removeprefix("file:")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class Split(InputPartition):
    path: str
    low: int
    high: int

    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], name: str, split: int, scope: list[tuple[str, str, object]]):
        self.schema, self.paths, self.name, self.split = schema, paths, name, split
        self.where, self.values = [], []
        for column, sign, value in scope:
            column = quoted(self.schema[column].name)  # an unknown column is an error here, not in a task
            if sign not in SIGNS:
                raise ValueError(f"{sign} is none of {', '.join(SIGNS)}")
            self.where.append(SIGNS[sign](column, value))
            self.values += [] if value is None else value if isinstance(value, list) else [value]

    def partitions(self) -> list[Split]:
        out = []
        for path in self.paths:
            con = opened(path)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.name)}").fetchone()
            finally:
                con.close()
            out += [Split(path, a, min(a + self.split, high + 1)) for a in range(low, high + 1, self.split)] if low is not None else []
        return out

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        con = opened(partition.path)
        try:
            columns = ", ".join(quoted(f.name) for f in self.schema.fields)
            where = " AND ".join(["rowid >= ? AND rowid < ?", *self.where])
            found = con.execute(f"SELECT {columns} FROM {quoted(self.name)} WHERE {where}", [partition.low, partition.high, *self.values])
            while rows := found.fetchmany(BATCH):
                arrays = [pa.array([bool(v) if v is not None else None for v in c] if pa.types.is_boolean(f.type) else list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        finally:
            con.close()


class SqliteSource(DataSource):
    """Options: path (a file, or a folder of files with the same table), table, split (row ids of a split), and scope, a
    JSON list of (column, sign, value)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def paths(self) -> list[str]:
        path = local(self.options["path"])
        return sorted(glob(f"{path}/*.db")) if os.path.isdir(path) else [path]

    def schema(self) -> str:
        if not (paths := self.paths()):
            raise ValueError(f"no .db file in {self.options['path']}")
        con = opened(paths[0])
        try:
            columns = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        finally:
            con.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {paths[0]}")
        kind = lambda declared: next((k for start, k in KINDS if declared.upper().startswith(start)), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.paths(), self.options["table"], int(self.options.get("split", SPLIT)), json.loads(self.options.get("scope", "[]")))


def read_sqlite(spark: SparkSession, path: str, name: str, scope: list[tuple[str, str, object]] = (), split: int = SPLIT) -> DataFrame:
    """The rows of a table of SQLite files that are within the scope: all of its (column, sign, value), with the signs of
    SIGNS. ``=`` None asks for nulls. The files' library leaves the other rows out, by its indexes where it has some."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", name).option("split", split).option("scope", json.dumps(list(scope))).load()


def write_sqlite(df: DataFrame, path: str, name: str) -> None:
    """df as a folder of files, one for each task. A file gets its name when it is whole, so a task that is run again adds
    none; columns are long, double, string, boolean or binary."""
    folder = local(path)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "BOOLEAN", "binary": "BLOB", "string": "TEXT"}
    columns = ", ".join(f"{quoted(c)} {kinds[k]}" for c, k in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        draft, n = f"{folder}/{uuid.uuid4().hex}.draft", 0
        con = sqlite3.connect(draft)
        con.execute(f"CREATE TABLE {quoted(name)} ({columns})")
        for batch in batches:
            n += batch.num_rows
            con.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * batch.num_columns)})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
        con.commit()
        con.close()
        os.replace(draft, f"{folder}/part-{TaskContext.get().partitionId():05d}.db")
        yield pa.record_batch([pa.array([n])], names=["n"])

    df.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
