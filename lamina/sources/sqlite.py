"""SQLite as batch and as id-ordered stream: a Python data source over the standard library."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from .. import schemas


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteSource(DataSource):
    """format("sqlite"): options path, table (session_messages), id (id), batch (50). As a stream it reads rows whose id is above
    the last one read, `batch` at a time in id order, and opens the file anew for each batch."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return schemas.SESSIONS if self.options.get("table") == "sessions" else schemas.MESSAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options, schema)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Tail(self.options, schema)


def _rows(options, schema: StructType, where: str = "", args: tuple = ()) -> Iterator[tuple]:
    columns = ", ".join(_quoted(f.name) for f in schema.fields)
    kinds = [{"long": int, "bigint": int, "integer": int, "int": int, "double": float}.get(f.dataType.typeName(), str) for f in schema.fields]
    db = _connect(options["path"])
    try:
        for row in db.execute(f"SELECT {columns} FROM {_quoted(options.get('table', 'session_messages'))} {where}", args):
            yield tuple(None if v is None else kind(v) for kind, v in zip(kinds, row, strict=True))
    finally:
        db.close()


class _Batch(DataSourceReader):
    def __init__(self, options, schema):
        self.options, self.schema = dict(options), schema

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from _rows(self.options, self.schema)


class _Tail(SimpleDataSourceStreamReader):
    def __init__(self, options, schema):
        self.options, self.schema = dict(options), schema
        self.key = options.get("id", "id")
        self.at = [f.name for f in schema.fields].index(self.key)

    def initialOffset(self):
        return {"id": 0}

    def read(self, start):
        key = _quoted(self.key)
        rows = list(_rows(self.options, self.schema, f"WHERE {key} > ? ORDER BY {key} LIMIT ?", (start["id"], int(self.options.get("batch", 50)))))
        return iter(rows), {"id": rows[-1][self.at] if rows else start["id"]}

    def readBetweenOffsets(self, start, end):
        key = _quoted(self.key)
        return _rows(self.options, self.schema, f"WHERE {key} > ? AND {key} <= ? ORDER BY {key}", (start["id"], end["id"]))

    def commit(self, end):
        pass
