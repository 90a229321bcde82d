"""The definition catalog of a relational database as a Spark data source.

    spark.dataSource.register(CatalogSource)
    spark.read.format("catalog").options(driver="sqlite3", database=..., table=..., key="definition_key", columns="definition_id long, ...").load()
    df.write.format("catalog").options(...).mode("append").save()

`driver` is a module of Python's database interface that executors have; `database` is what its connect() takes.  Reading is
split into ranges of an integer column.  Writing inserts rows whose key is absent: tasks put theirs into a staging table under the
write's own number, and the commit, one transaction on the driver, moves from each key the smallest row that the catalog lacks.  A write
that fails, or a task that is tried again, leaves nothing in the catalog; rows that a task stages after its write was given up
stay staged under a number that no commit uses.

Defined cases: a null key is never inserted; of several new rows with one key the first in column order stays; an empty
table is read as no rows and written without effect; columns that the option does not name are an error of the writer.
"""

from __future__ import annotations

import contextlib
import importlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegralType, StructType


def _connect(options):
    return importlib.import_module(options.get("driver", "sqlite3")).connect(options["database"])


def _name(x: str) -> str:
    if not x.replace("_", "").isalnum():
        raise ValueError(f"not a plain name: {x}")
    return x


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None


class CatalogReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.names, self.options = [_name(f.name) for f in schema], dict(options)
        numbers = [f.name for f in schema if isinstance(f.dataType, IntegralType)]
        self.by = options.get("partitioncolumn") or options.get("partitionColumn") or (numbers[0] if numbers else None)

    def partitions(self) -> list[Range]:
        n = int(self.options.get("numpartitions") or self.options.get("numPartitions") or 4)
        if not self.by:
            return [Range(None, None)]
        with contextlib.closing(_connect(self.options)) as db:
            low, high = db.execute(f"SELECT min({_name(self.by)}), max({_name(self.by)}) FROM {_name(self.options['table'])}").fetchone()
        if low is None:
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // n))
        cuts = list(range(low + step, high + 1, step))
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None])]  # the first also has rows without a number

    def read(self, partition: Range) -> Iterator[tuple]:
        where = []
        if partition.high is not None:
            where.append(f"{self.by} < {int(partition.high)}" + (f" OR {self.by} IS NULL" if partition.low is None else ""))
        if partition.low is not None:
            where.append(f"{self.by} >= {int(partition.low)}")
        sql = f"SELECT {', '.join(self.names)} FROM {_name(self.options['table'])}" + (" WHERE " + " AND ".join(f"({w})" for w in where) if where else "")
        with contextlib.closing(_connect(self.options)) as db:
            yield from map(tuple, db.execute(sql))


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    rows: int


class CatalogWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options):
        self.names, self.options, self.run = [_name(f.name) for f in schema], dict(options), uuid.uuid4().hex
        self.table, self.key = _name(options["table"]), _name(options["key"])
        self.stage, listed = f"{self.table}_staged", ", ".join(self.names)
        with contextlib.closing(_connect(self.options)) as db, db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {self.stage} AS SELECT '' AS run, '' AS attempt, {listed} FROM {self.table} WHERE 1 = 0")

    def write(self, iterator) -> Staged:
        attempt, n = uuid.uuid4().hex, 0
        marks = ", ".join("?" * (len(self.names) + 2))
        with contextlib.closing(_connect(self.options)) as db, db:
            for row in iterator:
                db.execute(f"INSERT INTO {self.stage} (run, attempt, {', '.join(self.names)}) VALUES ({marks})", (self.run, attempt, *(row[c] for c in self.names)))
                n += 1
        return Staged(attempt, n)

    def commit(self, messages) -> None:
        """Rows of the attempts that ended well, one a key, where the catalog has none."""
        good, listed = [m.attempt for m in messages if m], ", ".join(self.names)
        with contextlib.closing(_connect(self.options)) as db, db:
            for at in range(0, len(good), 500):
                some = good[at : at + 500]
                db.execute(f"UPDATE {self.stage} SET run = ? WHERE run = ? AND attempt IN ({', '.join('?' * len(some))})", (self.run + "+", self.run, *some))
            db.execute(
                f"INSERT INTO {self.table} ({listed}) SELECT {listed} FROM (SELECT {listed}, row_number() OVER (PARTITION BY {self.key} ORDER BY {listed}) AS one FROM {self.stage} WHERE run = ?) s "
                f"WHERE one = 1 AND {self.key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {self.table} c WHERE c.{self.key} = s.{self.key})",
                (self.run + "+",),
            )
            db.execute(f"DELETE FROM {self.stage} WHERE run IN (?, ?)", (self.run, self.run + "+"))

    def abort(self, messages) -> None:
        with contextlib.closing(_connect(self.options)) as db, db:
            db.execute(f"DELETE FROM {self.stage} WHERE run IN (?, ?)", (self.run, self.run + "+"))


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> CatalogReader:
        return CatalogReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CatalogWriter:
        if overwrite:
            raise ValueError("the catalog is only added to")
        return CatalogWriter(schema, self.options)
