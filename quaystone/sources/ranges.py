"""Stores that are read by key ranges, as a Spark data source with planned partitions and filter pushdown.

``RangeTable`` takes a plan (one partition for each range), and a function that reads one range of a store: documents by id, wide
rows by token, anything that answers "keys from a to b". Conditions on the key that Spark hands down close
partitions that can't match and narrow the others, so the store isn't asked for what a filter would drop.
"""

from __future__ import annotations

import importlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Spark's switch for handing filters to sources written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Rows of a batch that a task hands to Spark.
BATCH = 4096


@dataclass(frozen=True)
class KeyRange(InputPartition):
    """start <= key < end, None open; after: only keys strictly beyond it (what a resumed run has committed)."""

    partition_id: str
    start: object = None
    end: object = None
    after: object = None

    def narrowed(self, low: object, high: object) -> KeyRange | None:
        """The part at or above ``low`` and below ``high`` (None: no condition), or None where nothing is left."""
        start = low if self.start is None or (low is not None and low > self.start) else self.start
        end = high if self.end is None or (high is not None and high < self.end) else self.end
        if end is not None and (start is not None and start >= end or self.after is not None and self.after >= end):
            return None
        return replace(self, start=start, end=end)

    def holds(self, key: object) -> bool:
        return (self.start is None or key >= self.start) and (self.end is None or key < self.end) and (self.after is None or key > self.after)


Fetch = Callable[[KeyRange, list], Iterator[tuple]]


def next_key(key: object) -> object:
    """The smallest key above a whole number or text; None for other types."""
    if isinstance(key, int) and not isinstance(key, bool):
        return key + 1
    return key + "\0" if isinstance(key, str) else None


class _Reader(DataSourceReader):
    def __init__(self, plan: list[KeyRange], schema: StructType, key: str, fetch: Fetch):
        self.plan, self.fields, self.key, self.fetch = plan, schema, key, fetch

    def pushFilters(self, filters: list[Filter]):  # noqa: N802, Spark's name
        """Narrows the plan; Spark checks every filter again, so a bound that can't be expressed may stay wide."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,):
                self.plan = [p for p in (self._under(p, f) for p in self.plan) if p is not None]
        return filters

    @staticmethod
    def _under(p: KeyRange, f: Filter) -> KeyRange | None:
        if isinstance(f, EqualTo):
            return p.narrowed(f.value, next_key(f.value)) if p.holds(f.value) else None
        if isinstance(f, GreaterThanOrEqual):
            return p.narrowed(f.value, None)
        if isinstance(f, GreaterThan):
            up = next_key(f.value)
            return p.narrowed(f.value if up is None else up, None)
        if isinstance(f, LessThan):
            return p.narrowed(None, f.value)
        if isinstance(f, LessThanOrEqual):
            return p.narrowed(None, next_key(f.value))
        if isinstance(f, In):
            inside = [v for v in f.value if v is not None and p.holds(v)]
            return p.narrowed(min(inside), next_key(max(inside))) if inside else None
        return p

    def partitions(self) -> list[KeyRange]:
        return self.plan or [KeyRange("none", after="none")]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        if not self.plan:
            return
        schema, rows = to_arrow_schema(self.fields), []
        for row in self.fetch(partition, self.fields.names):
            rows.append(row)
            if len(rows) == BATCH:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class RangeTable:
    """A store that is read by the ranges of a plan, which must not overlap; one task for each range that filters leave.

    fetch: (range, columns) to an iterator of tuples with these columns; it is sent to the tasks. schema: DDL or a struct type.

    Spark keeps the filters that it has pushed with the loaded source, also for other queries on the same frame. So every query
    should start from ``read`` or ``where``, which load anew, and a frame of theirs isn't to be filtered in two ways.
    """

    spark: SparkSession
    fetch: Fetch
    schema: str | StructType
    key: str
    plan: list[KeyRange]

    def where(self, condition: str | Column) -> DataFrame:
        """The rows of one condition; what it says about the key closes and narrows ranges."""
        return self.read().filter(condition)

    def read(self) -> DataFrame:
        kind = StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        title, key, plan, fetch = f"ranges_{uuid.uuid4().hex}", self.key, self.plan, self.fetch

        class Ranges(DataSource):
            @classmethod
            def name(cls) -> str:
                return title

            def schema(self) -> StructType:
                return kind

            def reader(self, schema: StructType) -> DataSourceReader:
                return _Reader(plan, schema, key, fetch)

        self.spark.conf.set(PUSHDOWN, "true")
        self.spark.dataSource.register(Ranges)
        return self.spark.read.format(title).load()


def planned(plan: DataFrame) -> list[KeyRange]:
    """Ranges of a stored plan (partition_id, start, end) or of one with progress (``plan_with_progress``: last_committed as well); Done ones are left out."""
    out = []
    for r in plan.collect():  # one row for each range
        x = r.asDict()
        if x.get("status") != "Done":
            out.append(KeyRange(x["partition_id"], x["start"], x["end"], x.get("last_committed")))
    return out


class Connect:
    """Makes connections of a DB-API driver, named by its module, in the tasks as well as here."""

    def __init__(self, driver: str, *args: object, **options: object):
        self.driver, self.args, self.options = driver, args, options

    def __call__(self):
        return importlib.import_module(self.driver).connect(*self.args, **self.options)


@dataclass
class SqlFetch:
    """Reads a range over a DB-API connection.

    key: the column that ranges go by, or a store's expression for it, such as a token of the key columns. order: read in key order.
    """

    connect: Callable[[], object]
    table: str
    key: str
    mark: str = "?"
    size: int = BATCH

    def __call__(self, r: KeyRange, columns: list[str]) -> Iterator[tuple]:
        bounds = [(f"{self.key} >= {self.mark}", r.start), (f"{self.key} < {self.mark}", r.end), (f"{self.key} > {self.mark}", r.after)]
        where = " and ".join(c for c, v in bounds if v is not None) or "1 = 1"
        names = ", ".join(c if re.fullmatch(r"\w+", c) is None else f'"{c}"' for c in columns)
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(f"select {names} from {self.table} where {where} order by {self.key}", tuple(v for _, v in bounds if v is not None))
            while rows := cursor.fetchmany(self.size):
                yield from rows
        finally:
            connection.close()
