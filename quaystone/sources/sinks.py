"""Writers: databases, lake tables with snapshots, backups, dead letters, state."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import hadoop_path, type_of_path
from . import lake
from .scans import LETTER, checkpoint_scan


def jdbc_append(df: DataFrame, options: dict[str, str], batch: int = 1000, connections: int = 16) -> None:
    """Appends; a duplicate key is the database's error."""
    df.write.format("jdbc").options(**options, batchsize=batch, numPartitions=connections).mode("append").save()


def database_append(df: DataFrame, connect: Callable[[], object], table: str, batch: int = 1000, connections: int = 16, mark: str = "?") -> int:
    """Appends over DB-API connections, where tasks reach the database that way; one transaction a task, returns the rows.

    A duplicate key is the database's error, and the task's rows are rolled back.
    """
    names = ", ".join(f'"{c}"' for c in df.columns)
    insert = f"insert into {table} ({names}) values ({', '.join([mark] * len(df.columns))})"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection, n = connect(), 0
        try:
            cursor = connection.cursor()
            for whole in batches:
                for start in range(0, whole.num_rows, batch):
                    rows = list(zip(*(c.to_pylist() for c in whole.slice(start, batch).columns), strict=True))
                    cursor.executemany(insert, rows)
                    n += len(rows)
            connection.commit()
        finally:
            connection.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.coalesce(connections).mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0


def document_append(df: DataFrame, options: dict[str, str]) -> None:
    """Replace-or-insert by id through the MongoDB connector, where its jar is present."""
    df.write.format("mongodb").options(**options, operationType="replace", upsertDocument="true").mode("append").save()


def lake_append(df: DataFrame, root: str, snapshot: int | None = None) -> int:
    """Adds the rows to a lake table as one snapshot; a snapshot that is there already is an error (``lake``)."""
    return lake.append(df, root, snapshot)


def backup_parquet(df: DataFrame, path: str, key: str, partitions: int, rows_per_file: int) -> None:
    """Typed chunks in key order, rotated by rows."""
    df.repartitionByRange(partitions, key).sortWithinPartitions(key).write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def backup_ndjson(df: DataFrame, path: str, key: str, partitions: int, rows_per_file: int = 0) -> None:
    """One JSON object a line, nulls written out, rotated by rows (0: not); gzip, as the text writer has no zstd."""
    df.repartitionByRange(partitions, key).sortWithinPartitions(key).write.option("ignoreNullFields", "false").option("maxRecordsPerFile", rows_per_file).json(path, compression="gzip")


def dead_letters(bad: DataFrame, table: str, record: Column, at: Column, attempts: int = 1, keep: Column | None = None, errors: str = "_errors", drop: list[str] | None = None) -> DataFrame:
    """Failed rows in the dead-letter form; errors: the column that lists what is wrong; keep: one more column to hand through; drop: columns that aren't the row's own."""
    rest = [f"`{c}`" for c in bad.columns if c not in (errors, *(drop or []))]
    more = [] if keep is None else [keep]
    return bad.select(
        record.alias("record_id"),
        F.lit(table).alias("table"),
        F.array_join(F.col(f"`{errors}`"), "; ").alias("error"),
        F.lit(attempts).alias("attempts"),
        at.cast("timestamp_ntz").alias("timestamp"),
        F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("payload"),
        *more,
    )


def dlq_write(letters: DataFrame, path: str) -> None:
    letters.select(*[f.split()[0] for f in LETTER.split(", ")]).write.mode("append").json(path)


def write_letters(letters: DataFrame, path: str, unit: str) -> None:
    """Dead letters with the unit that they come from, a folder for each."""
    letters.write.mode("append").partitionBy(unit).json(path)


def _json(value: object) -> str:
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@dataclass
class DatabaseSink:
    """Appends to a table over DB-API connections, one for each task; what the database refuses becomes dead letters.

    A batch is one transaction, begun by its note in ``ledger`` (a savepoint by itself would be a transaction of its own, with a
    commit for each piece, on databases that begin none before it). Where it is refused it is halved until single rows are left, inside
    savepoints, so every good row is written and each bad one is a letter with the database's own error. The transaction also notes the
    letters in ``ledger`` (made if it isn't there), so a task that is run again after a crash skips what was committed and still
    returns its letters. A batch is known by its place and a digest of its rows, which are sorted by key inside a partition; where
    a later run deals rows otherwise no batch is taken for another one, and the table's own key tells what is there.

    connect: makes a connection; it is sent to the tasks. mark: the driver's placeholder.
    """

    connect: Callable[[], object]
    table: str
    batch: int = 1000
    mark: str = "?"
    ledger: str = "quaystone_batches"

    def append(self, df: DataFrame, key: str, table: str, letters: str, unit: str, errors: str, units: list[str]) -> tuple[list[int], list[int]]:
        """Rows read and rows that became letters, for each of ``units``; one pass, counted while it writes.

        df: the rows with ``unit`` and with ``errors``, whose rows aren't tried.
        """
        self._make_ledger()
        run, columns = f"{letters}/{'/'.join(units)}", [c for c in df.columns if c not in (unit, errors)]
        seen, gone = Observation(), Observation()
        of = [F.col(unit) == u for u in units]
        observed = df.sortWithinPartitions(key).observe(seen, *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(of)])
        at = datetime.now(timezone.utc).replace(tzinfo=None)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number = TaskContext.get().partitionId(), 0
            connection = self.connect()
            try:
                for whole in batches:
                    for start in range(0, whole.num_rows, self.batch):
                        rows = whole.slice(start, self.batch).to_pylist()
                        found = self._commit(connection, hashlib.sha256(run.encode()).hexdigest(), part, number, rows, columns, errors)
                        number += 1
                        out = [{"record_id": str(rows[i][key]), "table": table, "error": e, "attempts": 1, "timestamp": at, "payload": json.dumps({c: rows[i][c] for c in columns}, default=_json), unit: rows[i][unit]} for i, e in found]
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
            finally:
                connection.close()

        schema = pa.schema([("record_id", pa.string()), ("table", pa.string()), ("error", pa.string()), ("attempts", pa.int32()), ("timestamp", pa.timestamp("us")), ("payload", pa.string()), (unit, pa.string())])
        made = observed.mapInArrow(put, f"{LETTER}, `{unit}` string")
        write_letters(made.observe(gone, *[F.count_if(c).alias(f"b{i}") for i, c in enumerate(of)]), letters, unit)
        return [seen.get[f"n{i}"] for i in range(len(units))], [gone.get[f"b{i}"] for i in range(len(units))]

    def _make_ledger(self) -> None:
        connection = self.connect()
        try:
            connection.cursor().execute(f"create table if not exists {self.ledger} (run char(64), part integer, number integer, digest char(64), refused text, primary key (run, part, number, digest))")
            connection.commit()
        finally:
            connection.close()

    def _commit(self, connection, run: str, part: int, number: int, rows: list[dict], columns: list[str], errors: str) -> list[tuple[int, str]]:
        """(row number, error) of the rows that weren't written."""
        cursor, m = connection.cursor(), self.mark
        batch = (run, part, number, hashlib.sha256(json.dumps(rows, default=_json).encode()).hexdigest())
        cursor.execute(f"select refused from {self.ledger} where run = {m} and part = {m} and number = {m} and digest = {m}", batch)
        if (known := cursor.fetchone()) is not None:
            connection.rollback()
            return [tuple(x) for x in json.loads(known[0])]
        names = ", ".join(f'"{c}"' for c in columns)
        insert = f"insert into {self.table} ({names}) values ({', '.join([m] * len(columns))})"
        cursor.execute(f"insert into {self.ledger} values ({m}, {m}, {m}, {m}, {m})", (*batch, "[]"))
        found = [(i, "; ".join(r[errors])) for i, r in enumerate(rows) if r[errors]]
        found += self._insert(cursor, insert, [(i, tuple(r[c] for c in columns)) for i, r in enumerate(rows) if not r[errors]])
        if found:
            cursor.execute(f"update {self.ledger} set refused = {m} where run = {m} and part = {m} and number = {m} and digest = {m}", (json.dumps(found), *batch))
        connection.commit()
        return found

    def _insert(self, cursor, insert: str, rows: list[tuple[int, tuple]]) -> list[tuple[int, str]]:
        if not rows:
            return []
        cursor.execute("savepoint batch")
        try:
            cursor.executemany(insert, [r for _, r in rows])
        except Exception as e:  # drivers have error classes of their own; a lost connection fails again below
            cursor.execute("rollback to savepoint batch")
            cursor.execute("release savepoint batch")
            if len(rows) == 1:
                return [(rows[0][0], f"{type(e).__name__}: {e}")]
            half = len(rows) // 2
            return self._insert(cursor, insert, rows[:half]) + self._insert(cursor, insert, rows[half:])
        cursor.execute("release savepoint batch")
        return []


#: Files of a state log from which on it is folded.
FOLD_AT = 64


def checkpoint_write(rows: DataFrame, path: str, fold_at: int = FOLD_AT) -> None:
    """Appends states; readers take the latest of each key. A log of ``fold_at`` files is folded (``fold_state``)."""
    rows.coalesce(1).write.mode("append").json(path)
    if len(_state_files(rows.sparkSession, path)) >= fold_at:
        fold_state(rows.sparkSession, path)


def _state_files(spark: SparkSession, path: str) -> list[str]:
    fs, folder = hadoop_path(spark, path)
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json") and not n.startswith(("_", ".")))


def fold_state(spark: SparkSession, path: str, keep: DataFrame | None = None) -> None:
    """Folds a state log into one file with the latest state of each partition.

    The new file appears by a rename; what it replaces stays until the next fold, so a reader that listed files before still finds them,
    and one that sees both takes the latest state either way. Two writers may fold at once: their files say the same. The folded
    files' names are kept in ``_folded``. keep: operation_id of the operations whose states stay; others are deleted at
    once, with the files that hold them.
    """
    fs, folder = hadoop_path(spark, path)
    path_of = type_of_path(spark)
    old = _state_files(spark, path)
    if not old:
        return
    latest = checkpoint_scan(spark, path)
    if keep is not None:
        latest = latest.join(keep.select("operation_id").distinct(), "operation_id", "left_semi")
    temporary = f"{path}/_fold-{uuid.uuid4().hex}"
    latest.coalesce(1).write.json(temporary)
    before = _folded(spark, path)
    _, made = hadoop_path(spark, temporary)
    for status in fs.listStatus(made):
        if status.getPath().getName().startswith("part-"):
            fs.rename(status.getPath(), path_of(f"{path}/folded-{uuid.uuid4().hex}.json"))
    fs.delete(made, True)
    for name in old if keep is not None else [n for n in old if n in before]:
        fs.delete(path_of(f"{path}/{name}"), False)
    out = fs.create(path_of(f"{path}/_folded"), True)
    out.write(bytearray(json.dumps(old).encode()))
    out.close()


def _folded(spark: SparkSession, path: str) -> set[str]:
    """Files that the last fold has replaced."""
    fs, where = hadoop_path(spark, f"{path}/_folded")
    if not fs.exists(where):
        return set()
    stream = fs.open(where)
    try:
        return set(json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()
