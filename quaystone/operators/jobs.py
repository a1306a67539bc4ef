"""Jobs: migrate, backup, restore, verify, status, replay, expire."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.transforms import apply_masking
from ..plans.partitions import key_bounds, plan_key_ranges
from ..sources.scans import CHECKPOINT, checkpoint_scan, chunk_checksums, dlq_scan, manifest_scan
from ..session import delete_path, hadoop_path, publish_text
from ..sources.sinks import DatabaseSink, backup_ndjson, backup_parquet, checkpoint_write, dead_letters, dlq_write, write_letters
from .rangehash import compare
from .schemas import errors_of, split_bad


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


#: Uncompressed bytes that make a chunk file of a backup.
CHUNK_BYTES = 512 << 20


def isolate_bad_rows(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows and rows that fail a check, in one pass over the checks."""
    return split_bad(df.withColumn("_errors", errors_of(checks)))


PLAN = "operation_id string, partition_id string, start bigint, `end` bigint"
#: Slices that one scan of the source writes before their ranges are marked.
GROUP = 16
#: Partition columns of the target's folders, and the checks that a refused row failed; renamed where the source has such columns.
UNIT, REFUSED, ERRORS = "_unit", "_refused", "_errors"


def _read_or_empty(spark: SparkSession, schema: str | StructType, path: str, read: Callable[[], DataFrame]) -> DataFrame:
    """What ``read`` reads from a path, an empty frame where there is none yet."""
    fs, where = hadoop_path(spark, path)
    return read() if fs.exists(where) else spark.createDataFrame([], schema)


def stored_plan(source: DataFrame, root: str, operation: str, key: str, partitions: int) -> list[Row]:
    """The operation's ranges, which never change once they are stored.

    The first run plans them from the key bounds. Where the bounds have moved since, only what lies
    outside the stored ranges is planned anew and added, so "range p3 is Done" keeps its meaning.
    """
    spark, path = source.sparkSession, f"{root}/plan"
    known = _read_or_empty(spark, PLAN, path, lambda: spark.read.schema(PLAN).json(path)).filter(F.col("operation_id") == operation).collect()  # one row for each range
    if known:
        b = key_bounds(source, key).first()
        low, high = min(r["start"] for r in known), max(r["end"] for r in known)
        outside = [(lo, hi) for lo, hi in ((b["min_key"], low), (high, None if b["max_key"] is None else b["max_key"] + 1)) if lo is not None and hi is not None and lo < hi]
        width = max(1, -(-(high - low) // len(known)))
        new, number = [], len(known)
        for lo, hi in outside:
            for start in range(lo, hi, max(width, -(-(hi - lo) // partitions))):
                new.append((operation, f"p{number}", start, min(hi, start + max(width, -(-(hi - lo) // partitions)))))
                number += 1
    else:
        ranges = plan_key_ranges(source, key, partitions).collect()
        new = [(operation, r["partition_id"], r["start"], r["end"]) for r in ranges if r["start"] < r["end"]]
    if new:
        spark.createDataFrame(new, PLAN).coalesce(1).write.mode("append").json(path)
    return sorted([*known, *(Row("operation_id", "partition_id", "start", "end")(*r) for r in new)], key=lambda r: r["start"])


@dataclass
class Slice:
    """A stretch of a range that is committed at once; ``last`` ends its range."""

    partition: str
    start: int
    end: int
    last: bool

    @property
    def folder(self) -> str:
        return f"{self.partition}@{self.start}"


def slices(plan: list[Row], seen: dict[str, Row], commits: int) -> list[Slice]:
    """What is still to do: ranges that aren't Done, from the key after the last committed one, in ``commits`` equal steps."""
    out = []
    for r in plan:
        state = seen.get(r["partition_id"])
        if state is not None and state["status"] == "Done":
            continue
        width = max(1, -(-(r["end"] - r["start"]) // commits))
        first = r["start"] if state is None or state["last_committed"] is None else max(r["start"], state["last_committed"] + 1)
        cuts = [first, *(x for x in range(r["start"] + width, r["end"], width) if x > first), r["end"]]
        out += [Slice(r["partition_id"], a, b, b == r["end"]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def migrate(
    source: DataFrame,
    root: str,
    operation: str,
    key: str,
    partitions: int,
    masks: list[tuple[str, str]] | None = None,
    checks: dict[str, Column] | None = None,
    table: str = "table",
    units: int | None = None,
    group: int = GROUP,
    commits: int = 1,
    sink: DatabaseSink | None = None,
) -> DataFrame:
    """Moves a table by planned key ranges; every row is read once.

    The plan is stored with the operation (``stored_plan``). A range is committed in ``commits`` steps of its keys, and steps
    that aren't done go in groups of ``group`` in key order: one scan of the source, filtered to the group's keys (a filter
    that files and databases can use), which writes good and refused rows to folders of their own and counts
    both while it writes; then a checkpoint for each range, Done or InProgress with the last committed key. A run that
    fails leaves every earlier group; what it left of its own is cleared away first thing, and a restart goes on
    after the last committed key.

    Rows that fail a check become dead letters below ``root``/failed. With ``sink`` good rows go to that database
    instead of files, and rows that it refuses become letters as well; then the result is empty.

    units: only so many ranges (to spread a migration over several runs). masks apply after rows found their range. Rows without
    a key are in no range, as in any range scan (``key_uniqueness_check`` counts them); rows that appear later below a range's last
    committed key are not looked for again. Returns the target as a DataFrame, empty if nothing was written.
    """
    spark, state = source.sparkSession, f"{root}/state"
    seen = {r["partition_id"]: r for r in _read_or_empty(spark, CHECKPOINT, state, lambda: checkpoint_scan(spark, state, operation)).collect()}  # one row for each range
    todo = slices(stored_plan(source, root, operation, key, partitions), seen, commits)
    if units is not None:
        some = list(dict.fromkeys(s.partition for s in todo))[:units]
        todo = [s for s in todo if s.partition in some]
    counts = {p: (r["rows_written"], r["error_count"]) for p, r in seen.items()}
    for k in range(0, len(todo), group):
        _move(source, root, operation, key, todo[k : k + group], masks or [], checks or {}, table, counts, sink)
    return migrated(spark, root, apply_masking(source, masks or []).schema)


def free_names(columns: list[str]) -> tuple[str, str, str]:
    """UNIT, REFUSED and ERRORS, with more underscores as long as a column has that name."""
    taken, out = {c.lower() for c in columns}, []
    for name in (UNIT, REFUSED, ERRORS):
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def _move(source: DataFrame, root: str, operation: str, key: str, todo: list[Slice], masks: list[tuple[str, str]], checks: dict[str, Column], table: str, counts: dict[str, tuple[int, int]], sink: DatabaseSink | None) -> None:
    """One pass over the slices' rows, then the letters and the checkpoints."""
    spark, k, at = source.sparkSession, F.col(f"`{key}`"), F.lit(_now())
    unit, refused, errors = free_names(source.columns)
    label = F.lit(None).cast("string")
    for s in reversed(todo):
        label = F.when((k >= s.start) & (k < s.end), F.lit(s.folder)).otherwise(label)
    part = source.filter((k >= todo[0].start) & (k < todo[-1].end)).withColumn(unit, label).filter(F.col(unit).isNotNull())
    part = apply_masking(part, masks).withColumn(errors, errors_of(checks) if checks else F.array().cast("array<string>"))
    data, letters = f"{root}/data", f"{root}/failed"
    for s in todo:  # what a run that failed has left
        for path in (f"{data}/{refused}=false", f"{data}/{refused}=true", letters):
            delete_path(spark, f"{path}/{unit}={s.folder}")
    of = [F.col(unit) == s.folder for s in todo]
    if sink is None:
        part = part.withColumn(refused, F.size(errors) > 0)
        seen = Observation()
        counted = [F.count_if(c).alias(f"n{i}") for i, c in enumerate(of)] + [F.count_if(c & F.col(refused)).alias(f"b{i}") for i, c in enumerate(of)]
        part.observe(seen, *counted).write.mode("append").partitionBy(refused, unit).parquet(data)
        read, failed = ([seen.get[f"{x}{i}"] for i in range(len(todo))] for x in "nb")
        wrong = [f"{data}/{refused}=true/{unit}={s.folder}" for s, n in zip(todo, failed, strict=True) if n]
        if wrong:
            bad = spark.read.schema(part.drop(refused).schema).option("basePath", f"{data}/{refused}=true").parquet(*wrong)
            write_letters(dead_letters(bad, table, k.cast("string"), at, keep=F.col(unit), errors=errors, drop=[unit]), letters, unit)
            for path in wrong:  # the letters hold these rows
                delete_path(spark, path)
    else:
        read, failed = sink.append(part, key, table, letters, unit, errors, [s.folder for s in todo])
    rows = {}
    for s, n, bad_rows in zip(todo, read, failed, strict=True):
        done, wrong_rows = counts.get(s.partition, (0, 0))
        counts[s.partition] = (done + n - bad_rows, wrong_rows + bad_rows)
        rows[s.partition] = (operation, s.partition, "Done" if s.last else "InProgress", s.end - 1, *counts[s.partition], _now())
    checkpoint_write(spark.createDataFrame(list(rows.values()), CHECKPOINT), f"{root}/state")


def migrated(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The good rows that a migration wrote to files."""
    unit, refused, _ = free_names(schema.names)
    path = f"{root}/data/{refused}=false"
    return _read_or_empty(spark, schema, path, lambda: spark.read.schema(schema).parquet(path).drop(unit))


def status(spark: SparkSession, root: str, operation: str) -> DataFrame:
    return checkpoint_scan(spark, f"{root}/state", operation).select("partition_id", "status", "rows_written", "error_count", "updated_at").orderBy("partition_id")


def rows_per_chunk(df: DataFrame, chunk_bytes: int) -> int:
    """How many rows of average size, taken as JSON over all rows, come to ``chunk_bytes``; files are smaller, being compressed."""
    size = df.agg(F.avg(F.octet_length(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})))).first()[0]
    return max(1, int(chunk_bytes / max(1.0, size or 1.0)))


def backup(df: DataFrame, root: str, operation: str, table: str, key: str, partitions: int = 8, rows_per_file: int | None = None, kind: str = "parquet", chunk_bytes: int = CHUNK_BYTES) -> None:
    """Chunks, then their hashes and row counts, then the manifest: where there is one the backup is whole.

    A file ends after ``rows_per_file`` rows; without that number, after as many as come to ``chunk_bytes``. Hashes come from
    one pass over the files' bytes; rows of Parquet chunks from their footers, of JSON chunks from a count.
    """
    spark, path = df.sparkSession, f"{root}/{operation}/chunks"
    rows = rows_per_file or rows_per_chunk(df, chunk_bytes)
    if kind == "parquet":
        backup_parquet(df, path, key, partitions, rows)
        back = spark.read.schema(df.schema).parquet(path)
    else:
        backup_ndjson(df, path, key, partitions, rows)
        back = spark.read.schema(df.schema).json(path)
    counts = {r["file"]: r["n"] for r in back.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect()}  # one row for each chunk file
    chunks = sorted(chunk_checksums(spark, [path]).select("file", "length", "sha256").collect())
    manifest = {
        "version": 1,
        "operation_id": operation,
        "source": {"type": kind, "db": "", "table": table},
        "created_at": _now().isoformat(),
        "row_count": sum(counts.values()),
        "chunk_size_bytes": max((r["length"] for r in chunks), default=0),
        "chunks": [{"index": i, "file": r["file"], "row_count": counts.get(r["file"], 0), "sha256": r["sha256"]} for i, r in enumerate(chunks)],
        "schema_snapshot": df.schema.json(),
    }
    publish_text(spark, f"{root}/{operation}/manifest.json", json.dumps(manifest))


def verify_backup(spark: SparkSession, root: str, operation: str) -> DataFrame:
    """Each chunk of the manifest: OK, MISSING or CORRUPT; all are missing where their folder is."""
    chunks = manifest_scan(spark, f"{root}/{operation}").filter("file is not null")
    folder = f"{root}/{operation}/chunks"
    there = _read_or_empty(spark, "file string, _sha string", folder, lambda: chunk_checksums(spark, [folder]).select("file", F.col("sha256").alias("_sha")))
    out = chunks.join(there, "file", "left")
    return out.withColumn("verdict", F.when(F.col("_sha").isNull(), "MISSING").when(F.col("_sha") != F.col("sha256"), "CORRUPT").otherwise("OK")).select("index", "file", "row_count", "verdict")


def restore(spark: SparkSession, root: str, operation: str) -> DataFrame:
    """The backed-up table, after every chunk was checked; a bad chunk or a wrong row count is an error."""
    bad = verify_backup(spark, root, operation).filter("verdict != 'OK'").limit(5).collect()
    if bad:
        raise ValueError(f"backup {operation} can't be restored: {[(r['file'], r['verdict']) for r in bad]}")
    m = spark.read.option("multiLine", "true").json(f"{root}/{operation}/manifest.json").select("row_count", "schema_snapshot", "source.type").first()
    reader = spark.read.schema(StructType.fromJson(json.loads(m["schema_snapshot"])))
    path = f"{root}/{operation}/chunks"
    df = reader.parquet(path) if m["type"] == "parquet" else reader.json(path)
    n = df.count()
    if n != m["row_count"]:
        raise ValueError(f"backup {operation}: {n} rows, the manifest has {m['row_count']}")
    return df


def verify_migration(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], percent: float = 1.0) -> DataFrame:
    """One row: hashed rows of both sides (of a sample of keys) and how many keys are missing, extra or mismatched.

    Both sides are hashed by key ranges (``rangehash``): equal tables are read once and never joined, of
    others only the ranges that differ are read on.
    """
    c = compare(source, target, keys, columns, percent)
    counts = c.rows.agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("missing", "extra", "mismatched")])
    return counts.select(F.lit(c.source_rows).cast("bigint").alias("source_rows"), F.lit(c.target_rows).cast("bigint").alias("target_rows"), "*", F.lit(c.equal).alias("equal"))


def replay(spark: SparkSession, letters: str, payload_schema: str, fix: Callable[[DataFrame], DataFrame], checks: dict[str, Column], record: Column, again: str) -> DataFrame:
    """Dead letters through a correction and the checks once more: good rows; what fails again goes to ``again``.

    Without letters there are no rows and nothing is written.
    """
    old = dlq_scan(spark, letters, payload_schema)
    good, bad = isolate_bad_rows(fix(old.select("record.*")), checks)
    first = old.select("table").limit(1).first()
    if first is not None:
        dlq_write(dead_letters(bad, first["table"], record, F.lit(_now()), attempts=2), again)
    return good


def expire_backups(kept: DataFrame) -> DataFrame:
    """Backups that go (rows of ``retention_keep``)."""
    return kept.filter(~F.col("keep"))


def delete_backups(spark: SparkSession, root: str, operations: list[str]) -> list[str]:
    """Deletes the chunks of backups; each manifest stays as ``tombstone.json``, for audits.

    The manifest is renamed first, so a backup that is half deleted is none any more. Returns those that were deleted
    now; unknown ones and those that are gone already are left out. operations: one short name for each backup that goes.
    """
    gone = []
    hadoop = spark._jvm.org.apache.hadoop.fs
    for operation in operations:
        manifest, tombstone, chunks = (hadoop.Path(f"{root}/{operation}/{x}") for x in ("manifest.json", "tombstone.json", "chunks"))
        fs = manifest.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(manifest):
            fs.rename(manifest, tombstone)
            gone.append(operation)
        if fs.exists(tombstone):
            fs.delete(chunks, True)  # also what an earlier try left
    return gone
