"""Lake tables: Parquet files and a log of commits that list them.

A commit is one JSON file, ``commits/<snapshot>.json``, which appears by a rename that fails where the name is taken: of two writers
of one snapshot one wins and the other gets ``CommitConflict``. It lists the files that it adds, with rows, bytes and bounds
of columns, and those that it removes. Files are written before and are part of the table only once a commit names them, so
a crash leaves files that no reader sees.

A table as of a snapshot is what the commits up to it added and not removed. Scans leave out files whose bounds can't
match. The commit log is read by Spark; file lists (one short row a file) pass through the driver, rows never do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import hadoop_path

FILE = "path string, n_rows bigint, n_bytes bigint, low map<string,string>, high map<string,string>"
COMMIT = f"snapshot_id bigint, operation string, added array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in FILE.split(', ')))}>>, removed array<string>, schema string"
#: Attempts of an append or merge that doesn't name its snapshot, where other writers are faster.
ATTEMPTS = 20
#: Column types whose bounds are kept; texts and other types have none.
BOUNDED = ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz", "double", "float", "decimal", "string")


class CommitConflict(Exception):
    """Another writer has committed this snapshot."""


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The log: snapshot_id, operation, added, removed, schema."""
    fs, folder = hadoop_path(spark, f"{root}/commits")
    if not fs.exists(folder):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").json(f"{root}/commits")


def latest_snapshot(spark: SparkSession, root: str) -> int:
    """The last commit's number by its file's name, 0 without any."""
    fs, folder = hadoop_path(spark, f"{root}/commits")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def files(spark: SparkSession, root: str, snapshot: int | None = None) -> DataFrame:
    """Live files as of a snapshot (the latest if None), with the snapshot that added them."""
    log = commits(spark, root)
    if snapshot is not None:
        log = log.filter(F.col("snapshot_id") <= snapshot)
    added = log.select("snapshot_id", F.explode("added").alias("f")).select("snapshot_id", "f.*")
    removed = log.select(F.explode("removed").alias("path"))
    return added.join(removed, "path", "left_anti")


def commit(spark: SparkSession, root: str, snapshot: int, operation: str, added: list[dict], removed: list[str], schema: StructType) -> None:
    """Publishes a snapshot, or raises CommitConflict where there is one of this number."""
    text = json.dumps({"snapshot_id": snapshot, "operation": operation, "added": added, "removed": removed, "schema": schema.json()})
    jvm = spark._jvm
    fs, temporary = hadoop_path(spark, f"{root}/commits/_{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{root}/commits/{snapshot:020d}.json")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(temporary).toUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(temporary), fs.makeQualified(final), options)
    except Exception as e:
        fs.delete(temporary, False)
        if fs.exists(final):
            raise CommitConflict(f"snapshot {snapshot} of {root} is there already") from e
        raise


def _bounds(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t.split("(")[0] in BOUNDED]


#: Texts are bounded by so many first characters; the upper one gets the largest character behind it.
PREFIX = 32


def write_files(df: DataFrame, root: str) -> list[dict]:
    """Writes the rows as files that no commit names yet, and returns what a commit says about them.

    Rows and bounds come from one aggregation over the new files, bytes from their footers' metadata.
    """
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(f"{root}/{folder}")
    back = spark.read.schema(df.schema).parquet(f"{root}/{folder}")
    aggs = [F.count("*").alias("n_rows"), F.max("_metadata.file_size").alias("n_bytes")]
    names = _bounds(df)
    for i, c in enumerate(names):
        x = F.col(f"`{c}`")
        aggs += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        if dict(df.dtypes)[c] in ("double", "float"):  # NaN is above all numbers, so such a column has no upper bound then
            aggs[-1] = F.when(~F.isnan(F.max(x)), F.max(x)).alias(f"h{i}")
    out = []
    for r in back.groupBy(F.col("_metadata.file_name").alias("file")).agg(*aggs).collect():  # one row for each file
        low, high = {}, {}
        for i, c in enumerate(names):
            text = dict(df.dtypes)[c] == "string"
            if r[f"l{i}"] is not None:
                low[c] = r[f"l{i}"][:PREFIX] if text else str(r[f"l{i}"])
            if r[f"h{i}"] is not None:
                high[c] = (r[f"h{i}"] if len(r[f"h{i}"]) <= PREFIX else r[f"h{i}"][:PREFIX] + "\U0010ffff") if text else str(r[f"h{i}"])
        out.append({"path": f"{folder}/{r['file']}", "n_rows": r["n_rows"], "n_bytes": r["n_bytes"], "low": low, "high": high})
    return out


def _publish(spark: SparkSession, root: str, snapshot: int | None, operation: str, added: list[dict], schema: StructType) -> int:
    for _ in range(ATTEMPTS):
        number = latest_snapshot(spark, root) + 1 if snapshot is None else snapshot
        try:
            commit(spark, root, number, operation, added, [], schema)
            return number
        except CommitConflict:
            if snapshot is not None:
                raise
    raise CommitConflict(f"{ATTEMPTS} attempts to append to {root} came too late")


def append(df: DataFrame, root: str, snapshot: int | None = None) -> int:
    """Adds the rows as one snapshot and returns its number: the given one, an error if it is taken, or the next free one."""
    if snapshot is not None and snapshot <= latest_snapshot(df.sparkSession, root):
        raise CommitConflict(f"snapshot {snapshot} of {root} is there already, or a later one")
    return _publish(df.sparkSession, root, snapshot, "append", write_files(df, root), df.schema)


def overlapping(df: DataFrame, schema: StructType, ranges: dict[str, tuple]) -> DataFrame:
    """Files (rows of ``files``) whose bounds leave room for values in every range (low, high), both inclusive, None open.

    A file without bounds of a column has only nulls there, or can't say: it stays where the column's type has no bounds or is a float.
    """
    for c, (lo, hi) in ranges.items():
        kind = schema[c].dataType.simpleString()
        if kind.split("(")[0] not in BOUNDED:
            continue
        low, high = F.col("low").getItem(c).cast(kind), F.col("high").getItem(c).cast(kind)
        unknown = F.lit(kind in ("double", "float"))
        if lo is not None:
            df = df.filter(F.coalesce(high >= F.lit(lo).cast(kind), unknown))
        if hi is not None:
            df = df.filter(F.coalesce(low <= F.lit(hi).cast(kind), unknown))
    return df


def schema_of(spark: SparkSession, root: str, snapshot: int | None = None) -> StructType:
    log = commits(spark, root)
    row = (log if snapshot is None else log.filter(F.col("snapshot_id") <= snapshot)).orderBy(F.desc("snapshot_id")).select("schema").first()
    if row is None:
        raise ValueError(f"no snapshot up to {snapshot}")
    return StructType.fromJson(json.loads(row["schema"]))


def scan(spark: SparkSession, root: str, snapshot: int | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """The table as of a snapshot (the latest if None); only rows in ``ranges``, {column: (low, high)}, of which files out of bounds aren't listed."""
    schema = schema_of(spark, root, snapshot)
    paths = [r["path"] for r in overlapping(files(spark, root, snapshot), schema, ranges or {}).select("path").collect()]  # one row for each file
    df = spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)
    for c, (lo, hi) in (ranges or {}).items():
        x = F.col(f"`{c}`")
        df = df.filter((F.lit(True) if lo is None else x >= F.lit(lo)) & (F.lit(True) if hi is None else x <= F.lit(hi)))
    return df


def merge(spark: SparkSession, root: str, source: DataFrame, keys: list[str], version: list[Column] | None = None) -> int:
    """Upserts into a table by copy on write, and returns the snapshot.

    Files that may hold a source key are found by the keys' bounds, then by a semi-join of keys with ``_metadata.file_path``; only
    files with a matching row are written anew, without these rows; the source's rows go to new files. All others keep their
    names. One commit removes and adds; where another writer was first, the merge starts again on its result.
    """
    from ..operators.joins import newest

    new = newest(source, keys, version)
    bounds = source.agg(*[f(F.col(f"`{k}`")).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("l", F.min), ("h", F.max))]).first()
    for _ in range(ATTEMPTS):
        last = latest_snapshot(spark, root)
        schema = schema_of(spark, root, last)
        ranges = {k: (bounds[f"l{i}"], bounds[f"h{i}"]) for i, k in enumerate(keys)}
        near = {r["path"] for r in overlapping(files(spark, root, last), schema, ranges).select("path").collect()}
        touched = _touched(spark, root, near, schema, source, keys)
        added = write_files(new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]), root)
        if touched:
            old = spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in touched])
            added += write_files(old.join(source.select(*keys), keys, "left_anti").select(*[f"`{c}`" for c in schema.names]), root)
        try:
            commit(spark, root, last + 1, "merge", [f for f in added if f["n_rows"]], sorted(touched), schema)
            return last + 1
        except CommitConflict:
            continue
    raise CommitConflict(f"{ATTEMPTS} attempts to merge into {root} came too late")


def _touched(spark: SparkSession, root: str, near: set[str], schema: StructType, source: DataFrame, keys: list[str]) -> list[str]:
    """Those of the files that have a row with a source key; only the key columns are read."""
    if not near:
        return []
    rows = spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in sorted(near)])
    named = rows.select(*keys, F.regexp_extract("_metadata.file_path", "(data/[^/]+/[^/]+)$", 1).alias("_file"))
    return [r["_file"] for r in named.join(source.select(*keys), keys, "left_semi").select("_file").distinct().collect()]  # one row for each file
