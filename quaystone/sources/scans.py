"""Readers: databases by option builders, files, backups, dead letters, state and audit tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import latest_by
from ..plans.partitions import range_filter
from ..session import hadoop_path, token
from . import lake

CHECKPOINT = "operation_id string, partition_id string, status string, last_committed bigint, rows_written bigint, error_count bigint, updated_at timestamp_ntz"
LETTER = "record_id string, `table` string, error string, attempts int, `timestamp` timestamp_ntz, payload string"
AUDIT = "ts timestamp_ntz, user string, hostname string, operation string, source string, target string, tables array<string>, phase string, outcome string, row_count bigint, config_hash string, error string"
MANIFEST = "version int, operation_id string, source struct<type:string,db:string,table:string>, created_at string, row_count bigint, chunk_size_bytes bigint, chunks array<struct<index:int,file:string,row_count:bigint,sha256:string>>, schema_snapshot string"


def jdbc_options(url: str, table: str, driver: str | None = None, **more) -> dict[str, str]:
    return {"url": url, "dbtable": table, **({"driver": driver} if driver else {}), **{k: str(v) for k, v in more.items()}}


def jdbc_range_scan(spark: SparkSession, options: dict[str, str], key: str, low: int, high: int, n: int) -> DataFrame:
    """n parallel range reads over an integer key; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(**options, partitionColumn=key, lowerBound=low, upperBound=high + 1, numPartitions=n).load()


def jdbc_plan_scan(spark: SparkSession, options: dict[str, str], key: str, plan: list[tuple[int | None, int | None]]) -> DataFrame:
    """One read for each (start, end) of a plan."""
    parts = [" AND ".join([f"{key} >= {s}"] * (s is not None) + [f"{key} < {e}"] * (e is not None)) or "1 = 1" for s, e in plan]
    o = dict(options)
    return spark.read.jdbc(o.pop("url"), o.pop("dbtable"), predicates=parts, properties=o)


def document_options(uri: str, database: str, collection: str) -> dict[str, str]:
    """Options of the MongoDB Spark connector (``format('mongodb')``), where its jar is present."""
    return {"connection.uri": uri, "database": database, "collection": collection, "partitioner": "com.mongodb.spark.sql.connector.read.partitioner.SamplePartitioner"}


def widecolumn_options(host: str, keyspace: str, table: str) -> dict[str, str]:
    """Options of the Cassandra Spark connector, where its jar is present."""
    return {"spark.cassandra.connection.host": host, "keyspace": keyspace, "table": table}


def document_scan(spark: SparkSession, path: str, schema: str, key: str, start=None, end=None) -> DataFrame:
    """JSON documents of a key range; the schema is given, so nothing is read twice."""
    return spark.read.schema(schema).json(path).filter(range_filter(key, start, end))


def token_range_scan(df: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Rows whose token lies in a range, with their composite id; the token itself is left out again."""
    t = token(*keys)
    return df.filter((t >= start) & (t < end)).withColumn("record_id", F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))


def lake_file_scan(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files under a folder, other files left out, with the file each row came from."""
    return spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def lake_snapshot_scan(spark: SparkSession, root: str, snapshot: int | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """A lake table as of a snapshot (the latest if None), of which files outside ``ranges`` aren't read (``lake``)."""
    return lake.scan(spark, root, snapshot, ranges)


def manifest_scan(spark: SparkSession, root: str) -> DataFrame:
    """One row for each chunk of every backup under a root."""
    m = spark.read.schema(MANIFEST).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(root)
    return m.select("operation_id", "source", "created_at", "schema_snapshot", F.explode_outer("chunks").alias("c")).select("operation_id", F.col("source.table").alias("table"), "created_at", "schema_snapshot", F.col("c.index").alias("index"), F.col("c.file").alias("file"), F.col("c.row_count").alias("row_count"), F.col("c.sha256").alias("sha256"))


def dlq_scan(spark: SparkSession, path: str, payload_schema: str | None = None) -> DataFrame:
    """Dead letters; with a schema the payload comes as columns."""
    d = spark.read.schema(LETTER).json(path)
    return d.withColumn("record", F.from_json("payload", payload_schema)) if payload_schema else d


def checkpoint_scan(spark: SparkSession, path: str, operation: str | None = None) -> DataFrame:
    """The latest state of every partition (of one operation)."""
    c = spark.read.schema(CHECKPOINT).json(path)
    if operation is not None:
        c = c.filter(F.col("operation_id") == operation)
    return latest_by(c, ["operation_id", "partition_id"], ["updated_at", "rows_written"])


def audit_runs(audit: DataFrame) -> DataFrame:
    """Start and end rows of each operation as one row with its duration."""
    start, end = F.min(F.when(F.col("phase") == "start", F.col("ts"))), F.max(F.when(F.col("phase") == "end", F.col("ts")))
    last = lambda c: F.max(F.when(F.col("phase") == "end", F.col(c)))
    return audit.groupBy("operation").agg(start.alias("started"), end.alias("ended"), last("outcome").alias("outcome"), last("row_count").alias("row_count")).withColumn("seconds", F.timestamp_diff("SECOND", F.col("started"), F.col("ended")))


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of every file below a root (any Hadoop file system); contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")


#: Files above this size are hashed block by block instead of as one value.
WHOLE_FILE = 256 << 20


def chunk_checksums(spark: SparkSession, files: list[str], whole: int = WHOLE_FILE) -> DataFrame:
    """path, file, length, SHA-256 of files (or of the files in folders).

    Files up to ``whole`` bytes are hashed as one value; larger ones, where a listing shows any, aren't read by that scan (the filter on
    length reaches it) but by tasks that hold 8 MB at a time, through Arrow's file systems (local, HDFS, S3, GCS).
    """
    scan = spark.read.format("binaryFile").load(files)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    small = scan.filter(F.col("length") <= whole).select("path", name, "length", F.sha2("content", 256).alias("sha256"))
    if largest_file(spark, files) <= whole:
        return small
    large = scan.filter(F.col("length") > whole).select("path", name, "length")
    return small.unionByName(large.repartition("path").mapInArrow(_hashed, "path string, file string, length bigint, sha256 string"))


def largest_file(spark: SparkSession, files: list[str]) -> int:
    """Bytes of the largest of some files, or of the files in folders, by a listing."""
    most = 0
    for path in files:
        fs, where = hadoop_path(spark, path)
        for status in fs.listStatus(where) if fs.exists(where) else ():
            most = max(most, status.getLen())
    return most


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            fs, inner = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            digest = hashlib.sha256()
            with fs.open_input_stream(inner) as stream:
                while block := stream.read(8 << 20):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "sha256"])
