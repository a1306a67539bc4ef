"""Batches, chunks, latest versions, retention and samples. No window runs over a whole table unpartitioned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.transforms import row_text
from ..session import token


def batch_rows(df: DataFrame, partition: str, order: list[str], size: int) -> DataFrame:
    """Numbers groups of ``size`` consecutive rows inside each partition."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn("batch_id", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def chunk_rows(df: DataFrame, partition: str, order: list[str], size: Column, limit: int) -> DataFrame:
    """Numbers chunks inside a partition: a chunk closes with the row that brings it to ``limit``, the next begins at nought.

    A sum that starts anew is no window function: rows are dealt out by partition, sorted, and numbered in one pass
    over Arrow batches, a step for each chunk, that remembers one number and one sum. A null or negative size counts as nought.
    """
    sized = df.withColumn("_size", F.greatest(size.cast("bigint"), F.lit(0))).withColumn("_group", F.xxhash64(partition))
    dealt = sized.repartition(partition).sortWithinPartitions("_group", partition, *order)
    schema, columns = StructType([*df.schema.fields]).add("chunk_id", LongType()), df.columns

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running, chunk = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            out = np.empty(n, np.int64)
            group, value = batch.column("_group").to_numpy(zero_copy_only=False), batch.column(partition)
            # values of one hash follow each other, so a border is where either changes
            same = pc.fill_null(pc.equal(value.slice(1), value.slice(0, n - 1)), False).to_numpy(zero_copy_only=False) | (pc.is_null(value.slice(1)).to_numpy(zero_copy_only=False) & pc.is_null(value.slice(0, n - 1)).to_numpy(zero_copy_only=False))
            borders = [0, *(np.flatnonzero((group[1:] != group[:-1]) | ~same) + 1).tolist(), n]
            sizes = batch.column("_size").to_numpy(zero_copy_only=False)
            for a, b in zip(borders[:-1], borders[1:], strict=True):
                key = (group[a], value[a].as_py())
                if key != last:
                    last, running, chunk = key, 0, 0
                upto = np.cumsum(sizes[a:b])
                row = 0
                while row < b - a:  # a step for each chunk: the row that brings it to the limit
                    before = upto[row - 1] if row else 0
                    end = int(np.searchsorted(upto, before + limit - running))
                    out[a + row : a + min(end + 1, b - a)] = chunk
                    if end >= b - a:
                        running += int(upto[-1] - before)
                        break
                    running, chunk, row = 0, chunk + 1, end + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out)], names=[*columns, "chunk_id"])

    return dealt.mapInArrow(numbered, schema)


def latest_by(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last version of each key as one aggregation (no sort), columns of any type; ties go to the larger hash of the rest."""
    rest = [c for c in df.columns if c not in keys and c not in version]
    tie = F.xxhash64(row_text(df, rest)) if rest else F.lit(0)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[f"`{c}`" for c in (*version, *rest)]), F.struct(*[f"`{c}`" for c in version], tie)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in (*version, *rest)])


def dedupe_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in ``order``, which should hold every column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def retention_keep(backups: DataFrame, created: str, key: str, last: int, daily: int, weekly: int, monthly: int) -> DataFrame:
    """Flags which backups stay: the last ones, and the newest of each of the last days, weeks, months.

    The last ones come from a top-k, the newest of a day, week or month from a window over that period,
    so no window runs over all rows in one task.
    """
    newest = [F.desc(created), F.desc(key)]
    top = backups.select(created, key).orderBy(*newest).limit(last).select(F.col(key).alias("_last"))
    out = backups.join(top, backups[key] == top["_last"], "left").withColumn("keep_last", F.col("_last").isNotNull()).drop("_last")
    for name, unit, count in (("keep_daily", "DAY", daily), ("keep_weekly", "WEEK", weekly), ("keep_monthly", "MONTH", monthly)):
        period = F.date_trunc(unit, F.col(created))
        periods = backups.select(period.alias("_p")).distinct().orderBy(F.desc("_p")).limit(count)
        w = Window.partitionBy(period).orderBy(*newest)
        out = out.withColumn("_n", F.row_number().over(w)).join(periods.withColumn("_in", F.lit(True)), period == F.col("_p"), "left")
        out = out.withColumn(name, (F.col("_n") == 1) & F.col("_in").isNotNull()).drop("_n", "_p", "_in")
    return out.withColumn("keep", F.col("keep_last") | F.col("keep_daily") | F.col("keep_weekly") | F.col("keep_monthly"))


def checkpoint_gc(checkpoints: DataFrame, operations: DataFrame, cutoff: Column) -> DataFrame:
    """Checkpoints of operations that started at the cutoff or later; both are keyed by operation_id."""
    return checkpoints.join(operations.filter(F.col("start_time") >= cutoff).select("operation_id"), "operation_id", "left_semi")


def ordered_scan(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Key order inside range partitions, which is enough to resume: no total sort in one task."""
    return df.repartitionByRange(partitions, key).sortWithinPartitions(key)


def sample_first(df: DataFrame, n: int = 1000, *order: str) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def random_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows that look random and are the same each time: those of smallest token."""
    return df.orderBy(token(key), key).limit(n)


def sample_pct_by_key(df: DataFrame, key: str, percent: float) -> DataFrame:
    """The same share of keys on every side that calls it."""
    return df.filter(F.pmod(token(key), F.lit(10_000)) < int(percent * 100))


def union_fields(*parts: DataFrame) -> DataFrame:
    """Union by name; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one side only, with the side; counts copies. One aggregation over both sides' key columns; row hashes may be such a column."""
    both = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(-1).alias("_s")))
    left = both.groupBy(*keys).agg(F.sum("_s").cast("bigint").alias("n")).filter("n != 0")
    return left.select(*keys, F.when(F.col("n") > 0, "source").otherwise("target").alias("side"), F.abs("n").alias("n"))


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
