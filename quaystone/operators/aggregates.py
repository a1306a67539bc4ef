"""Counts, checksums, quantiles and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import row_text
from ..session import token

# The usual upper bounds of latency buckets, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def table_stats(df: DataFrame, size: Column) -> DataFrame:
    """Rows, total and average size."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(size).cast("bigint").alias("total_size"), F.avg(size).alias("avg_size"))


def high_water_marks(df: DataFrame, partition: str, offset: str) -> DataFrame:
    """Per partition the largest offset and the number of rows; the order of arrival doesn't matter."""
    return df.groupBy(partition).agg(F.max(offset).alias("last_committed"), F.count("*").alias("rows_written"))


def verify_counts(source: DataFrame, target: DataFrame, partition: Column) -> DataFrame:
    """Rows on either side for each partition, in one pass over their union."""
    both = source.select(partition.alias("partition_id"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(target.select(partition.alias("partition_id"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    out = both.groupBy("partition_id").agg(F.sum("s").cast("bigint").alias("source_rows"), F.sum("t").cast("bigint").alias("target_rows"))
    return out.withColumn("equal", F.col("source_rows") == F.col("target_rows"))


def find_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def table_checksum(df: DataFrame, columns: list[str] | None = None, cents: bool = False) -> DataFrame:
    """Fingerprint of a table that doesn't depend on the order of its rows: sum of row tokens and row count.

    A row's token is taken from ``row_text`` with fractions as other engines write them (``number_text``), so any change of any
    value shows, also the sign of a zero. Every row counts, copies too.
    """
    row = token(row_text(df, columns, cents, plain=not cents))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))


def pipeline_counters(runs: DataFrame, by: str) -> DataFrame:
    """read / written / failed per table from flagged rows (column ok)."""
    return runs.groupBy(by).agg(F.count("*").alias("n_read"), F.count_if(F.col("ok")).alias("n_written"), F.count_if(~F.col("ok")).alias("n_failed"))


def balance(counters: DataFrame) -> DataFrame:
    """Whether read = written + failed."""
    return counters.withColumn("balanced", F.col("n_read") == F.col("n_written") + F.col("n_failed"))


def status_totals(checkpoints: DataFrame, by: str) -> DataFrame:
    """Rows, errors and share of finished partitions of each operation."""
    return checkpoints.groupBy(by).agg(
        F.count("*").alias("n_partitions"),
        F.sum("rows_written").cast("bigint").alias("rows_written"),
        F.sum("error_count").cast("bigint").alias("errors"),
        F.round(F.count_if(F.col("status") == "Done") * 100.0 / F.count("*"), 4).alias("percent_done"),
    )


def throughput(df: DataFrame, ts: str, by: str) -> DataFrame:
    """Rows a second in each minute."""
    return df.groupBy(F.date_trunc("MINUTE", F.col(ts)).alias("minute"), by).agg(F.count("*").alias("n"), F.round(F.count("*") / 60.0, 6).alias("per_second"))


def latency_quantiles(df: DataFrame, value: str, by: str | None = None, accuracy: int = 10_000, exact: bool = False) -> DataFrame:
    """50 %, 95 % and 99 % quantiles.

    From a sketch whose rank error is at most 1 / accuracy of the rows, in bounded memory; exact: interpolated
    from a count for each distinct value.
    """
    points = "array(0.5, 0.95, 0.99)"
    q = F.expr(f"percentile({value}, {points})" if exact else f"percentile_approx({value}, {points}, {accuracy})").alias("q")
    out = df.groupBy(*([by] if by else [])).agg(q)
    return out.select(*([by] if by else []), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def latency_histogram(df: DataFrame, value: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts under each bound, in one aggregation of the table."""
    one = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select("x.le", "x.n")


def progress_eta(runs: DataFrame, ts: str, total: Column) -> DataFrame:
    """Rows so far, share of the total, rows a second and seconds still to go."""
    span = F.timestamp_diff("SECOND", F.min(ts), F.max(ts))
    a = runs.agg(F.count("*").alias("n_done"), span.alias("seconds"), total.alias("n_total"))
    rate = F.col("n_done") / F.greatest("seconds", F.lit(1))
    return a.select("n_done", "n_total", F.round(F.col("n_done") * 100.0 / F.col("n_total"), 4).alias("percent"), F.round(rate, 6).alias("per_second"), F.round((F.col("n_total") - F.col("n_done")) / rate, 4).alias("eta_seconds"))


def dlq_summary(letters: DataFrame) -> DataFrame:
    return letters.groupBy("table", "error").agg(F.count("*").alias("n"))
