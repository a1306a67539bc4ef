"""Conflict strategies, upserts and comparison of tables, as joins on keys and row hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import row_text
from ..session import token

#: Rows of a checkpoint table up to which it is broadcast, and tasks that share a partition beyond it.
SMALL = 100_000
SALT = 32


def plan_with_progress(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The plan with where to go on: the key after the last committed one, or the start."""
    cp = checkpoints.select("partition_id", "status", "last_committed")
    out = plan.join(cp, "partition_id", "left")
    return out.withColumn("resume_start", F.coalesce(F.col("last_committed") + 1, F.col("start"))).withColumn("status", F.coalesce("status", F.lit("Pending")))


def skip_done(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    return plan.join(checkpoints.filter("status = 'Done'").select("partition_id"), "partition_id", "left_anti")


def resume_filter(df: DataFrame, checkpoints: DataFrame, partition: str, key: str) -> DataFrame:
    """Rows strictly after their partition's last committed key; all rows of partitions without one.

    Checkpoints have one row for each partition of a plan. They are counted: up to SMALL of them are
    broadcast, so the table isn't shuffled; beyond that both sides meet by (partition, salt), as a
    partition of the table is large and must not be one task.
    """
    cp = checkpoints.select(F.col("partition_id").alias("_p"), F.col("last_committed").alias("_l"))
    after = F.col("_l").isNull() | (F.col(key) > F.col("_l"))
    if cp.limit(SMALL + 1).count() <= SMALL:
        return df.join(F.broadcast(cp), df[partition] == cp["_p"], "left").filter(after).drop("_p", "_l")
    salted = df.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int"))
    dealt = cp.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(dealt, (salted[partition] == dealt["_p"]) & (salted["_s"] == dealt["_t"]), "left").filter(after).drop("_p", "_l", "_s", "_t")


def conflict_skip(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target doesn't have."""
    return source.join(target.select(*keys), keys, "left_anti")


def conflict_error(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in the way of an append: in the target already, or more than once in the source."""
    there = source.join(target.select(*keys), keys, "left_semi").select(*keys).distinct().withColumn("reason", F.lit("in target"))
    twice = source.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n").withColumn("reason", F.lit("twice in source"))
    return there.unionByName(twice)


def single_version(source: DataFrame, keys: list[str]) -> DataFrame:
    """``source``, whose keys must be unique: a key that comes twice is an error when the rows are read."""
    rest = [c for c in source.columns if c not in keys]
    one = source.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*[F.lit(0).alias("_"), *rest])).alias("_r"))
    checked = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("several source rows for one key and no version: "), F.to_json(F.struct(*keys)))))
    one = one.withColumn("_r", checked)
    return one.select(*[F.col("_r")[c].alias(c) if c in rest else F.col(c) for c in source.columns])


def newest(source: DataFrame, keys: list[str], version: list[Column] | None) -> DataFrame:
    """One row of each key: the first by ``version``; without it a key that comes twice is an error when the rows are read."""
    from .windows import dedupe_latest

    return dedupe_latest(source, keys, version) if version else single_version(source, keys)


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], version: list[Column] | None = None) -> DataFrame:
    """Target rows without a replacement, and the source's; of several for a key the first by ``version``.

    Without ``version`` the source must have each key once, else reading the result is an error.
    """
    new = newest(source, keys, version)
    return target.join(source.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def row_hashes(df: DataFrame, columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's text, as decimals that can be added up without overflow."""
    text = row_text(df, columns)
    return tuple(h.cast("decimal(38,0)") for h in (F.xxhash64(text), F.xxhash64(F.lit("second"), text)))


def verify_rows(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], percent: float = 100.0) -> DataFrame:
    """Missing, extra and mismatched keys of a sample that is the same on both sides.

    Rows of a key are compared as a multiset: by their number and the sums of their hashes, which are
    added up before the shuffle. So a key may be null, or come many times. One aggregation, no join.
    """
    both = _side(source, keys, columns, percent, 1).unionByName(_side(target, keys, columns, percent, -1))
    each = both.groupBy(*keys).agg(F.count_if(F.col("_s") > 0).alias("_n"), F.count_if(F.col("_s") < 0).alias("_m"), F.sum(F.col("_a") * F.col("_s")).alias("_a"), F.sum(F.col("_b") * F.col("_s")).alias("_b"))
    differ = (F.col("_n") != F.col("_m")) | (F.col("_a") != 0) | (F.col("_b") != 0)
    verdict = F.when(F.col("_m") == 0, "missing").when(F.col("_n") == 0, "extra").when(differ, "mismatched")
    return each.withColumn("verdict", verdict).filter("verdict is not null").select(*keys, "verdict")


def _side(df: DataFrame, keys: list[str], columns: list[str], percent: float, sign: int) -> DataFrame:
    picked = sampled(df, keys, percent)
    a, b = row_hashes(picked, columns)
    return picked.select(*keys, F.lit(sign).alias("_s"), a.alias("_a"), b.alias("_b"))


def sampled(df: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """The rows whose key falls into a share of all keys; the same keys on every side."""
    return df if percent >= 100 else df.filter(F.pmod(token(*keys), F.lit(10_000)) < int(percent * 100))


def dlq_reconcile(letters: DataFrame, target: DataFrame, record: Column) -> DataFrame:
    """Failed records with whether the target has them by now."""
    there = target.select(record.alias("record_id")).distinct().withColumn("_in", F.lit(True))
    return letters.join(there, "record_id", "left").withColumn("resolved", F.col("_in").isNotNull()).drop("_in")
