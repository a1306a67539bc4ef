"""Range hashes against the comparison of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from quaystone.operators import jobs, joins, rangehash as rh

SCHEMA = "k bigint, s string, v double"


def verdicts(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def changed(rows, r, share):
    out = []
    for k, s, v in rows:
        x = r.random()
        if x < share / 3:
            continue
        out.append((k, s, v + 1 if x < share * 2 / 3 else v))
        if x > 1 - share / 3:
            out.append((k, s, v))
    return out


@pytest.mark.parametrize("keys", [["k"], ["s"], ["k", "s"]])
@pytest.mark.parametrize("share,stretch", [(0.01, None), (0.5, None), (0.0, None), (1.0, (300, 310))])
def test_same_verdicts_as_row_by_row(spark, keys, share, stretch):
    r = random.Random(1)
    rows = [(r.choice([None, i]) if i % 97 == 0 else i * 3, f"s{i % 700}", i / 7) for i in range(1500)]
    other = changed(rows, r, share) if stretch is None else rows[: stretch[0]] + rows[stretch[1] :]
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA)
    c = rh.compare(a, b, keys, a.columns, fanout=8, few=20)
    assert verdicts(c.rows) == verdicts(joins.verify_rows(a, b, keys, a.columns))
    assert (c.source_rows, c.target_rows, c.equal) == (len(rows), len(other), rows == other)


def test_only_differing_ranges_are_read_on(spark):
    a = spark.range(100_000).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.lit(1.0).alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 77_777, 2.0).otherwise(F.col("v")))
    c = rh.compare(a, b, ["k"], a.columns, fanout=10, few=50)
    assert [x.rows for x in c.levels] == [200_000, 20_000, 2_000, 200] and c.levels[-1].rows_left == 20
    assert verdicts(c.rows) == [(77_777, "mismatched")]
    same = rh.compare(a, a, ["k"], a.columns)
    assert len(same.levels) == 1 and same.equal and same.rows.count() == 0


def test_equal_tables_are_not_joined_and_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        read.add(1)
        return v

    a = spark.range(1000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v")).withColumn("v", seen("v"))
    out = jobs.verify_migration(a, a, ["k"], ["k", "v"], 100.0)
    assert read.value == 2000 and "Join" not in out._jdf.queryExecution().toString()
    assert out.first().asDict() == {"source_rows": 1000, "target_rows": 1000, "n_missing": 0, "n_extra": 0, "n_mismatched": 0, "equal": True}


def test_keys_at_the_ends_of_their_type(spark):
    rows = [(-(2**63), "a", 1.0), (2**63 - 1, "b", 2.0), (0, "c", 3.0), (None, "d", 4.0)]
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[1:], SCHEMA)
    assert verdicts(rh.compare(a, b, ["k"], a.columns, fanout=4, few=0).rows) == [(-(2**63), "missing")]
    none = a.limit(0)
    assert rh.compare(none, none, ["k"], a.columns).equal
    assert len(verdicts(rh.compare(a, none, ["k"], a.columns).rows)) == 4


def test_samples_agree(spark):
    a = spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("s"), F.lit(1.0).alias("v"))
    b = a.filter("k % 7 <> 0")
    c = rh.compare(a, b, ["k"], a.columns, 10.0)
    assert verdicts(c.rows) == verdicts(joins.verify_rows(a, b, ["k"], a.columns, 10.0)) and 0 < c.source_rows < 1000
