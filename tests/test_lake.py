"""Lake tables: exclusive commits, pruning by bounds, copy on write."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quaystone.operators import joins
from quaystone.session import scratch
from quaystone.sources import lake, scans, sinks


def keys(df):
    return sorted(r["k"] for r in df.select("k").collect())


def frame(spark, a, b, v="x"):
    return spark.range(a, b).select(F.col("id").alias("k"), F.lit(v).alias("v"))


def test_one_snapshot_is_written_once(spark):
    root = scratch(spark)
    sinks.lake_append(frame(spark, 0, 5), root, 1)
    with pytest.raises(lake.CommitConflict):
        sinks.lake_append(frame(spark, 0, 5), root, 1)
    assert keys(scans.lake_snapshot_scan(spark, root)) == [0, 1, 2, 3, 4]
    assert lake.append(frame(spark, 5, 7), root) == 2 and keys(lake.scan(spark, root, 1)) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="no snapshot"):
        lake.scan(spark, root, 0)


def test_a_writer_that_is_late_at_the_commit_fails_or_goes_on(spark):
    root = scratch(spark)
    schema = frame(spark, 0, 1).schema
    first, second = lake.write_files(frame(spark, 0, 3), root), lake.write_files(frame(spark, 3, 5), root)
    lake.commit(spark, root, 1, "append", first, [], schema)
    with pytest.raises(lake.CommitConflict):
        lake.commit(spark, root, 1, "append", second, [], schema)
    assert keys(lake.scan(spark, root)) == [0, 1, 2]  # the files of the late one are no part of the table
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda i: lake.append(frame(spark, 10 * i, 10 * i + 2), root), range(1, 5)))
    assert sorted(numbers) == [2, 3, 4, 5] and len(keys(lake.scan(spark, root))) == 11
    assert not [n for n in os.listdir(f"{root}/commits".replace("file:", "")) if n.startswith("_")]


def test_scans_list_only_files_in_range(spark):
    root = scratch(spark)
    rows = frame(spark, 0, 1000).withColumn("t", F.concat(F.lit("t" * 40), F.col("k").cast("string"))).withColumn("d", F.when(F.col("k") < 990, F.col("k") / 2).otherwise(float("nan"))).withColumn("m", F.create_map("v", "k"))
    lake.append(rows.repartitionByRange(10, "k"), root)
    assert lake.files(spark, root).count() == 10 and lake.files(spark, root).agg(F.sum("n_rows")).first()[0] == 1000
    df = lake.scan(spark, root, ranges={"k": (205, 210)})
    assert keys(df) == list(range(205, 211)) and len(df.inputFiles()) == 1
    assert lake.scan(spark, root, ranges={"k": (5000, None)}).count() == 0
    assert lake.scan(spark, root, ranges={"d": (None, 10.0)}).count() == 21
    assert lake.scan(spark, root, ranges={"d": (499.0, None)}).count() == 10  # NaN is above all numbers
    assert lake.scan(spark, root, ranges={"t": ("t" * 40 + "5", "t" * 40 + "5")}).count() == 1
    sizes = lake.files(spark, root).select("path", "n_bytes").collect()
    assert all(os.path.getsize(f"{root}/{r['path']}".replace("file:", "")) == r["n_bytes"] for r in sizes)


def test_merge_rewrites_only_files_with_matching_rows(spark):
    root = scratch(spark)
    target = frame(spark, 0, 1000)
    lake.append(target.repartitionByRange(10, "k"), root)
    before = {r["path"] for r in lake.files(spark, root).collect()}
    source = spark.createDataFrame([(205, "new"), (207, "new"), (5000, "new")], "k bigint, v string")
    assert lake.merge(spark, root, source, ["k"]) == 2
    after = {r["path"] for r in lake.files(spark, root).collect()}
    assert len(before - after) == 1
    want = joins.merge_upsert(target, source, ["k"])
    got = lake.scan(spark, root)
    assert got.count() == want.count() == 1001 and got.exceptAll(want).count() == 0
    assert lake.scan(spark, root, 1).exceptAll(target).count() == 0  # the snapshot before still reads
    only_new = spark.createDataFrame([(7000, "z")], "k bigint, v string")
    lake.merge(spark, root, only_new, ["k"])
    assert after < {r["path"] for r in lake.files(spark, root).collect()}


def test_merge_after_another_writer_starts_again(spark, monkeypatch):
    root = scratch(spark)
    lake.append(frame(spark, 0, 10), root)
    real, calls = lake.commit, []

    def late(*args):
        if not calls:
            calls.append(1)
            real(spark, root, 2, "append", lake.write_files(frame(spark, 10, 12), root), [], frame(spark, 0, 1).schema)
        return real(*args)

    monkeypatch.setattr(lake, "commit", late)
    assert lake.merge(spark, root, frame(spark, 9, 11, "new"), ["k"]) == 3
    got = {r["k"]: r["v"] for r in lake.scan(spark, root).collect()}
    assert len(got) == lake.scan(spark, root).count() == 12 and {k for k, v in got.items() if v == "new"} == {9, 10}


def test_merge_by_version_and_composite_keys(spark):
    root, kinds = scratch(spark), "k bigint, s string, n int"
    lake.append(spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "a", 0)], kinds), root)
    source = spark.createDataFrame([(1, "b", 1), (1, "b", 2), (3, "c", 1)], kinds)
    with pytest.raises(Exception, match="several source rows"):
        lake.merge(spark, root, source, ["k", "s"])
    lake.merge(spark, root, source, ["k", "s"], [F.desc("n")])
    assert sorted(tuple(r) for r in lake.scan(spark, root).collect()) == [(1, "a", 0), (1, "b", 2), (2, "a", 0), (3, "c", 1)]
    lake.merge(spark, root, source.limit(0), ["k", "s"])
    assert lake.scan(spark, root).count() == 4
