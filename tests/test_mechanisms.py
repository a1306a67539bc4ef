"""Range sources, plans by bytes, nested schemas, strict coercion, state folding, stream rates, functions as transforms."""

import json
import os
import random
import shutil
import sqlite3

import pytest
from pyspark.sql import functions as F

from quaystone.functions import transforms as tr
from quaystone.operators import jobs, joins, schemas, windows
from quaystone.plans import partitions as pl
from quaystone.session import scratch
from quaystone.sources import scans, sinks
from quaystone.sources.ranges import Connect, KeyRange, RangeTable, SqlFetch, planned
from quaystone.streaming import streams


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "store")
    c = sqlite3.connect(path)
    c.execute("create table docs (id integer, body text)")
    c.executemany("insert into docs values (?, ?)", [(i, json.dumps({"v": i})) for i in range(100)])
    c.commit()
    return SqlFetch(Connect("sqlite3", path, timeout=60), "docs", "id")


PLAN = [KeyRange("p0", None, 25), KeyRange("p1", 25, 50), KeyRange("p2", 50, 75), KeyRange("p3", 75, None)]


@pytest.mark.parametrize(("condition", "tasks", "rows"), [("id >= 60 and id < 70", 1, 10), ("id = 30", 1, 1), ("id in (3, 80, 500)", 2, 2), ("id > 24 and id <= 50", 2, 26), ("id > 1000 and id < 900", 1, 0), ("body like '%v%'", 4, 100), ("id < 25", 1, 25)])
def test_filters_read_fewer_partitions(spark, store, condition, tasks, rows):
    df = RangeTable(spark, store, "id bigint, body string", "id", PLAN).where(condition)
    assert df.rdd.getNumPartitions() == tasks and df.count() == rows


def test_ranges_resume_after_the_committed_key(spark, store):
    df = RangeTable(spark, store, "id bigint, body string", "id", PLAN).read()
    assert df.count() == 100 and df.rdd.getNumPartitions() == 4
    plan = spark.createDataFrame([("p0", 0, 50), ("p1", 50, 100), ("p2", 100, 200)], "partition_id string, start bigint, `end` bigint")
    state = spark.createDataFrame([("p0", "Done", 49), ("p1", "InProgress", 89)], "partition_id string, status string, last_committed bigint")
    rest = RangeTable(spark, store, "id bigint, body string", "id", planned(joins.plan_with_progress(plan, state))).read()
    assert sorted(r["id"] for r in rest.collect()) == list(range(90, 100))


def test_ranges_of_text_and_of_expressions(spark, store):
    by_text = SqlFetch(store.connect, "docs", "body")
    texts = RangeTable(spark, by_text, "id bigint, body string", "body", [KeyRange("a", None, '{"v": 5'), KeyRange("b", '{"v": 5', None)])
    one = texts.where("""body = '{"v": 7}'""")
    assert one.count() == 1 and one.rdd.getNumPartitions() == 1 and texts.read().count() == 100
    token = SqlFetch(store.connect, "docs", "(id * 37) % 101")
    halves = RangeTable(spark, token, "id bigint", "token", [KeyRange("a", 0, 50), KeyRange("b", 50, 101)]).read()
    assert sorted(r["id"] for r in halves.collect()) == list(range(100))


def cuts_by_hand(rows, n, smallest):
    sizes = {}
    for k, b in rows:
        sizes[k] = sizes.get(k, 0) + b
    total = sum(sizes.values())
    target = -(-max(smallest, -(-total // n)) // smallest) * smallest
    cuts, done = [], 0
    for k in sorted(sizes):
        if any(done < m <= done + sizes[k] for m in range(target, total, target)):
            cuts.append(k + 1)
        done += sizes[k]
    return [c for c in cuts if c <= max(sizes)], target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranges_by_bytes(spark, seed, monkeypatch):
    monkeypatch.setattr(pl, "CELLS", 16)
    r = random.Random(seed)
    rows = [(r.choice([r.randint(-1000, 1000), 10**12 + r.randint(0, 5), 7]), r.choice([0, 1, 10, 5000])) for _ in range(800)]
    df = spark.createDataFrame([*rows, (None, 9)], "k bigint, b bigint")
    cuts, target = cuts_by_hand(rows, 6, 100)
    plan = pl.plan_byte_ranges(df, "k", 6, F.col("b"), error=0, smallest=100).collect()
    assert [p["end"] for p in plan] == [*cuts, None] and [p["start"] for p in plan] == [None, *cuts]
    near = [p["end"] for p in pl.plan_byte_ranges(df, "k", 6, F.col("b"), error=0.05, smallest=100).collect()][:-1]
    sums = [sum(b for k, b in rows if k < c) for c in near]
    for c in near:
        assert min(abs(sum(b for k, b in rows if k < c) - sum(b for k, b in rows if k < x)) for x in cuts) <= 0.05 * target
    assert sums == sorted(sums)


def test_small_tables_have_one_range(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(100).alias("b"))
    assert [tuple(r) for r in pl.plan_byte_ranges(df, "k", 8, F.col("b")).collect()] == [("p0", None, None)]
    assert pl.plan_byte_ranges(df.limit(0), "k", 8, F.col("b")).count() == 1
    assert pl.plan_byte_ranges(df, "k", 8, F.col("b"), smallest=10_000).count() == 5  # two units of 10,000 bytes each


DOCS = ['{"a": 1, "b": {"c": "x", "d": [1, "y", {"e": null}]}}', '{"a": "t", "b": {"c": "z"}}', '{"a": null, "]{": "}"}', "5", None, "bad"]


def test_nested_schema(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "k int, d string")
    got = {r["path"]: (r["n"], r["kinds"], r["conflict"]) for r in schemas.infer_nested_schema(df, "d").collect()}
    assert got == {
        "a": (3, "BIGINT,STRING,VOID", True),
        "b": (2, "OBJECT", False),
        "b.c": (2, "STRING", False),
        "b.d": (1, "ARRAY", False),
        "b.d[]": (3, "BIGINT,OBJECT,STRING", True),
        "b.d[].e": (1, "VOID", False),
        "]{": (1, "STRING", False),
    }
    assert schemas.infer_nested_schema(df.limit(0), "d").count() == 0


def test_type_deviation(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)], "k int, d string")
    want = {"a": "BIGINT", "b": "OBJECT", "b.c": "STRING"}
    got = {r["k"]: (r["missing"], r["extra"], r["mistyped"]) for r in schemas.type_deviation(df, "k", "d", want).collect()}
    assert got[0] == ("", "b.d,b.d[],b.d[].e", "") and got[1] == ("", "", "a:STRING") and got[2] == ("b,b.c", "]{", "")
    assert got[3] == got[4] == got[5] == ("a,b,b.c", "", "")


def test_strict_coercion(spark):
    df = spark.createDataFrame([("t", 5, "12", "2020-01-01", 2.7, True)], "a string, b int, c string, d string, e double, f boolean")
    row = schemas.coerce_to_schema(df, {"a": "bool", "b": "bool", "c": "int64", "d": "timestamp", "e": "int64", "f": "string"}).first()
    assert row[:6] == (None, None, None, None, 2, "true") and row["_errors"] == ["a: not bool", "b: not bool", "c: not int64", "d: not timestamp"]
    loose = schemas.coerce_to_schema(df, {"c": "int64"}, strict=False).first()
    assert loose["c"] == 12 and loose["_errors"] == []


def test_functions_as_transforms(spark):
    def halved(v):
        if v % 2:
            raise ValueError(f"{v} is odd")
        return v // 2

    tr.register_function("halved", halved, "bigint")
    df = spark.createDataFrame([(1, 4), (2, 7), (3, None)], "k int, x bigint")
    r = tr.converted("halved", "x")
    assert {x["k"]: (x["v"], x["e"]) for x in df.select("k", r["value"].alias("v"), r["error"].alias("e")).collect()} == {1: (2, None), 2: (None, "halved failed for x: ValueError: 7 is odd"), 3: (None, None)}
    assert [x["y"] for x in tr.map_columns(df, {"x": ("y", "halved")}).orderBy("k").collect()] == [2, None, None]
    tr.register_function("wrong", lambda v: "text", "bigint")
    assert df.select(tr.converted("wrong", "x")["error"].alias("e")).filter("e is not null").count() == 2
    bad = df.withColumn("_errors", F.array_compact(F.array(r["error"])))
    good, refused = schemas.split_bad(bad)
    assert good.count() == 2 and refused.count() == 1


def test_latest_of_rows_with_maps(spark):
    df = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2}), (1, 2, {"c": 3}), (None, 1, None)], "k int, v int, m map<string,int>")
    got = {r["k"]: r["m"] for r in windows.latest_by(df, ["k"], ["v"]).collect()}
    assert got[None] is None and got[1] in ({"b": 2}, {"c": 3})
    again = {r["k"]: r["m"] for r in windows.latest_by(df.orderBy(F.rand(1)), ["k"], ["v"]).collect()}
    assert again == got


def test_profiles_of_maps_and_of_nearly_unique_columns(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.greatest(F.col("id"), F.lit(199)).alias("near"), F.create_map(F.lit("a"), F.col("id") % 3).alias("m"))
    got = {r["column"]: r for r in schemas.profile_columns(df).collect()}
    assert got["k"]["is_unique"] and not got["near"]["is_unique"]
    assert (got["m"]["n_distinct"], got["m"]["low"], got["m"]["is_unique"]) == (3, None, False)


def test_a_backup_whose_folder_is_gone(spark, small):
    root = scratch(spark)
    jobs.backup(spark.read.parquet(f"{small}/nation.parquet"), root, "b", "nation", "n_nationkey", 2)
    shutil.rmtree(f"{root}/b/chunks".replace("file:", ""))
    assert {r["verdict"] for r in jobs.verify_backup(spark, root, "b").collect()} == {"MISSING"}


def state_row(spark, operation, partition, n):
    return spark.createDataFrame([(operation, partition, "InProgress", n, n, 0)], "operation_id string, partition_id string, status string, last_committed bigint, rows_written bigint, error_count bigint").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(n)))


def test_many_states_leave_few_files(spark):
    path = scratch(spark)
    for n in range(30):
        sinks.checkpoint_write(state_row(spark, "op", f"p{n % 3}", n), path, fold_at=5)
        latest = {r["partition_id"]: r["last_committed"] for r in scans.checkpoint_scan(spark, path, "op").collect()}
        assert latest == {f"p{i}": max(x for x in range(n + 1) if x % 3 == i) for i in range(min(3, n + 1))}
    names = [n for n in os.listdir(path.replace("file:", "")) if n.endswith(".json") and not n.startswith(("_", "."))]
    assert len(names) <= 10


def test_a_reader_during_a_fold_sees_one_whole_state(spark):
    path = scratch(spark)
    for n in range(6):
        sinks.checkpoint_write(state_row(spark, "op", f"p{n % 2}", n), path)
    listed = scans.checkpoint_scan(spark, path, "op")  # has its list of files
    listed.inputFiles()
    sinks.fold_state(spark, path)
    assert {r["last_committed"] for r in listed.collect()} == {4, 5}
    assert {r["last_committed"] for r in scans.checkpoint_scan(spark, path, "op").collect()} == {4, 5}


def test_states_of_dropped_operations_are_deleted(spark):
    path = scratch(spark)
    for op in ("a", "b", "c"):
        sinks.checkpoint_write(state_row(spark, op, "p0", 1), path)
    sinks.fold_state(spark, path, spark.createDataFrame([("b",)], "operation_id string"))
    assert {r["operation_id"] for r in scans.checkpoint_scan(spark, path).collect()} == {"b"}


def test_streams_keep_to_their_rate(spark):
    path, target, state = scratch(spark), scratch(spark), scratch(spark)
    df = spark.createDataFrame([(i, i, "s", {"m": i}) for i in range(120)], "k int, batch int, stream string, m map<string,int>")
    df.repartition(6).write.parquet(path)
    size = max(os.path.getsize(f"{path}/{n}".replace("file:", "")) for n in os.listdir(path.replace("file:", "")) if n.startswith("part"))
    batches = streams.stream_migrate(streams.file_stream(spark, path, df.schema, bytes_per_trigger=2 * size), target, state, rows_per_second=30)
    assert sum(n for _, n, _ in batches) == 120 and len(batches) >= 3 and max(n for _, n, _ in batches) <= 60
    assert all(s >= n / 30 for _, n, s in batches)
    got = streams.stream_target(spark, target, ["k"], ["batch"])
    assert sorted(got.columns) == sorted(df.columns) and got.count() == 120
    assert streams.stream_migrate(streams.file_stream(spark, path, df.schema), target, state, interval=0.5, seconds=3) == []


def test_stream_counts_with_checks(spark):
    path, target, bad = scratch(spark), scratch(spark), scratch(spark)
    df = spark.createDataFrame([(i, i % 4) for i in range(40)], "k int, v int")
    df.coalesce(1).write.parquet(path)
    batches = streams.stream_migrate(streams.file_stream(spark, path, df.schema), target, scratch(spark), {"v": F.col("v") > 0}, bad)
    assert [n for _, n, _ in batches] == [40]
    assert streams.stream_rows(spark, target).count() == 30 and streams.stream_rows(spark, bad).count() == 10
