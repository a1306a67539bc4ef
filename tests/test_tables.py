"""Literal values and properties: identity, resume, tampering, balance."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quaystone import queries
from quaystone.functions import transforms as tr
from quaystone.operators import aggregates, joins, schemas, windows
from quaystone.operators import jobs
from quaystone.operators.windows import latest_by
from quaystone.plans import partitions as pl
from quaystone.session import scratch
from quaystone.sources import scans
from quaystone.streaming import streams


def one(spark, kind, value, column):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "value", "expected"),
    [
        ("none", "hello", "hello"),
        ("to_json_string", "val", '"val"'),
        ("to_json_string", 'a"b', '"a\\"b"'),
        ("to_json_string", None, "null"),
        ("to_upper", "hello world", "HELLO WORLD"),
        ("to_lower", "HELLO WORLD", "hello world"),
        ("to_unix_ms", "2025-01-01T00:00:00Z", 1735689600000),
        ("uuid_to_string", "550e8400-e29b-41d4-a716-446655440000", "550e8400-e29b-41d4-a716-446655440000"),
        ("string_to_uuid", "550e8400-e29b-41d4-a716-446655440000", "550e8400-e29b-41d4-a716-446655440000"),
        ("string_to_uuid", "not-a-uuid", None),
    ],
)
def test_transform_literals(spark, name, value, expected):
    assert one(spark, "string", value, tr.transform(name, F.col("x"))) == expected


def test_json_of_nested_values(spark):
    assert one(spark, "map<string,int>", {"key": 1}, tr.transform("to_json_string", F.col("x"))) == '{"key":1}'
    assert one(spark, "array<int>", [1, None], tr.transform("to_json_string", F.col("x"))) == "[1,null]"
    assert one(spark, "bigint", 5, tr.transform("to_json_string", F.col("x"))) == "5"


def test_from_unix_ms(spark):
    assert str(one(spark, "bigint", 1735689600000, F.date_format(tr.transform("from_unix_ms", F.col("x")), "yyyy-MM-dd HH:mm:ss"))) == "2025-01-01 00:00:00"


def test_from_json(spark):
    assert one(spark, "string", '{"foo":"bar"}', F.try_variant_get(tr.transform("from_json_string", F.col("x")), "$.foo", "string")) == "bar"
    assert one(spark, "string", "{", tr.converted("from_json_string", "x")["error"]) == "from_json_string failed for x"


def test_unknown_names():
    with pytest.raises(ValueError, match="unknown transform"):
        tr.transform("does_not_exist", F.lit(1))
    with pytest.raises(ValueError, match="unknown mask"):
        tr.mask("does_not_exist", F.lit(1))


def test_own_transform(spark):
    tr.register_transform("twice", lambda c: F.concat(c, c))
    assert one(spark, "string", "ab", tr.transform("twice", F.col("x"))) == "abab"


@pytest.mark.parametrize(("name", "value", "expected"), [("sha256", "a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("redact", "abc", "[REDACTED]"), ("redact", None, "[REDACTED]"), ("partial", "abcdef", "****cdef"), ("partial", "abcd", "****"), ("partial", None, None), ("sha256", None, None)])
def test_masks(spark, name, value, expected):
    assert one(spark, "string", value, tr.mask(name, F.col("x"))) == expected


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": {"c": "deep"}}, "x": 42}')], "id int, d string")
    r = tr.flatten_json(df, "d", "a struct<b struct<c string>>, x int").first().asDict()
    assert r == {"id": 1, "a.b.c": "deep", "x": 42}
    assert {(r["path"], r["value"]) for r in tr.flatten_unknown(df, "id", "d").collect()} == {("a.b.c", "deep"), ("x", "42")}


def test_flatten_any_depth(spark):
    deep = "1"
    for i in range(14):
        deep = f'{{"l{i}": {deep}, "s{i}": "}}{{"}}'
    rows = [(1, deep), (2, "5"), (3, "{}"), (4, None), (5, "no json"), (6, '{"a": {}, "b": [1, {"c": 2}], "d.e": null}')]
    got = {(r["id"], r["path"]): r["value"] for r in tr.flatten_unknown(spark.createDataFrame(rows, "id int, d string"), "id", "d").collect()}
    assert got[1, ".".join(f"l{i}" for i in reversed(range(14)))] == "1" and got[1, "s13"] == "}{"
    assert sum(k == 1 for k, _ in got) == 15
    assert {x: v for x, v in got.items() if x[0] > 1} == {(6, "b"): '[1,{"c":2}]', (6, "d.e"): None}
    assert tr.flatten_unknown(spark.createDataFrame([], "id int, d string"), "id", "d").count() == 0


ROWS = "k int, d double, t timestamp_ntz, a string, b string, m map<string,int>, x binary"


def test_row_hashes_tell_rows_apart(spark):
    from datetime import datetime

    base = (1, 0.001, datetime(2020, 1, 1, 0, 0, 0, 100000), "a|b", "c", {"p": 1, "q": 2}, b"\x00")
    changed = [(0, 2), (1, 0.004), (1, float("nan")), (1, None), (1, float("inf")), (2, datetime(2020, 1, 1, 0, 0, 0, 900000)), (3, "a"), (3, None), (3, "N"), (4, ""), (4, None), (5, {"p": 1}), (5, None), (6, b"\x01")]
    rows = [base] + [tuple(v if i == at else x for i, x in enumerate(base)) for at, v in changed] + [base[:3] + ("a", "b|c") + base[5:]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ROWS}")
    columns = [c for c in df.columns if c != "i"]
    assert df.select(tr.record_checksum(df, columns).alias("h")).distinct().count() == len(rows)
    assert {r["h"] for r in df.select(tr.record_checksum(df, columns).alias("h")).collect()} == {r["h"] for r in df.select(tr.record_checksum(df, columns[::-1]).alias("h")).collect()}
    same = spark.createDataFrame([(0.0, {"p": 1, "q": 2}), (-0.0, {"q": 2, "p": 1})], "d double, m map<string,int>")
    assert same.select(tr.record_checksum(same).alias("h")).distinct().count() == 1
    assert df.select(tr.record_checksum(df, columns, cents=True).alias("h")).filter("h is null").count() == 0  # NaN and infinity included


def test_verification_sees_small_changes(spark):
    s = spark.createDataFrame([(1, 0.001, "a|b", "c"), (2, float("nan"), "x", None), (3, 1.0, "y", "z")], "k int, d double, a string, b string")
    t = spark.createDataFrame([(1, 0.004, "a", "b|c"), (2, float("nan"), "x", None), (3, 1.0, "y", None)], s.schema)
    assert {(r["k"], r["verdict"]) for r in joins.verify_rows(s, t, ["k"], s.columns).collect()} == {(1, "mismatched"), (3, "mismatched")}
    r = jobs.verify_migration(s, t, ["k"], s.columns, 100.0).first()
    assert (r["n_mismatched"], r["equal"]) == (2, False)
    assert jobs.verify_migration(s, s, ["k"], s.columns, 100.0).first()["equal"]
    assert aggregates.table_checksum(s).first()["checksum"] != aggregates.table_checksum(t).first()["checksum"]


def test_uuid_columns(spark):
    df = spark.createDataFrame([(bytes(range(16)), b"\x01", "s"), (None, None, None)], "u binary, v binary, t string")
    assert [tuple(r) for r in tr.normalize_uuids(df).collect()] == [("00010203-0405-0607-0809-0a0b0c0d0e0f", "01", "s"), (None, None, None)]
    assert dict(tr.normalize_uuids(df, ["u"]).dtypes)["v"] == "binary"


@pytest.mark.parametrize(("keys", "n", "ranges"), [([], 4, []), ([7, 7], 4, [(7, 8)]), ([0, 9], 0, [(0, 10)]), ([0, 1], 4, [(0, 1), (1, 2), (2, 3), (3, 2)]), (list(range(10)), 3, [(0, 3), (3, 6), (6, 10)])])
def test_key_ranges(spark, keys, n, ranges):
    plan = pl.plan_key_ranges(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k", n)
    assert [(r["start"], r["end"]) for r in plan.orderBy("partition_id").collect()] == ranges


def test_lake_type_map(spark):
    cols = spark.createDataFrame([("long",), ("string",), ("boolean",), ("double",), ("timestamptz",), ("decimal(10, 2)",), ("decimal",), ("list<int>",), ("odd",)], "type string")
    assert {r["type"]: r["canonical"] for r in schemas.canonical_types(cols, "iceberg").collect()} == {"long": "int64", "string": "string", "boolean": "bool", "double": "float64", "timestamptz": "timestamp", "decimal(10, 2)": "float64", "decimal": "float64", "list<int>": "array", "odd": "string"}
    words = spark.createDataFrame([("double precision",), ("timestamp with time zone",), ("int4",)], "type string")
    assert {r["type"]: r["canonical"] for r in schemas.canonical_types(words, "postgres").collect()} == {"double precision": "float64", "timestamp with time zone": "timestamp", "int4": "int64"}


def test_coercion_keeps_nulls_apart_from_errors(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, n string")
    good, bad = schemas.split_bad(schemas.coerce_to_schema(df, {"n": "int64"}, strict=False))
    assert sorted(tuple(r) for r in good.collect()) == [(1, 5), (3, None)]
    assert [r["id"] for r in bad.collect()] == [2]


def test_coercion_of_micros_and_nested_values(spark):
    df = spark.createDataFrame([(1735689600000001, {"a": 1}, [1, 2], "5", 1), (1 << 62, None, None, "x", None), (None, {}, [], None, 2)], "t bigint, m map<string,int>, l array<int>, n string, j int")
    out = schemas.coerce_to_schema(df, {"t": "timestamp", "m": "map", "l": "array", "n": "array", "j": "map"})
    got = [(str(r["t"]) if r["t"] else None, r["m"], r["l"], r["n"], r["j"], list(r["_errors"])) for r in out.collect()]
    assert got == [("2025-01-01 00:00:00.000001", '{"a":1}', "[1,2]", "5", "1", []), (None, None, None, "x", None, ["t: not timestamp"]), (None, "{}", "[]", None, "2", [])]
    wrong = schemas.coerce_to_schema(df, {"m": "int64", "l": "timestamp"})
    assert [list(r["_errors"]) for r in wrong.collect()] == [["m: not int64", "l: not timestamp"], [], ["m: not int64", "l: not timestamp"]]


def test_fields_of_documents(spark):
    df = spark.createDataFrame([('{"d.e": 1, "f\'g": "x"}',), ('{"d.e": true}',), ("[1]",), (None,), ("bad",)], "d string")
    assert {tuple(r) for r in schemas.infer_document_schema(df, "d").collect()} == {("d.e", 2, "BIGINT,BOOLEAN"), ("f'g", 1, "STRING")}


def test_estimates_stay_near_exact_figures(spark):
    df = spark.range(0, 20_000).select(F.col("id").alias("k"), (F.col("id") % 100).alias("v"), F.lit(1).alias("one"))
    near, exact = ({r["column"]: r for r in schemas.profile_columns(df, e).collect()} for e in (False, True))
    assert [exact[c]["n_distinct"] for c in ("k", "v", "one")] == [20_000, 100, 1]
    assert all(abs(near[c]["n_distinct"] - exact[c]["n_distinct"]) <= 0.05 * exact[c]["n_distinct"] and near[c]["is_unique"] == exact[c]["is_unique"] for c in exact)
    sizes = pl.plan_equal_size_ranges(df, "k", 4).select((F.col("end") - F.col("start")).alias("n")).collect()
    assert len(sizes) == 4 and all(abs(r["n"] - 5000) < 50 for r in sizes)
    q = aggregates.latency_quantiles(df, "k").first()
    assert abs(q["p50"] - 10_000) < 20 and abs(q["p99"] - 19_800) < 20


def test_keys_without_value_have_no_range(spark):
    df = spark.createDataFrame([(None,), (0,), (9,), (25,)], "k bigint")
    assert {(r["k"], r["partition_id"]) for r in pl.assign_partition(df, "k", 3, 0, 9).collect()} == {(None, None), (0, 0), (9, 2), (25, 2)}


@pytest.mark.parametrize("small", [100_000, 0])
def test_resume_after_committed_keys(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "SMALL", small)
    df = spark.createDataFrame([("p0", 1), ("p0", 2), ("p1", 5), ("p2", 7), (None, 8)], "p string, k int")
    cp = spark.createDataFrame([("p0", 1), ("p1", 5), ("p9", 3)], "partition_id string, last_committed bigint")
    assert {tuple(r) for r in joins.resume_filter(df, cp, "p", "k").collect()} == {("p0", 2), ("p2", 7), (None, 8)}


def test_upsert_needs_one_version(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in joins.merge_upsert(t, s, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    with pytest.raises(Exception, match="several source rows"):
        joins.merge_upsert(t, s.union(s), ["k"]).collect()


def test_chunks_begin_anew(spark):
    rows = [("a", i, 400) for i in range(4)] + [("b", 0, 900), ("b", 1, 10), ("b", 2, None), (None, 0, 500), (None, 1, 1)]
    df = spark.createDataFrame(rows, "p string, i int, size int")
    got = {(r["p"], r["i"]): r["chunk_id"] for r in windows.chunk_rows(df, "p", ["i"], F.col("size"), 500).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("b", 0): 0, ("b", 1): 1, ("b", 2): 1, (None, 0): 0, (None, 1): 1}
    assert windows.chunk_rows(df.limit(0), "p", ["i"], F.col("size"), 500).count() == 0


def test_a_failed_run_leaves_its_finished_ranges(spark):
    df = spark.createDataFrame([(i, i) for i in range(800)], "k bigint, v int")
    root = scratch(spark)
    faulty = df.withColumn("v", F.when(F.col("k") == 700, F.raise_error(F.lit("row 700"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="row 700"):
        jobs.migrate(faulty, root, "op", "k", 8, group=2)
    first = {r["partition_id"]: r["updated_at"] for r in jobs.status(spark, root, "op").collect()}
    assert sorted(first) == [f"p{i}" for i in range(6)]
    assert jobs.migrated(spark, root, df.schema).count() == 594  # six ranges of 99 keys
    target = jobs.migrate(df, root, "op", "k", 8, group=2)
    assert target.count() == 800 and target.select("k").distinct().count() == 800
    second = {r["partition_id"]: r["updated_at"] for r in jobs.status(spark, root, "op").collect()}
    assert len(second) == 8 and all(second[p] == t for p, t in first.items())


def test_moved_bounds_lose_no_rows(spark):
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    root = scratch(spark)
    assert jobs.migrate(rows(0, 800), root, "op", "k", 8, units=4).count() == 396
    target = jobs.migrate(rows(-250, 1600), root, "op", "k", 8)
    assert target.count() == 1850 and target.select("k").distinct().count() == 1850
    assert jobs.migrate(rows(-250, 1600), root, "op", "k", 8).count() == 1850
    assert jobs.migrate(rows(-250, 1601), root, "op", "k", 8).count() == 1851
    ids = [r["partition_id"] for r in jobs.status(spark, root, "op").collect()]
    assert len(ids) == len(set(ids))


def test_rows_without_key_stay_behind(spark):
    df = spark.createDataFrame([(None, "n"), (1, "a"), (5, "b")], "k bigint, v string")
    assert {r["v"] for r in jobs.migrate(df, scratch(spark), "op", "k", 2).collect()} == {"a", "b"}


def test_replay_of_nothing(spark):
    path = scratch(spark)
    spark.createDataFrame([], scans.LETTER).write.json(path)
    assert jobs.replay(spark, path, "a int", lambda df: df, {}, F.lit("x"), scratch(spark)).count() == 0


def test_chunks_end_by_bytes(spark, small):
    c = spark.read.parquet(f"{small}/customer.parquet")
    for kind in ("parquet", "ndjson"):
        root = scratch(spark)
        jobs.backup(c, root, "b", "customer", "c_custkey", 1, kind=kind, chunk_bytes=4000)
        m = scans.manifest_scan(spark, root)
        assert m.count() > 3 and m.agg(F.sum("row_count")).first()[0] == c.count()
        assert jobs.restore(spark, root, "b").count() == c.count()


def test_hashes_in_blocks_are_those_of_whole_files(spark, small):
    files = [f"{small}/customer.parquet"]
    assert scans.chunk_checksums(spark, files).collect() == scans.chunk_checksums(spark, files, 0).collect()


def test_expired_backups_leave_tombstones(spark, small):
    c, root = spark.read.parquet(f"{small}/nation.parquet"), scratch(spark)
    for name in ("b1", "b2"):
        jobs.backup(c, root, name, "nation", "n_nationkey", 1)
    assert jobs.delete_backups(spark, root, ["b1", "unknown"]) == ["b1"] and jobs.delete_backups(spark, root, ["b1"]) == []
    folder = f"{root}/b1".replace("file:", "")
    assert [f for f in os.listdir(folder) if not f.startswith(".")] == ["tombstone.json"]
    assert jobs.restore(spark, root, "b2").count() == c.count()


def test_resume_writes_each_row_once(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet").limit(1000)
    orders = spark.createDataFrame(orders.collect(), orders.schema)
    root = scratch(spark)
    half = jobs.migrate(orders, root, "op", "o_orderkey", 10, units=5).count()
    assert 0 < half < 1000
    target = jobs.migrate(orders, root, "op", "o_orderkey", 10)
    assert target.count() == 1000 and target.select("o_orderkey").distinct().count() == 1000
    assert {r["status"] for r in jobs.status(spark, root, "op").collect()} == {"Done"}
    assert jobs.migrate(orders, root, "op", "o_orderkey", 10).count() == 1000


def test_failed_rows_are_letters(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "k bigint, v int")
    root = scratch(spark)
    good = jobs.migrate(df, root, "op", "k", 3, checks={"v": F.col("v") > 0})
    bad = spark.read.schema("record_id string, error string").option("recursiveFileLookup", "true").json(f"{root}/failed")
    assert good.count() == 20 and bad.count() == 10
    assert sum(r["error_count"] for r in jobs.status(spark, root, "op").collect()) == 10


def test_units_without_good_rows(spark):
    root = scratch(spark)
    df = spark.createDataFrame([(i, 0) for i in range(10)], "k bigint, v int")
    assert jobs.migrate(df, root, "op", "k", 2, checks={"v": F.col("v") > 0}).count() == 0
    assert [(r["rows_written"], r["error_count"]) for r in jobs.status(spark, root, "op").collect()] == [(0, 4), (0, 6)]  # the step is 9 div 2
    assert jobs.migrate(df.limit(0), scratch(spark), "op", "k", 2).count() == 0


def test_backup_and_tampering(spark, small):
    c = spark.read.parquet(f"{small}/customer.parquet")
    root = scratch(spark)
    jobs.backup(c, root, "b", "customer", "c_custkey", 3, 1000)
    assert jobs.restore(spark, root, "b").exceptAll(c).count() == 0
    folder = f"{root}/b/chunks".replace("file:", "")
    chunk = next(f for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    with open(f"{folder}/{chunk}", "r+b") as f:
        f.seek(10)
        f.write(b"zz")
    os.remove(f"{folder}/.{chunk}.crc")
    assert {r["verdict"] for r in jobs.verify_backup(spark, root, "b").collect()} == {"OK", "CORRUPT"}
    with pytest.raises(ValueError, match="can't be restored"):
        jobs.restore(spark, root, "b")
    os.remove(f"{folder}/{chunk}")
    assert "MISSING" in {r["verdict"] for r in jobs.verify_backup(spark, root, "b").collect()}


def test_empty_backup(spark):
    root = scratch(spark)
    empty = spark.createDataFrame([], "k bigint, v string")
    jobs.backup(empty, root, "b", "t", "k", 1, 10)
    assert jobs.restore(spark, root, "b").count() == 0


def test_latest_state_of_one_operation(spark):
    rows = [("op-list", p, "Done", 1, 1, 0) for p in "abcde"] + [("other-op", "a", "Done", 1, 1, 0)]
    df = spark.createDataFrame(rows, "operation_id string, partition_id string, status string, last_committed bigint, rows_written bigint, error_count bigint")
    assert latest_by(df.filter("operation_id = 'op-list'"), ["operation_id", "partition_id"], ["rows_written"]).count() == 5


def test_conflicts_inside_the_source(spark):
    s, t = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert {tuple(r) for r in joins.conflict_error(s, t, ["k"]).collect()} == {(2, "in target"), (1, "twice in source")}
    assert joins.conflict_skip(s, t, ["k"]).count() == 2


def test_long_plans_are_joined_by_cells(spark):
    df = spark.range(0, 3_000_000, 1000).withColumnRenamed("id", "k")
    plan = pl.plan_key_ranges(df, "k", 7)
    a = pl.range_assign_join(df, plan, "k", 7).select("k", "partition_id")
    b = pl.range_assign_join(df, plan, "k", pl.BROADCAST_PLAN + 1).select("k", "partition_id")
    assert a.count() == 3000 and a.exceptAll(b).count() == 0 and b.count() == 3000


def test_symmetric_difference_counts_copies(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert {tuple(r) for r in windows.symmetric_difference(a, b, ["k"]).collect()} == {(1, "source", 1), (2, "source", 1), (3, "target", 1)}


def test_stream_repeats_a_batch_without_harm(spark):
    path, target, state = scratch(spark), scratch(spark), scratch(spark)
    df = spark.createDataFrame([(i, i) for i in range(100)], "k int, v int")
    df.repartition(4).write.parquet(path)
    streams.stream_migrate(streams.file_stream(spark, path, df.schema), target, state)
    streams.stream_migrate(streams.file_stream(spark, path, df.schema), target, state)
    assert streams.stream_rows(spark, target).count() == 100
    other = scratch(spark)
    df.withColumn("k", F.col("k") + 100).repartition(4).write.parquet(other)
    streams.stream_migrate(streams.file_stream(spark, other, df.schema), target, scratch(spark))
    assert streams.stream_target(spark, target, ["k"], ["v"]).count() == 200


def test_sorted_assignment_does_not_hang_on_partitions(spark, monkeypatch):
    # wide rows: adaptive execution coalesces the branches that read no payload, and only those
    df = spark.range(3000).select(F.col("id").alias("k"), F.concat_ws("", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(20)]).alias("pad"))
    plan = spark.createDataFrame([("low", None, 40), ("a", 40, 1500), ("b", 1600, 2900), ("c", 2950, None)], "partition_id string, start bigint, `end` bigint")
    monkeypatch.setattr(pl, "STRETCH", 200, raising=False)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200000"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["k"]: r["partition_id"] for r in pl.range_assign_join(df, plan, "k", pl.BROADCAST_PLAN + 1).select("k", "partition_id", F.length("pad")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: "low" if k < 40 else "a" if k < 1500 else "b" if k < 2900 else "c" for k in range(3000) if not (1500 <= k < 1600 or 2900 <= k < 2950)}


def test_checksum_writes_fractions_as_sql_does(spark, tmp_path):
    values = [-0.0, 0.0, 0.29, 0.0001, 0.00001, -0.0009, 1e7, 123456789.25, 2e23, 1e15, 1e16, -1.5e22, 5e-324, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "i int, d double, f float")
    path = str(tmp_path / "t")
    df.write.parquet(path)
    for c in ("d", "f"):
        sql = f"select cast(sum({queries.TOKEN.format('(' + queries.row_text_sql('i', c) + ')')}::hugeint) as varchar) from '{path}/*.parquet'"
        assert aggregates.table_checksum(df, ["i", c]).first()["checksum"] == duckdb.execute(sql).fetchall()[0][0], c


def test_repeated_keys_are_reordered_without_a_range_for_each_value(spark, small):
    # a global sort by a column of seven values is seven tasks, whatever the table's size
    plan = queries.QUERIES["verify_repeated_keys"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [l_linenumber" in plan and not re.search(r"Sort \[l_linenumber.*\], true", plan)
