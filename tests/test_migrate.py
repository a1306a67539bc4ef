"""Migration in one pass: counters, refused rows, resumption inside a range, databases that refuse rows."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quaystone.operators import jobs
from quaystone.plans import partitions as pl
from quaystone.session import scratch
from quaystone.sources.ranges import Connect
from quaystone.sources.sinks import DatabaseSink


def letters_of(spark, root):
    return spark.read.schema("record_id string, error string, payload string").option("recursiveFileLookup", "true").json(f"{root}/failed").collect()


def test_every_row_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(v):
        read.add(1)
        return v

    df = spark.createDataFrame([(i, i % 4) for i in range(100)], "k bigint, v int").withColumn("v", seen("v"))
    root = scratch(spark)
    target = jobs.migrate(df, root, "op", "k", 4, checks={"v": F.col("v") > 0})
    assert read.value == 100
    assert target.count() == 75 and len(letters_of(spark, root)) == 25
    states = jobs.status(spark, root, "op").collect()
    assert sum(r["rows_written"] for r in states) == 75 and sum(r["error_count"] for r in states) == 25


def test_fractional_keys_below_zero(spark):
    df = spark.createDataFrame([(-0.75 + i / 8, i) for i in range(20)], "k double, v int")
    assert sorted(r["v"] for r in jobs.migrate(df, scratch(spark), "op", "k", 3).collect()) == list(range(20))
    assert pl.plan_equal_size_ranges(df, "k", 2).agg(F.min("start"), F.max("end")).first()[:] == (-1, 2)


def test_resume_goes_on_inside_a_range(spark):
    df = spark.createDataFrame([(i, i) for i in range(400)], "k bigint, v int")
    root = scratch(spark)
    faulty = df.withColumn("v", F.when(F.col("k") == 150, F.raise_error(F.lit("row 150"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="row 150"):
        jobs.migrate(faulty, root, "op", "k", 1, commits=8, group=1)
    state = spark.read.json(f"{root}/state").orderBy(F.desc("last_committed")).first()
    assert (state["status"], state["last_committed"], state["rows_written"]) == ("InProgress", 149, 150)
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(v):
        read.add(1)
        return v

    target = jobs.migrate(df.withColumn("v", seen("v")), root, "op", "k", 1, commits=8, group=1)
    assert read.value == 250 and target.count() == 400 and target.select("k").distinct().count() == 400
    last = jobs.status(spark, root, "op").first()
    assert (last["status"], last["rows_written"]) == ("Done", 400)


def test_other_steps_on_resume(spark):
    df = spark.createDataFrame([(i, i) for i in range(100)], "k bigint, v int")
    plan = [{"partition_id": "p0", "start": 0, "end": 100}]
    seen = {"p0": {"status": "InProgress", "last_committed": 36}}
    cut = jobs.slices(plan, seen, 3)
    assert [(s.start, s.end, s.last) for s in cut] == [(37, 68, False), (68, 100, True)]
    assert [(s.start, s.end) for s in jobs.slices(plan, {}, 1)] == [(0, 100)] and jobs.slices(plan, {"p0": {"status": "Done"}}, 3) == []
    assert jobs.migrate(df, scratch(spark), "op", "k", 3, commits=5).count() == 100


def test_masked_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(i, f"n{i}", True, ["e"]) for i in range(30)], "k bigint, _unit string, _refused boolean, _errors array<string>")
    root = scratch(spark)
    target = jobs.migrate(df, root, "op", "k", 3, masks=[("k", "sha256"), ("_unit", "redact")], checks={"even": F.col("_refused")})
    got = target.collect()
    assert len(got) == 30 and {r["_unit"] for r in got} == {"[REDACTED]"}
    bad = scratch(spark)
    jobs.migrate(df, bad, "op", "k", 3, checks={"never": ~F.col("_refused")})
    found = letters_of(spark, bad)
    assert len(found) == 30 and {x["error"] for x in found} == {"never"}
    assert json.loads(found[0]["payload"]).keys() == {"k", "_unit", "_refused", "_errors"}


def test_leftovers_of_a_crash_are_cleared(spark):
    df = spark.createDataFrame([(i, i) for i in range(40)], "k bigint, v int")
    root = scratch(spark)
    df.limit(7).write.parquet(f"{root}/data/_refused=false/_unit=p1@19")  # written, but no checkpoint
    assert jobs.migrate(df, root, "op", "k", 2).count() == 40


def database(path):
    c = sqlite3.connect(path)
    c.execute("create table t (k integer primary key, v integer check (v <> 3), s text not null)")
    c.commit()
    c.close()


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_refused_rows_are_letters_with_their_error(spark, tmp_path, batch):
    path = str(tmp_path / "db")
    database(path)
    rows = [(i, i % 5, None if i % 11 == 0 else "x") for i in range(100)] + [(200, 1, "a"), (200, 2, "b")]
    df, root = spark.createDataFrame(rows, "k bigint, v int, s string"), scratch(spark)
    jobs.migrate(df, root, "op", "k", 3, checks={"few": F.col("k") != 50}, sink=DatabaseSink(Connect("sqlite3", path, timeout=60), "t", batch))
    there = {r[0] for r in sqlite3.connect(path).execute("select k from t")}
    good = {k for k, v, s in rows if v != 3 and s is not None and k != 50}
    assert there == good
    found = {x["record_id"]: x["error"] for x in letters_of(spark, root)}
    assert len(letters_of(spark, root)) == len(rows) - len(good)
    assert found["50"] == "few" and "CHECK" in found["3"] and "NOT NULL" in found["11"] and "UNIQUE" in found["200"]
    states = jobs.status(spark, root, "op").collect()
    assert sum(r["rows_written"] for r in states) == len(good) and {r["status"] for r in states} == {"Done"}
    jobs.migrate(df, root, "op", "k", 3, sink=DatabaseSink(Connect("sqlite3", path, timeout=60), "t"))
    assert len(letters_of(spark, root)) == len(rows) - len(good)


def test_a_task_that_runs_again_writes_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "db")
    database(path)
    sink = DatabaseSink(Connect("sqlite3", path, timeout=60), "t", 4)
    df = spark.createDataFrame([(i, i % 5, "x", [], "u") for i in range(20)], "k bigint, v int, s string, e array<string>, u string").coalesce(1)
    root = scratch(spark)
    first = sink.append(df, "k", "t", f"{root}/l", "u", "e", ["u"])
    again = sink.append(df, "k", "t", f"{root}/l", "u", "e", ["u"])  # the same batches of the same run
    assert first == again == ([20], [4])
    assert sqlite3.connect(path).execute("select count(*) from t").fetchone() == (16,)


def test_other_batches_of_the_same_place_are_written(spark, tmp_path):
    path = str(tmp_path / "db")
    database(path)
    sink = DatabaseSink(Connect("sqlite3", path, timeout=60), "t", 4)
    rows = [(i, 0, "x", [], "u") for i in range(8)]
    kinds = "k bigint, v int, s string, e array<string>, u string"
    root = scratch(spark)
    sink.append(spark.createDataFrame(rows[:4], kinds).coalesce(1), "k", "t", f"{root}/l", "u", "e", ["u"])
    assert sink.append(spark.createDataFrame(rows[4:], kinds).coalesce(1), "k", "t", f"{root}/l", "u", "e", ["u"]) == ([4], [0])
    assert sqlite3.connect(path).execute("select count(*) from t").fetchone() == (8,)


class Counted:
    """A connection that counts its commits, also those of an outermost savepoint."""

    def __init__(self, path):
        self.inner, self.commits = sqlite3.connect(path), 0

    def cursor(self):
        outer, cursor = self, self.inner.cursor()

        class Cursor:
            def execute(self, sql, values=()):
                was = outer.inner.in_transaction
                cursor.execute(sql, values)
                outer.commits += was and not outer.inner.in_transaction
                return self

            executemany, fetchone = cursor.executemany, cursor.fetchone

        return Cursor()

    def commit(self):
        self.commits += self.inner.in_transaction
        self.inner.commit()

    rollback = property(lambda self: self.inner.rollback)


def test_a_batch_is_one_transaction(tmp_path):
    path = str(tmp_path / "db")
    database(path)
    sink = DatabaseSink(Connect("sqlite3", path), "t", 20)
    sink._make_ledger()
    connection = Counted(path)
    rows = [{"k": i, "v": i % 5, "s": "x", "e": []} for i in range(20)]
    found = sink._commit(connection, "run", 0, 0, rows, ["k", "v", "s"], "e")
    assert [i for i, _ in found] == [3, 8, 13, 18] and connection.commits == 1
    assert sink._commit(connection, "run", 0, 0, rows, ["k", "v", "s"], "e") == found  # from the ledger
    assert connection.inner.execute("select count(*) from t").fetchone() == (16,)
    # where the batch can't be noted no row of it stays
    connection.inner.execute("create trigger never before update on quaystone_batches begin select raise(abort, 'full'); end")
    with pytest.raises(sqlite3.Error, match="full"):
        sink._commit(connection, "run", 0, 1, [{**r, "k": r["k"] + 100} for r in rows], ["k", "v", "s"], "e")
    connection.inner.rollback()
    assert connection.inner.execute("select count(*) from t").fetchone() == (16,)
