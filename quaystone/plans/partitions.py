"""Partition planning: small DataFrames (partition_id, start, end) that say who reads what.

Ranges are half open; a null bound is open. Only plans of n rows are ever built from literals.
"""

from __future__ import annotations

from bisect import bisect_right
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import token

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """One row: smallest and largest key, rounded down to whole numbers, so every key lies in [min_key, max_key + 1)."""
    return df.agg(F.floor(F.min(key)).cast("bigint").alias("min_key"), F.floor(F.max(key)).cast("bigint").alias("max_key"))


def plan_key_ranges(df: DataFrame, key: str, n: int) -> DataFrame:
    """n equal ranges over an integer key; one range if the key has one value, none for an empty table.

    The last range ends at max + 1; with more ranges than keys the tail ranges are empty.
    """
    n = max(1, n)
    b = key_bounds(df, key).filter("min_key is not null")
    count = F.when(F.col("max_key") <= F.col("min_key"), 1).otherwise(n)
    step = F.greatest(F.expr(f"(max_key - min_key) div {n}"), F.lit(1))
    rows = b.withColumn("step", step).withColumn("i", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("count", count)
    start = F.col("min_key") + F.col("i") * F.col("step")
    return rows.select(
        F.concat(F.lit("p"), F.col("i")).alias("partition_id"),
        start.alias("start"),
        F.when(F.col("i") == F.col("count") - 1, F.col("max_key") + 1).otherwise(start + F.col("step")).alias("end"),
    )


def plan_sampled_ranges(df: DataFrame, key: str, n: int) -> DataFrame:
    """Boundaries are the n - 1 keys of smallest token, sorted; both outer ends are open.

    The sample is found by a top-k, not by a sort of the table.
    """
    sample = df.select(F.col(key).cast("bigint").alias("k")).distinct().orderBy(token("k"), "k").limit(max(0, n - 1))
    cuts = sample.agg(F.sort_array(F.collect_list("k")).alias("cuts"))
    ends = cuts.select(F.concat(F.array(F.lit(None).cast("bigint")), "cuts").alias("s"), F.concat("cuts", F.array(F.lit(None).cast("bigint"))).alias("e"))
    return ends.select(F.posexplode(F.arrays_zip("s", "e")).alias("i", "x")).select(F.concat(F.lit("p"), F.col("i")).alias("partition_id"), F.col("x.s").alias("start"), F.col("x.e").alias("end"))


def plan_equal_size_ranges(df: DataFrame, key: str, n: int, accuracy: int = 100_000, exact: bool = False) -> DataFrame:
    """Boundaries that leave equally many rows in each range, whatever the gaps in the key.

    Boundaries come from a quantile sketch whose rank error is at most 1 / accuracy of the rows, in bounded
    memory; exact: from exact percentiles, which hold a count for each distinct key in one place.
    """
    points = ", ".join(str(i / n) for i in range(1, n))
    lo, hi = F.floor(F.min(key)).cast("bigint").alias("lo"), F.floor(F.max(key)).cast("bigint").alias("hi")
    quantiles = F.array().cast("array<double>")
    if points:
        quantiles = F.expr(f"percentile({key}, array({points}))" if exact else f"percentile_approx({key}, array({points}), {accuracy})")
    q = df.agg(lo, hi, quantiles.alias("q"))
    cuts = q.filter("lo is not null").withColumn("cuts", F.array_distinct(F.transform("q", lambda x: F.ceil(x).cast("bigint"))))
    ends = cuts.select(F.concat(F.array("lo"), "cuts").alias("s"), F.concat("cuts", F.array(F.col("hi") + 1)).alias("e"))
    return ends.select(F.posexplode(F.arrays_zip("s", "e")).alias("i", "x")).select(F.concat(F.lit("p"), F.col("i")).alias("partition_id"), F.col("x.s").alias("start"), F.col("x.e").alias("end"))


#: Cells of a histogram that the driver holds at once, and the smallest range by bytes.
CELLS, SMALLEST = 4096, 1 << 20


def plan_byte_ranges(df: DataFrame, key: str, n: int, size: Column, error: float = 0.01, smallest: int = SMALLEST) -> DataFrame:
    """Ranges of a whole-number key with about equally many bytes, however they are spread over keys and rows.

    A range ends with the key that brings it to the next multiple of the target: the n-th part of all bytes, rounded up to whole
    multiples of ``smallest``, so a small table has fewer ranges. The rows of a key are never parted. Both outer ends are open; n below 2, or a
    table without bytes, gives one open range.

    Cuts come from histograms of bytes over cells of the key, CELLS at most on the driver; cells with a cut are read again in finer
    cells until they hold no more than ``error`` of the target, which is how far a cut may be off (0: exact).
    """
    spark = df.sparkSession
    sized = df.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("b")).filter("k is not null")
    one = sized.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).first()
    cuts: set[int] = set()
    if n > 1 and one["b"]:
        total = int(one["b"])
        target = -(-max(smallest, -(-total // n)) // smallest) * smallest
        # (start, width, bytes before) of the cells that are read in a round
        cells = [(one["lo"], one["hi"] - one["lo"] + 1, 0)]
        marks = list(range(target, total, target))
        while cells:
            fine = max(2, CELLS // len(cells))
            step = max(1, -(-max(w for _, w, _ in cells) // fine))
            inside = F.lit(False)
            for a, w, _ in cells:
                inside = inside | ((F.col("k") >= a) & (F.col("k") <= a + w - 1))
            number = F.call_function("div", F.col("k").cast("decimal(20,0)") - F.lit(Decimal(one["lo"])), F.lit(Decimal(step)))
            start = F.lit(None).cast("bigint")
            for i, (a, w, _) in enumerate(cells):
                start = F.when((F.col("k") >= a) & (F.col("k") <= a + w - 1), F.lit(i)).otherwise(start)
            found = sized.filter(inside).groupBy(start.alias("i"), number.alias("c")).agg(F.sum("b").alias("b")).collect()  # CELLS rows, and two at the edges of each cell
            again = []
            for i, (a, w, before) in enumerate(cells):
                running = before
                for r in sorted((r for r in found if r["i"] == i), key=lambda r: r["c"]):
                    first = max(a, one["lo"] + r["c"] * step)
                    last = min(a + w - 1, one["lo"] + (r["c"] + 1) * step - 1)
                    if _between(marks, running, running + r["b"]):
                        if first == last or r["b"] <= error * target:
                            cuts.add(last + 1)
                        else:
                            again.append((first, last - first + 1, running))
                    running += r["b"]
            cells = again
    ends = sorted(c for c in cuts if c <= one["hi"])
    rows = [(f"p{i}", a, b) for i, (a, b) in enumerate(zip([None, *ends], [*ends, None], strict=True))]
    return spark.createDataFrame(rows, "partition_id string, start bigint, `end` bigint")


def _between(marks: list[int], low: int, high: int) -> list[int]:
    return marks[bisect_right(marks, low) : bisect_right(marks, high)]


def plan_token_ranges(df: DataFrame, table: str, n: int) -> DataFrame:
    """n ranges over the whole token ring, the last one closed at its top; none for an empty table."""
    width = "decimal(20,0)"
    step = F.lit(str(((1 << 64) + n - 1) // n)).cast(width)
    one = df.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    start = F.lit(str(LOW)).cast(width) + (F.col("i").cast(width) * step).cast(width)
    return one.select(
        F.concat(F.lit(f"{table}-"), F.col("i")).alias("partition_id"),
        start.cast(width).alias("start"),
        F.least((start + step).cast(width), F.lit(str(1 << 63)).cast(width)).cast(width).alias("end"),
    )


def plan_file_splits(df: DataFrame) -> DataFrame:
    """One partition for each data file behind a DataFrame."""
    files = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).distinct()
    return files.select("file", "bytes")


def range_filter(key: str | Column, start, end) -> Column:
    """start <= key < end; None leaves a side open."""
    k = F.col(key) if isinstance(key, str) else key
    cond = F.lit(True)
    if start is not None:
        cond = cond & (k >= F.lit(start))
    if end is not None:
        cond = cond & (k < F.lit(end))
    return cond


def assign_partition(df: DataFrame, key: str, n: int, low: int, high: int, into: str = "partition_id") -> DataFrame:
    """The number of each row's equal range, by arithmetic: no join, no shuffle. A null key is in no range (null)."""
    step = max(1, (high - low) // n)
    number = F.least(F.expr(f"cast(({key} - {low}) div {step} as int)"), F.lit(n - 1))
    return df.withColumn(into, F.when(F.col(key).isNotNull(), number))


#: Rows of a plan up to which it is broadcast; a larger plan is sorted together with the keys.
BROADCAST_PLAN = 100_000


def range_assign_join(df: DataFrame, plan: DataFrame, key: str, plan_rows: int | None = None) -> DataFrame:
    """Labels rows with the range of a plan whose ranges don't overlap; open ends are null, rows in no range are left out.

    Up to BROADCAST_PLAN ranges (counted unless plan_rows says so) are broadcast; more are assigned by ``_sorted_assign``.
    """
    cond = (F.col("start").isNull() | (F.col(key) >= F.col("start"))) & (F.col("end").isNull() | (F.col(key) < F.col("end")))
    if plan_rows is None:
        plan_rows = plan.limit(BROADCAST_PLAN + 1).count()
    if plan_rows <= BROADCAST_PLAN:
        return df.join(F.broadcast(plan), cond)
    return _sorted_assign(df, plan, key)


#: Rows and ranges of one stretch of a sorted assignment, about; stretches at most, and rows of the sample that cuts them.
STRETCH, STRETCHES, CUT_SAMPLE = 1 << 19, 1024, 1 << 16


def _cuts(keys: DataFrame, rows: int) -> list:
    """Keys at which to cut a column into stretches of about STRETCH rows, from a sample by hash that the driver holds.

    They only decide who sorts what; the result is the same with any cuts.
    """
    n = min(STRETCHES, rows // STRETCH + 1)
    if n == 1:
        return []
    share = max(1, rows // (CUT_SAMPLE // 2))
    some = keys.filter((F.pmod(F.xxhash64("_at"), F.lit(share)) == 0) & F.col("_at").isNotNull()).distinct().orderBy("_at").limit(CUT_SAMPLE).collect()
    return [some[i * len(some) // n]["_at"] for i in range(1, n)] if len(some) >= n else []


def _stretch(at: Column, cuts: list, first: int = 0) -> Column:
    """How many cuts lie at or below a key, by halving; 0 for an open start."""
    if not cuts:
        return F.lit(first)
    k = len(cuts) // 2
    return F.when(at >= F.lit(cuts[k]), _stretch(at, cuts[k + 1 :], first + k + 1)).otherwise(_stretch(at, cuts[:k], first))


def _sorted_assign(df: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """A range begins at or before its rows: starts and keys are sorted together in stretches of the key, and each row
    takes the last start so far. What a stretch begins with is the last start of the stretches before it.

    A row's stretch follows from its key alone and never from the partition it lies in: Spark plans, and its adaptive execution
    coalesces, the branches below one by one, so partitions of two branches need not be the same. Neither a wide range nor a dense
    plan makes more rows: the shuffle moves every row and every range once.
    """
    names = [c for c in plan.columns if c not in ("start", "end")]
    kind = df.select(F.col(f"`{key}`").alias("_at")).schema["_at"].dataType
    ranges = plan.filter(F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < F.col("end")))
    # an open start is before every key; the flag puts a range before the rows that begin with it
    ranges = ranges.select(F.col("start").cast(kind).alias("_at"), F.lit(0).alias("_row"), F.struct("start", "end", *names).alias("_range"), F.lit(None).cast(df.select(F.struct("*")).schema[0].dataType).alias("_data"))
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_at"), F.lit(1).alias("_row"), F.lit(None).cast(ranges.schema["_range"].dataType).alias("_range"), F.struct("*").alias("_data"))
    keys = ranges.select("_at").unionByName(rows.select("_at"))
    cuts = _cuts(keys, keys.count())
    part = _stretch(F.col("_at"), cuts).alias("_part")
    inside = Window.partitionBy("_part").orderBy("_at", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranges.unionByName(rows).select(part, "*").withColumn("_range", F.coalesce("_range", F.last("_range", ignorenulls=True).over(inside)))
    # the last start before each stretch: of as many rows as there are stretches
    ends = ranges.select(part, "_at", "_range").groupBy("_part").agg(F.max_by("_range", F.struct(F.col("_at").isNotNull(), "_at")).alias("_last"))
    numbers = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_p"))
    carried = ends.join(F.broadcast(numbers), F.col("_part") < F.col("_p")).groupBy("_p").agg(F.max_by("_last", "_part").alias("_before"))
    found = local.filter("_row = 1").join(F.broadcast(carried), F.col("_part") == F.col("_p"), "left").withColumn("_range", F.coalesce("_range", "_before"))
    found = found.filter(F.col("_range").isNotNull() & (F.col("_range.end").isNull() | (F.col("_at") < F.col("_range.end"))))
    return found.select("_data.*", "_range.start", "_range.end", *[f"_range.`{c}`" for c in names]).select(*[f"`{c}`" for c in (*df.columns, *plan.columns)])


def partition_balance(df: DataFrame, partition: str, key: str) -> DataFrame:
    """Rows and key bounds of each partition, and how its rows compare with the average."""
    each = df.groupBy(partition).agg(F.count("*").alias("n_rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))
    mean = each.agg((F.sum("n_rows") / F.count("*")).alias("mean_rows"))
    return each.crossJoin(F.broadcast(mean)).withColumn("times_mean", F.round(F.col("n_rows") / F.col("mean_rows"), 6)).drop("mean_rows")  # mean is one row
