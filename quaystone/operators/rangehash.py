"""Comparison of two tables by hashes of key ranges: what agrees is never compared row by row.

Every range of keys has a row count and two order-independent sums of row hashes on each side. Ranges that agree are done; ranges that
differ are split and hashed again, until what is left is small or splitting leaves most of it, and only the
rows of those ranges are compared (``verify_rows``). A range is a stretch of the key itself where the key is one whole
number, so its filter reaches files and databases; other keys are ranged by their token.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.partitions import HIGH, LOW, key_bounds
from ..session import token
from .joins import row_hashes, sampled, verify_rows

#: Ranges that a level makes in all, rows below which a level's remainder isn't split further, and levels at most.
FANOUT, FEW_ROWS, LEVELS = 1024, 1 << 20, 4
#: Up to so many stretches become a condition that scans can push down; more are one lookup in a set.
PUSHED = 32
TOKENS = 1 << 60
WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass
class Level:
    """What a round of hashing found: rows hashed on both sides, ranges that differ (start, end) and the rows in them."""

    rows: int
    differing: list[tuple[int, int]]
    rows_left: int


@dataclass
class Comparison:
    source_rows: int
    target_rows: int
    levels: list[Level]
    rows: DataFrame  # keys and verdict

    @property
    def equal(self) -> bool:
        return not self.levels[-1].differing


def position(df: DataFrame, keys: list[str]) -> Column:
    """Where a row lies: its whole-number key, or its key's token; a null key is its own place, before all."""
    if len(keys) == 1 and dict(df.dtypes)[keys[0]] in WHOLE:
        return F.col(keys[0]).cast("bigint")
    return token(*keys)


def within(at: Column, ranges: list[tuple[int, int]] | None, null: bool) -> Column:
    """Rows of the ranges (None: all), and those without a position if ``null``."""
    if ranges is None:
        return F.lit(True)
    stretches: list[list[int]] = []
    for a, b in sorted(ranges):
        if stretches and stretches[-1][1] == a:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    cond = at.isNull() if null else F.lit(False)
    if len(stretches) <= PUSHED:
        for a, b in stretches:
            cond = cond | between(at, a, b)
        return cond
    lo, hi, width = stretches[0][0], stretches[-1][1], min(b - a for a, b in ranges)
    cells = [(a - lo) // width + i for a, b in ranges for i in range(-(-(b - a) // width))]
    return cond | (between(at, lo, hi) & cell_of(at, lo, width).isin(cells))


def between(at: Column, a: int, b: int) -> Column:
    """a <= at < b by literals of the key's own type, which scans can push down; bounds beyond the type hold for every key."""
    return at.isNotNull() & (F.lit(True) if a <= LOW else at >= a) & (F.lit(True) if b > HIGH else at < b)


def cell_of(at: Column, low: int, width: int) -> Column:
    """Which stretch of ``width`` from ``low`` on; as decimals, since differences may pass 64 bits."""
    return F.call_function("div", at.cast("decimal(20,0)") - F.lit(Decimal(low)), F.lit(Decimal(width)))


def hashed(df: DataFrame, at: Column, columns: list[str], ranges: list[tuple[int, int]], null: bool) -> DataFrame:
    """cell (range number from the first range on; null without a key), n, a, b: one aggregation, of which a few rows a task are shuffled."""
    a, b = row_hashes(df, columns)
    lo, width = ranges[0][0], ranges[0][1] - ranges[0][0]
    picked = df.filter(within(at, ranges, null)).select(cell_of(at, lo, width).alias("cell"), a.alias("a"), b.alias("b"))
    return picked.groupBy("cell").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def _cells(ranges: list[tuple[int, int]], width: int, origin: int) -> list[tuple[int, int]]:
    """Ranges cut at multiples of ``width`` from ``origin``."""
    out = []
    for a, b in ranges:
        first = a - (a - origin) % width
        out += [(x, x + width) for x in range(first, b, width)]
    return out


def compare(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], percent: float = 100.0, fanout: int = FANOUT, few: int = FEW_ROWS) -> Comparison:
    """Which keys are missing, extra or mismatched, as ``verify_rows`` says, reading on only where hashes differ.

    Equal tables cost the bounds of a whole-number key (statistics of files, where they have any) and one aggregation a
    side. The driver holds at most ``fanout`` ranges a level, beside those without a key.
    """
    sides = [sampled(df, keys, percent) for df in (source, target)]
    ats = [position(df, keys) for df in sides]
    if len(keys) == 1 and all(dict(df.dtypes)[keys[0]] in WHOLE for df in sides):
        bounds = [key_bounds(df, keys[0]).first() for df in sides]
        low = min((b["min_key"] for b in bounds if b["min_key"] is not None), default=0)
        high = max((b["max_key"] for b in bounds if b["max_key"] is not None), default=0) + 1
    else:
        ats, low, high = [token(*keys) for _ in sides], 0, TOKENS
    width = max(1, -(-(high - low) // fanout))
    ranges, null, levels, totals = _cells([(low, high)], width, low), True, [], [0, 0]
    while True:
        found: dict[int | None, list] = {}
        for i, (df, at) in enumerate(zip(sides, ats, strict=True)):
            for r in hashed(df, at, columns, ranges, null).collect():  # at most one row for each range
                start = None if r["cell"] is None else ranges[0][0] + r["cell"] * width
                found.setdefault(start, [None, None])[i] = (r["n"], r["a"], r["b"])
        if not levels:
            totals = [sum(v[i][0] for v in found.values() if v[i]) for i in (0, 1)]
        differ = {k: v for k, v in found.items() if v[0] != v[1]}
        left = sum(side[0] for v in differ.values() for side in v if side)
        rows = sum(side[0] for v in found.values() for side in v if side)
        null = None in differ
        cells = sorted((k, k + width) for k in differ if k is not None)
        levels.append(Level(rows, cells + ([(None, None)] if null else []), left))
        if left <= few or width == 1 or left * 2 > rows or len(levels) >= LEVELS or not cells:
            break
        width = max(1, -(-width * len(cells) // fanout))
        ranges = _cells(cells, width, low)
    if not differ:
        return Comparison(*totals, levels, verify_rows(source.limit(0), target.limit(0), keys, columns))
    rest = [df.filter(within(at, cells, null)) for df, at in zip(sides, ats, strict=True)]
    return Comparison(*totals, levels, verify_rows(*rest, keys, columns))
