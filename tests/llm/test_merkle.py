"""The manifest against a tree built by hand, on odd tables and with narrow node rows."""

import hashlib
import random
import zlib

import pytest

from quaystone.llm import merkle as mk

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string, tree string, hash string, place int, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def up(level):
    return [h(*level[i : i + 2]) for i in range(0, len(level), 2)]


def path(levels, i):
    """(siblings, folding) from place i to the top of a tree."""
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), i % 2
        i //= 2


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def by_hand(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    low = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x.encode())
    for t in trees.values():
        t.sort(key=lambda r: (low(r[0]), leaf(r)))
    langs = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: levels_of([leaf(r) for r in trees[g]]) for g in langs}
    top = levels_of([built[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(trees[g]):
            folded, siblings = leaf(r), []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                folded = leaf((*r[:3], r[3] + 1, r[4]))
            for levels, at in ((built[g], i), (top, k)):
                for other, odd in path(levels, at):
                    siblings += [other] if other else []
                    folded = h(folded) if other is None else h(other, folded) if odd else h(folded, other)
            out.append((r[0], leaf(r), built[g][-1][0], top[-1][0], h(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def made(seed, n):
    r = random.Random(seed)
    rows = [(r.choice([None, *range(60)]), r.choice([None, "s", ""]), r.choice(["en", "en", "en", "é", None, "", "fr"]), r.choice([None, 0, 2**31 - 1, 5]), r.choice([None, "", "x", "é" * 40, "long " * 9000])) for _ in range(n)]
    return rows + rows[: n // 5] + [(900, "s", "solo", 1, "one row of its language")]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "t", "h", 1, 2) for x in rows], SCHEMA)


@pytest.mark.parametrize("seed,n,height", [(1, 150, 12), (2, 200, 2), (3, 90, 1), (4, 0, 12)])
def test_against_trees_by_hand(spark, seed, n, height):
    rows = made(seed, n)
    got = mk.manifest(frame(spark, rows), height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == by_hand(rows)


def test_one_leaf_and_empty_tables(spark):
    one = [(3, None, None, None, None)]
    assert [tuple(x) for x in mk.manifest(frame(spark, one)).collect()] == by_hand(one)
    assert mk.manifest(frame(spark, [])).count() == 0


def test_more_rows_than_spark_allows_a_recursion(spark):
    """The session's limit is lifted for the climb and put back."""
    spark.conf.set(mk.ROW_LIMIT, "50")
    try:
        rows = made(5, 80)
        assert sorted((tuple(x) for x in mk.manifest(frame(spark, rows)).collect()), key=str) == by_hand(rows)
        assert spark.conf.get(mk.ROW_LIMIT) == "50"
    finally:
        spark.conf.unset(mk.ROW_LIMIT)


def test_tampering_is_noticed(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(300)]
    got = {x["doc_id"]: x["verified"] for x in mk.manifest(frame(spark, rows)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 != 0 for i in range(300)}
