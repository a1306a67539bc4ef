"""Connected components against a plain search, as one chunk and in rounds."""

import random

import numpy as np
import pytest

from quaystone.llm.components import _joined, connected


def by_hand(links):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u != v:
            a, b = sorted((top(u), top(v)))
            root[b] = a
    return {x: top(x) for x in root}


@pytest.mark.parametrize("chunk", [1 << 18, 7, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, chunk, seed):
    r = random.Random(seed)
    links = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, x) for x in range(301, 340)]
    links += links[:9] + [(5, 5), (-3, 2**62)]
    r.shuffle(links)
    got = connected(spark.createDataFrame(links, "u bigint, v bigint").repartition(3), chunk).collect()
    assert {x["node"]: x["root"] for x in got} == by_hand(links) and len(got) == len(by_hand(links))


def test_no_links(spark):
    assert connected(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    assert connected(spark.createDataFrame([(1, 1)], "u bigint, v bigint")).count() == 0


def test_long_chains_in_a_chunk():
    n = 5000
    order = np.random.default_rng(3).permutation(n)
    u, v = _joined(order[:-1], order[1:])
    assert sorted(u.tolist()) == list(range(1, n)) and set(v.tolist()) == {0}
