"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two aggregations and joins on the node; no adjacency list is ever gathered, and a
node with very many neighbours is a skewed join that adaptive execution splits. A round is a Parquet table
in the shared folder, which goes when the next one is there.

Before the rounds every task joins what its own links connect, CHUNK links at a time, so chains inside a task are stars
already; a table of up to CHUNK links is one such chunk and takes no round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import forget, written


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them (rows have u > v)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Links that a task joins at once.
CHUNK = 1 << 18


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) of all that the links connect, for nodes that aren't their own root."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        # roots of linked nodes meet, then every node looks up its root's root
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _stars(chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, ``chunk`` at a time, as links to the smallest node that they connect."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced() -> pa.RecordBatch:
        u, v = _joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        for k in range(0, batch.num_rows, chunk):
            part = batch.slice(k, chunk)
            held.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
            if sum(len(x[0]) for x in held) >= chunk:
                yield reduced()
                held.clear()
    if held and any(len(x[0]) for x in held):
        yield reduced()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component.

    links: u, v of one type. Loops and repeated links don't matter; no links give no rows.
    """
    plain = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    few = plain.limit(chunk + 1).count() <= chunk
    e = (plain.repartition(1) if few else plain).mapInArrow(lambda it: _stars(chunk, it), plain.schema)
    e = written(e if few else e.distinct())
    forget(plain)
    state = (0,) if few else _state(e)
    while state[0]:
        before, e = e, written(_small_star(_large_star(e)))
        forget(before)  # every round but the last leaves nothing behind
        now = _state(e)
        if now == state:
            break
        state = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
