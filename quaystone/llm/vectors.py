"""Approximate nearest neighbours: a navigable small-world graph per shard, as flat neighbour arrays.

Equal vectors are indexed once, with the smallest ids that any answer can need. The distinct vectors
are dealt to shards by a hash of the vector; a task builds the layers of one shard and returns them as
byte arrays. A shard has 4,096 to 65,536 vectors: as few as give every core a shard, more once there are
more shards than cores (``SHARD``). The queries meet every shard in blocks of ``BLOCK``, so a graph is
read once for each 16,384 queries; a search walks some hundred queries through the layers at once, and
the shards' answers are merged by rank. Nearness is the inner product, which becomes a Euclidean distance by
one more coordinate (the length that is missing to the longest vector of the shard).

Vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither do
rows without an id; vectors are compared with those of their own length; rows that repeat id and vector are
one; an id with several vectors is a query, and a candidate, with each of them; no row with the query's
own id is its candidate; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textblocks import map_batches, table, written

TOP = 20
EVERY = 20
#: Distinct vectors of a shard, about: at least, and at most.
SHARD = 4096, 65536
#: Neighbours of a node (twice as many in the lowest layer), and width of the search.
LINKS, WIDTH, BUILD_WIDTH = 16, 96, 64
#: One of so many vectors is also in the layer above.
LAYER = 16
#: Queries that meet a shard together, and that walk through its layers at once.
BLOCK, AT_ONCE = 16384, 512


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.filter("vec_id is not null and size(vector) > 0").filter(fine & F.exists("vector", lambda x: x != 0))


def _nearest(points: np.ndarray, links: np.ndarray, start: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once; (nodes, squared distances), nearest first, -1 where none.

    links: flat neighbour array, -1 where there is none. start: entry nodes of each query.
    """
    q, n = len(queries), len(points)
    norm = (points * points).sum(1)
    rows = np.arange(q)[:, None]

    def distance(nodes: np.ndarray) -> np.ndarray:
        d = norm[nodes] - 2 * np.einsum("qkd,qd->qk", points[nodes], queries)
        return np.where(nodes < 0, np.inf, d)

    seen = np.zeros((q, n + 1), bool)  # the last column stands for "none"
    node = np.full((q, width), -1, np.int32)
    node[:, : start.shape[1]] = start
    seen[rows, node] = True
    dist = distance(node)
    open_ = node >= 0
    live = np.arange(q)
    while len(live):
        d = np.where(open_[live], dist[live], np.inf)
        pick = d.argmin(1)
        more = np.isfinite(d[np.arange(len(live)), pick])
        live, pick = live[more], pick[more]
        if not len(live):
            break
        open_[live, pick] = False
        near = links[node[live, pick]]
        near = np.where(seen[live[:, None], near], -1, near)
        seen[live[:, None], near] = True
        d = norm[near] - 2 * np.einsum("qkd,qd->qk", points[near], queries[live])
        d[near < 0] = np.inf
        both_n, both_d = np.concatenate([node[live], near], 1), np.concatenate([dist[live], d], 1)
        both_o = np.concatenate([open_[live], near >= 0], 1)
        keep = np.argpartition(both_d, width - 1, axis=1)[:, :width]
        at = np.arange(len(live))[:, None]
        node[live], dist[live], open_[live] = both_n[at, keep], both_d[at, keep], both_o[at, keep]
    order = np.argsort(dist, axis=1, kind="stable")
    return np.where(np.isfinite(dist[rows, order]), node[rows, order], -1), dist[rows, order]


def _diverse(points: np.ndarray, near: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (nearest first) those that no chosen neighbour is nearer to than the node; filled up with the rest."""
    if len(near) > 256:  # bounded memory
        return np.concatenate([_diverse(points, near[i : i + 256], own[i : i + 256], most) for i in range(0, len(near), 256)])
    q, c = near.shape
    chosen = np.full((q, most), -1, np.int32)
    count = np.zeros(q, np.int64)
    base = ((points[near] - points[own][:, None, :]) ** 2).sum(2)
    taken = np.zeros((q, c), bool)
    for fill in (False, True):
        for k in range(c):
            x = near[:, k]
            ok = (x >= 0) & (x != own) & (count < most) & ~taken[:, k]
            if not fill and k:
                to = ((points[chosen] - points[x][:, None, :]) ** 2).sum(2)
                ok &= ~((to < base[:, k : k + 1]) & (chosen >= 0)).any(1)
            r = np.flatnonzero(ok)
            chosen[r, count[r]] = x[r]
            taken[r, k] = True
            count[r] += 1
    return chosen


def _layer(points: np.ndarray, members: np.ndarray, most: int) -> np.ndarray:
    """Neighbour array of one layer, for the nodes in ``members``, built in batches of doubling size."""
    links = np.full((len(points) + 1, most), -1, np.int32)  # the last row stands for "none"
    done = min(len(members), 64)
    first = members[:done]
    d = ((points[first][:, None, :] - points[first][None, :, :]) ** 2).sum(2)
    links[first] = _diverse(points, first[np.argsort(d, 1, kind="stable")], first, most)
    while done < len(members):
        batch = members[done : done + min(done, 512)]
        entry = np.repeat(members[None, : min(4, done)], len(batch), 0)
        near, dist = _nearest(points, links, entry, points[batch], BUILD_WIDTH)
        # the batch's own nearest come from an exact comparison inside it
        own = (points[batch] ** 2).sum(1)[None, :] - 2 * points[batch] @ points[batch].T
        np.fill_diagonal(own, np.inf)
        k = min(most, len(batch) - 1)
        mine = np.argpartition(own, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(batch), 0), np.int64)
        cand = np.concatenate([near, batch[mine]], 1)
        dist = np.concatenate([dist, np.take_along_axis(own, mine, 1)], 1)
        cand = np.take_along_axis(cand, np.argsort(dist, axis=1, kind="stable")[:, : 2 * most], 1)
        links[batch] = _diverse(points, cand, batch, most)
        # links back; nodes with too many keep a diverse choice
        src, dst = np.repeat(batch, most), links[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        back = np.concatenate([np.stack([np.repeat(np.unique(dst), most), links[np.unique(dst)].ravel()], 1), np.stack([dst, src], 1)])
        back = np.unique(back[back[:, 1] >= 0], axis=0)
        gap = ((points[back[:, 0]] - points[back[:, 1]]) ** 2).sum(1)
        order = np.lexsort((gap, back[:, 0]))
        back = back[order]
        node, begin, size = np.unique(back[:, 0], return_index=True, return_counts=True)
        wide = min(int(size.max()), 4 * most)
        cand = np.full((len(node), wide), -1, np.int32)
        rank = np.arange(len(back)) - np.repeat(begin, size)
        fits = rank < wide
        cand[np.repeat(np.arange(len(node)), size)[fits], rank[fits]] = back[fits, 1]
        links[node] = _diverse(points, cand, node, most)
        done += len(batch)
    links[-1] = -1
    return links


class Graph:
    """Layers of a shard: the lowest has every vector, each above one of LAYER."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors = vectors
        long = (vectors * vectors).sum(1)
        self.points = np.concatenate([vectors, np.sqrt(np.maximum(long.max() - long, 0))[:, None]], 1).astype(np.float32)
        if layers is None:
            layers, every = [], 1
            while not layers or len(vectors) > every * 2:
                layers.append(_layer(self.points, np.arange(0, len(vectors), every), LINKS * (2 if every == 1 else 1)))
                every *= LAYER
        self.layers = layers

    def search(self, queries: np.ndarray, top: int, width: int = WIDTH) -> np.ndarray:
        q = np.concatenate([queries, np.zeros((len(queries), 1))], 1).astype(np.float32)
        entry = np.zeros((len(q), 1), np.int32)
        for links in self.layers[:0:-1]:
            near, _ = _nearest(self.points, links, entry, q, 8)
            entry = near[:, :4]
        near, _ = _nearest(self.points, self.layers[0], entry, q, max(width, top))
        return near[:, :top]


def _build(batches: pd.DataFrame) -> pd.DataFrame:
    rows = batches.sort_values("head")
    vectors = np.stack(rows["vector"].to_numpy())
    g = Graph(vectors)
    ids = [np.asarray(x, np.int64) for x in rows["ids"]]
    return pd.DataFrame(
        {
            "shard": [rows["shard"].iloc[0]],
            "dim": [rows["dim"].iloc[0]],
            "n": [len(rows)],
            "vectors": [vectors.tobytes()],
            "layers": [[x.tobytes() for x in g.layers]],
            "ids": [np.concatenate(ids).tobytes()],
            "n_ids": [np.array([len(x) for x in ids], np.int32).tobytes()],
        }
    )


def _search(top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            r = batch.slice(row, 1)
            get = lambda c, r=r: r.column(c)[0]
            vectors = np.frombuffer(get("vectors").as_buffer()).reshape(get("n").as_py(), -1)
            layers = [x.as_buffer() for x in get("layers")]
            most = [LINKS * 2] + [LINKS] * (len(layers) - 1)
            g = Graph(vectors, [np.frombuffer(x, np.int32).reshape(-1, m) for x, m in zip(layers, most, strict=True)])
            at = np.concatenate([[0], np.cumsum(np.frombuffer(get("n_ids").as_buffer(), np.int32))])
            ids = np.frombuffer(get("ids").as_buffer(), np.int64)
            asked = get("queries").values
            query_ids = asked.field("vec_id").to_numpy()
            queries = asked.field("vector").flatten().to_numpy().reshape(len(query_ids), -1)
            numbers = asked.field("number").to_numpy()
            for a in range(0, len(query_ids), AT_ONCE):
                yield _answers(g, vectors, ids, at, query_ids[a : a + AT_ONCE], numbers[a : a + AT_ONCE], queries[a : a + AT_ONCE], top)


def _answers(g: Graph, vectors: np.ndarray, ids: np.ndarray, at: np.ndarray, query_ids: np.ndarray, numbers: np.ndarray, queries: np.ndarray, top: int) -> pa.RecordBatch:
    """The best of one shard; a node stands for all ids of its vector."""
    near = g.search(queries, top + 1)
    rows: list[tuple[int, int, int, float]] = []
    for k, (q, number) in enumerate(zip(query_ids.tolist(), numbers.tolist(), strict=True)):
        nodes = near[k][near[k] >= 0]
        score = np.einsum("nd,d->n", vectors[nodes], queries[k])
        found = [(-s, v) for x, s in zip(nodes.tolist(), score.tolist(), strict=True) for v in ids[at[x] : at[x + 1]].tolist() if v != q]
        rows += [(q, number, v, -s) for s, v in sorted(found)[:top]]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "number", "vec_id", "score"])


def nearest(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id ``every`` divides."""
    rows = written(usable(vectors).dropDuplicates(["vec_id", "vector"]))
    # of equal vectors no answer holds more than the top + 1 smallest ids; counted in two steps, so a
    # vector that a third of all rows share is never gathered in one task
    salted = Window.partitionBy("vector", "salt").orderBy("vec_id")
    merged = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).filter(f"r <= {top + 1}")
    few = few.withColumn("r", F.row_number().over(merged)).filter(f"r <= {top + 1}")
    points = written(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = shard_count(points.count(), vectors.sparkSession.sparkContext.defaultParallelism)
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).withColumn("head", F.xxhash64("vector", F.lit(1))).withColumn("dim", F.size("vector"))
    dealt = dealt.repartitionById(shards, F.col("shard"))  # a task for each shard
    graphs = written(dealt.groupBy("shard", "dim").applyInPandas(_build, "shard int, dim int, n int, vectors binary, layers array<binary>, ids binary, n_ids binary"))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("number", F.xxhash64("vector"))
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(1, -(-asked.count() // BLOCK))))
    blocks = asked.groupBy(block.alias("block"), F.size("vector").alias("dim")).agg(F.collect_list(F.struct("vec_id", "number", "vector")).alias("queries"))
    met = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(graphs, ["shard", "dim"])
    found = map_batches(met.select("n", "vectors", "layers", "ids", "n_ids", "queries"), lambda it: _search(top, it), "query_id bigint, number bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(f"rank <= {top}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def shard_count(vectors: int, cores: int) -> int:
    least, most = SHARD
    return max(1, -(-vectors // most), min(-(-vectors // least), cores))


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
