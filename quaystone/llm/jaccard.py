"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a threshold; no pair is missed.

Texts with equal sets are merged first. All shingles get one order (those that are common in a sample
come last), and a set is filed under its first n - ceil(t * n) + 1 shingles in that order: two sets of
similarity t share one of these. The sample only decides the order, so it changes the work and never
the result. Pairs of a bucket that sizes and places allow are verified by their whole sets.

A group of many near copies meets in each of its buckets, so first every member is held only against
the bucket's member of the smallest set id. After that only pairs that aren't connected yet are held
against each other: in rounds, no more pairs than would join all roots of a task, the likeliest first; when a
round joins nothing more, every pair that is left. Nothing is capped.

What is held against each other first meets as sketches: bitmaps in which every shingle of a set
flips one bit. Two sketches differ in no more bits than the sets differ in shingles, so a pair whose
sketches are further apart than its sizes allow is let go without a loss; only the others are listed
and verified by their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .textblocks import FOLD, NOT_SPACE, blocks, map_batches, mixed, row_key, span_hashes, word_bounds, written

#: Documents whose shingles are counted for the order, and how many of the commonest shingles are told apart.
SAMPLE_DOCS = 20_000
COMMON = 1 << 18
#: Members from which a bucket is worked off by its rows outside the largest group.
LARGE = 256
#: Pairs that one batch holds.
PAIRS = 1 << 18
#: Rounds in which no more pairs are listed than would join all roots of a task.
ROUNDS = 2
#: Bits of a sketch: the power of two from twice the set's size on, inside these bounds.
SKETCH_BITS = (64, 1 << 14)
_EPS = 1e-9
_MIX = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a block's texts, distinct in each text and ascending, and the text of each.

    Words end at ASCII white space, A-Z count as a-z; a text of fewer words is one shingle, one without words none.
    """
    data = FOLD[data]
    s, e, n = word_bounds(data, offs, NOT_SPACE)
    w = span_hashes(data, s, e)
    size = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(n)), size)
    begin, until = np.cumsum(n) - n, np.cumsum(n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + begin[doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(shingle):
        at = first + k
        inside = at < until[doc]
        h[inside] += mixed(w[at[inside]] + np.uint64(k)) * _MIX[k % len(_MIX)]
    h = mixed(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def sketches(h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The sketch of each set; ``h`` holds the sets one after the other, ``size`` how many shingles each has."""
    low, high = SKETCH_BITS
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64), low, high)
    at = np.cumsum(bits) - bits
    place = np.repeat(at, size) + (h & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    raw = np.packbits(odd.astype(np.uint8)).tobytes()
    return [raw[a : a + b] for a, b in zip((at // 8).tolist(), (bits // 8).tolist(), strict=True)]


class Sketches:
    """Sketches of many sets, each at its own length and at half of it."""

    def __init__(self, raw: list[bytes]):
        self.bits = np.array([8 * len(x) for x in raw], np.int64)
        self.row = np.zeros((2, len(raw)), np.int64)
        self.whole: dict[int, np.ndarray] = {}
        for b in np.unique(self.bits).tolist():
            at = np.flatnonzero(self.bits == b)
            own = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), np.uint64).reshape(len(at), b // 64)
            self.row[0, at] = self._put(b, own)
            if b > SKETCH_BITS[0]:
                self.row[1, at] = self._put(b // 2, own[:, : b // 128] ^ own[:, b // 128 :])

    def _put(self, bits: int, more: np.ndarray) -> np.ndarray:
        old = self.whole.get(bits, more[:0])
        self.whole[bits] = np.concatenate([old, more])
        return np.arange(len(old), len(old) + len(more))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of pairs differ: never more than their sets differ in shingles."""
        out = np.zeros(len(a), np.int64)
        bits = np.minimum(self.bits[a], self.bits[b])
        near = np.maximum(self.bits[a], self.bits[b]) <= 2 * bits  # else nothing is known
        for level in np.unique(bits[near]).tolist():
            at = np.flatnonzero(near & (bits == level))
            x, y = (self.whole[level][self.row[(self.bits[k[at]] > level).astype(np.int64), k[at]]] for k in (a, b))
            out[at] = np.bitwise_count(x ^ y).sum(1)
        return out


def _counted(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offs in blocks(batches, "text"):
        g, n = np.unique(shingle_sets(data, offs, shingle)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """The commonest shingles of a sample of documents, the rarest of them first."""
    total = docs.count()
    some = docs.select("text").filter(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(max(1, -(-total // SAMPLE_DOCS)))) == 0)
    counted = map_batches(some, lambda it: _counted(shingle, it), "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 2")
    got = counted.orderBy(F.desc("n"), "g").limit(COMMON).toArrow()
    return got.column("g").to_numpy()[::-1].view(np.uint64)


def _filed(shingle: int, similarity: float, common: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest

    by = np.argsort(common)
    known = common[by]
    for part, data, offs in blocks(batches, "text"):
        h, doc = shingle_sets(data, offs, shingle)
        size = np.bincount(doc, minlength=part.num_rows)
        ends = np.cumsum(size)
        raw = h.tobytes()
        sid = [xxh64_intdigest(raw[8 * (b - n) : 8 * b]) if n else 0 for b, n in zip(ends.tolist(), size.tolist(), strict=True)]
        rank = np.zeros(len(h), np.int64)
        if len(known):
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            rank = np.where(known[k] == h, by[k] + 1, 0)
        sketch = sketches(h, size)
        h = h[np.lexsort((h, rank, doc))]
        take = np.where(size > 0, size - np.ceil(similarity * size - _EPS).astype(np.int64) + 1, 0)
        raw = h.tobytes()
        prefix = [raw[8 * (b - n) : 8 * (b - n + t)] for b, n, t in zip(ends.tolist(), size.tolist(), take.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("text_hash"), pa.array(np.array(sid, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary())],
            names=["doc_id", "text_hash", "sid", "n", "prefix", "sketch"],
        )


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            prefix = part.column("prefix").to_pylist()
            long = np.array([len(p) // 8 for p in prefix], np.int64)
            place = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            sid, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "n"))
            g = np.frombuffer(b"".join(prefix), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.repeat(sid, long)), pa.array(np.repeat(n, long), pa.int32()), pa.array(place, pa.int32())], names=["g", "sid", "n", "place"])


def _buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets of a partition sorted by g; a bucket may go over several batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or held and held[0][0][0] != now[0][0]:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now], strict=True)]
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _may(similarity: float, n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sets that meet first in this bucket may be similar, by their sizes and the shingle's places."""
    na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
    shared = np.minimum(na - place[a], nb - place[b])
    return shared >= np.ceil(similarity / (1 + similarity) * (na + nb) - _EPS)


def _shared(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets in which sets of near sizes meet, with the bucket's smallest set id where it may be similar."""
    for g, sid, n, place in _buckets(batches, ["g", "sid", "n", "place"]):
        if len(g) < 2:
            continue
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        near = (g[1:] == g[:-1]) & (n[:-1] >= similarity * n[1:] - _EPS)  # sorted by n inside a bucket
        keep = np.append(near, False) | np.append(False, near)
        bucket = np.cumsum(np.append(True, g[1:] != g[:-1])) - 1
        least = np.minimum.reduceat(sid, first)[bucket]
        head = np.zeros(len(first), np.int64)
        at = np.flatnonzero(sid == least)
        head[bucket[at]] = at
        ok = _may(similarity, n, place, np.arange(len(g)), head[bucket]) & (sid != least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g[keep]), pa.array(sid[keep]), pa.array(n[keep], pa.int32()), pa.array(place[keep], pa.int32()), pa.array(least[keep], mask=~ok[keep])],
            names=["g", "sid", "n", "place", "head"],
        )


def _differing(similarity: float, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """In how many shingles sets of these sizes may differ to be similar."""
    both = na.astype(np.int64) + nb
    return both - 2 * np.ceil(similarity / (1 + similarity) * both - _EPS)


def _plausible(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches allow."""
    for batch in batches:
        k = np.arange(batch.num_rows)
        known = Sketches(batch.column("s_u").to_pylist() + batch.column("s_v").to_pylist())
        na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_u", "n_v"))
        ok = pa.array(known.apart(k, k + len(k)) <= _differing(similarity, na, nb))
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], names=["u", "v"])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets with more than one root."""
    names = ["g", "sid", "n", "place", "root"]
    for rows in _buckets(batches, names):
        g, root = rows[0], rows[4]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        several = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
        keep = np.repeat(several, np.diff(np.append(first, len(g))))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], names=names)


class Forest:
    """Which roots the pairs listed so far join, if every one of them holds."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def needed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs of roots, in their order, that join what no pair before did."""
        out = []
        for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            x, y = self.top(x), self.top(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                out.append(i)
        return np.array(out, np.int64)


def _apart(similarity: float, large: int, every: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket, of different roots, that may be similar: every one, or only as many as join the roots."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    forest = Forest()

    def listed() -> pa.RecordBatch:
        both = np.unique(np.concatenate([np.stack(x, 1) for x in held] or [np.zeros((0, 2), np.int64)]), axis=0)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    def pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = _may(similarity, n, place, a, b)
        a, b = a[ok], b[ok]
        for k in range(0, len(a), PAIRS):
            x, y = a[k : k + PAIRS], b[k : k + PAIRS]
            slack = _differing(similarity, n[x], n[y]) - known.apart(x, y)
            near = np.flatnonzero(slack >= 0)
            if not every and len(near):
                # of each two roots the pair that is likeliest to hold
                left, right = np.minimum(root[x[near]], root[y[near]]), np.maximum(root[x[near]], root[y[near]])
                order = np.lexsort((-slack[near], right, left))
                near, left, right = near[order], left[order], right[order]
                new = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
                near, left, right = near[new], left[new], right[new]
                order = np.argsort(-slack[near], kind="stable")
                near = near[order][forest.needed(left[order], right[order])]
            u, v = sid[x[near]], sid[y[near]]
            held.append((np.minimum(u, v), np.maximum(u, v)))
            if sum(len(z[0]) for z in held) > PAIRS:
                yield listed()

    for g, sid, n, place, root, sketch in _buckets(batches, ["g", "sid", "n", "place", "root", "sketch"]):
        known = Sketches(sketch.tolist())
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        size = np.diff(np.append(first, len(g)))
        live, step = np.flatnonzero(np.repeat(size < large, size)), 1
        while len(live):
            live = live[live + step < len(g)]
            other = live + step
            near = (g[live] == g[other]) & (n[live] >= similarity * n[other] - _EPS)  # sorted by n: who is out stays out
            live, other = live[near], other[near]
            ok = root[live] != root[other]
            yield from pairs(live[ok], other[ok])
            step += 1
        for s, k in zip(first[size >= large].tolist(), size[size >= large].tolist(), strict=True):
            names, group, count = np.unique(root[s : s + k], return_inverse=True, return_counts=True)
            largest = group == int(np.argmax(count))
            members = np.arange(s, s + k)
            for i in np.flatnonzero(~largest).tolist():
                other = members[largest | ((np.arange(k) > i) & (group != group[i]))]
                yield from pairs(np.full(len(other), s + i), other)
    yield listed()


def _sets(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in blocks(batches, "text"):
        h, doc = shingle_sets(data, offs, shingle)
        ends = 8 * np.cumsum(np.bincount(doc, minlength=part.num_rows))
        raw = h.tobytes()
        yield pa.RecordBatch.from_arrays([part.column("sid"), pa.array([raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())], names=["sid", "members"])


def _verified(similarity: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("left", "right"))
        same = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        whole = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64) - same
        ok = pa.array(same >= similarity * whole - _EPS)
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], names=["u", "v"])


def _similar(docs: DataFrame, prints: DataFrame, candidates: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The candidates (u, v) that reach the similarity, by the sets of their texts."""
    wanted = candidates.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    which = prints.join(wanted, "sid").groupBy("sid").agg(F.min("text_hash").alias("text_hash"))
    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(which, "text_hash").select("sid", "text")
    sets = written(map_batches(texts, lambda it: _sets(shingle, it), "sid bigint, members binary")).dropDuplicates(["sid"])
    left, right = sets.select(F.col("sid").alias("u"), F.col("members").alias("left")), sets.select(F.col("sid").alias("v"), F.col("members").alias("right"))
    both = candidates.join(left, "u").join(right, "v").select("u", "v", "left", "right")
    return written(map_batches(both, lambda it: _verified(similarity, it), "u bigint, v bigint"))


def set_prints(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, sid (hash of the shingle set; 0 without words), its size n, first shingles and sketch, of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    return map_batches(row_key(docs), lambda it: _filed(shingle, similarity, sent.value, it), "doc_id bigint, text_hash bigint, sid bigint, n int, prefix binary, sketch binary")


def set_roots(docs: DataFrame, prints: DataFrame, shingle: int, similarity: float, suggested: DataFrame | None = None) -> DataFrame:
    """(sid, root) of every set that is linked to another one; ``prints`` is what ``set_prints`` gives, written.

    suggested: pairs (u, v), u < v, that another method found likely; they are checked with the first round's.
    """
    dealt = map_batches(prints.select("sid", "n", "prefix").filter("n > 0").dropDuplicates(["sid"]), _dealt, "g bigint, sid bigint, n int, place int")
    sorted_ = dealt.repartition("g").sortWithinPartitions("g", "n")
    shared = written(map_batches(sorted_, lambda it: _shared(similarity, it), "g bigint, sid bigint, n int, place int, head bigint"))
    near = shared.filter("head is not null").select(F.least("sid", "head").alias("u"), F.greatest("sid", "head").alias("v"))
    near = (near if suggested is None else near.unionByName(suggested)).distinct()
    sketch = prints.select("sid", "n", "sketch").filter("n > 0").dropDuplicates(["sid"])
    of = lambda x: sketch.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    near = written(map_batches(near.join(of("u"), "u").join(of("v"), "v"), lambda it: _plausible(similarity, it), "u bigint, v bigint"))
    found = _similar(docs, prints, near, shingle, similarity)
    roots, tested, open_ = connected(found).withColumnRenamed("node", "sid"), near, shared.drop("head")
    every, rounds = False, 0
    while True:
        rooted = open_.join(roots, "sid", "left").select("g", "sid", "n", "place", F.coalesce("root", "sid").alias("root"))
        mixed_ = written(map_batches(rooted.repartition("g").sortWithinPartitions("g"), _mixed, "g bigint, sid bigint, n int, place int, root bigint"))
        met = mixed_.join(sketch.select("sid", "sketch"), "sid").repartition("g").sortWithinPartitions("g", "n")
        listed = map_batches(met, lambda it, large=LARGE, every=every: _apart(similarity, large, every, it), "u bigint, v bigint").distinct()
        rest = written(listed.join(tested, ["u", "v"], "left_anti"))
        good = _similar(docs, prints, rest, shingle, similarity) if rest.limit(1).count() else None
        joined = good is not None and good.limit(1).count() > 0
        if joined:
            stars = roots.select(F.col("sid").alias("u"), F.col("root").alias("v"))
            roots = connected(stars.unionByName(good)).withColumnRenamed("node", "sid")
        if every:
            return roots
        # pairs that hold leave fewer pairs between different roots; then all that are left are listed
        rounds += 1
        every = not joined or rounds == ROUNDS
        tested, open_ = tested.unionByName(rest), mixed_.drop("root")
