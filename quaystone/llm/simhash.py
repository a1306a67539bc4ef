"""SimHash near-duplicates, with pivot distance tables in front of the exact comparison.

A fingerprint has 64 bits, from the XXH64 hashes of a text's word shingles. Two fingerprints link
when they differ in at most ``RADIUS`` bits; documents of linked fingerprints form components.

Finding the links: equal fingerprints are merged first. The 64 bits are cut into RADIUS + 2 blocks,
so two linked fingerprints agree in at least two of them; each fingerprint goes to the bucket of
every pair of its blocks (10 rows of 20 bytes, whatever the text). Inside a bucket the rows are
sorted by their distance to the first pivot and compared along that order only as long as it allows;
the other pivots' distances discard a pair when one coordinate differs by more than RADIUS, and
what survives is verified by its own Hamming distance. Nothing is capped: a bucket of any size is
worked off, and it gives one row for each member, not for each pair.

Null and empty texts have fingerprint zero and link like any other; a null doc_id keeps its row but
gives no component number; repeated rows and ids share a component; texts of any length are read whole; an empty
table gives no rows; other columns are ignored.

``keep_one`` drops near copies: what these links suggest, over fingerprints of five-word shingles, is checked by
whole shingle sets and joined first. Fingerprints of texts with a similarity of 0.8 lie 5 to 11 bits apart in the small tables,
and no radius is sure to find all of them, so links between different groups that are still missing come from jaccard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .jaccard import set_prints, set_roots
from .textblocks import map_batches, row_key, table, text_bytes, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: What ``keep_one`` calls a near copy, whatever op10_simhash reports.
KEEP_SHINGLE = 5
KEEP_SIMILARITY = 0.8
PIVOTS = np.random.default_rng(7).integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8, as a signed 64-bit number."""
    from xxhash import xxh64_digest

    words = raw.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)  # most significant first
    n = len(bits)
    set_ = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(set_).view(">i8")[0])


def _fingerprints(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        whole = data.tobytes()
        fp = [fingerprint(whole[a:b], shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fp, pa.int64())], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (signed 64-bit) of every row; one map over the scan."""
    return map_batches(row_key(docs), lambda it: _fingerprints(shingle, it), "doc_id bigint, text_hash bigint, fp bigint")


#: Pairs that are held before they are reduced to one for each row.
PAIRS = 1 << 18


def _within(fp: np.ndarray, key: np.ndarray, radius: int, said: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one key whose fingerprints differ in at most ``radius`` bits, some at a time.

    Rows are sorted by key and, inside it, by distance to the first pivot. said: gets how many pairs met, and how many
    of them the pivots let through.
    """
    coordinate = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    live, step, n = np.arange(len(fp)), 1, len(fp)
    while len(live):
        live = live[live + step < n]
        other = live + step
        near = (key[live] == key[other]) & (coordinate[other, 0] - coordinate[live, 0] <= radius)
        live, other = live[near], other[near]  # sorted: who is out stays out
        a, b = live, other
        for k in range(1, len(PIVOTS)):
            if not len(a):
                break
            ok = np.abs(coordinate[a, k] - coordinate[b, k]) <= radius
            a, b = a[ok], b[ok]
        if said is not None:
            said[0] += len(live)
            said[1] += len(a)
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if ok.any():
            yield a[ok], b[ok]
        step += 1


def _stars(count: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The first row of each row's component among the pairs; no more than PAIRS and one a row are held."""
    label, held, size = np.arange(count), [], 0

    def reduce() -> None:
        a, b = (np.concatenate(x) for x in zip(*held, (np.arange(count), label), strict=True))
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label[:] = label[label]
            if (label == before).all():
                break
        held.clear()

    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size > PAIRS:
            reduce()
            size = 0
    if held:
        reduce()
    return label


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of a partition sorted by bucket; a bucket may go over several batches."""
    held: tuple[np.ndarray, np.ndarray] | None = None

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = _stars(len(fp), _within(fp, key, RADIUS))
        member = np.flatnonzero(first != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[member].view(np.int64)), pa.array(fp[first[member]].view(np.int64))], names=["u", "v"])

    for batch in batches:
        key = batch.column("bucket").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if held is not None:
            key, fp = np.concatenate([held[0], key]), np.concatenate([held[1], fp])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield solve(key[:cut], fp[:cut])
        held = key[cut:], fp[cut:]
    if held is not None and len(held[0]):
        yield solve(*held)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) links that connect what the fingerprints within ``radius`` connect; ``distinct`` has column fp."""
    count = radius + 2
    edges = [round(64 * i / count) for i in range(count + 1)]
    mask = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(count)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    pairs = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(mask[i] | mask[j])))) for k, (i, j) in enumerate(combinations(range(count), 2))]
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(PIVOTS[:1].view(np.int64)[0]))))
    rows = distinct.select("fp", first.alias("near"), F.explode(F.array(*pairs)).alias("bucket"))
    sorted_ = rows.repartition("bucket").sortWithinPartitions("bucket", "near")
    return map_batches(sorted_.select("bucket", "fp"), _linked, "u bigint, v bigint")


def _members(prints: DataFrame) -> DataFrame:
    """fp and the root of its component, with the smallest row of each fp."""
    alone = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected(links(alone.select("fp")))  # of linked fingerprints only
    return alone.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the component) of every row."""
    prints = written(fingerprints(docs))
    grouped = _members(prints.select("doc_id", "fp"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = grouped.join(least, "root").select("fp", "component_id")
    return prints.select("doc_id", "fp").join(members, "fp")


def suggested(prints: DataFrame, fps: DataFrame) -> DataFrame:
    """Pairs (u, v) of set ids whose texts have equal or linked fingerprints: as many as connect them, not all.

    prints: of ``set_prints``; fps: of ``fingerprints``, of the same rows.
    """
    named = prints.filter("n > 0").select("text_hash", "sid").distinct().join(fps.select("text_hash", "fp").distinct(), "text_hash").select("sid", "fp").distinct()
    first = named.groupBy("fp").agg(F.min("sid").alias("first"))
    equal = named.join(first, "fp").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    of = lambda x, y: first.select(F.col("fp").alias(x), F.col("first").alias(y))
    linked = links(first.select("fp")).join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
    return equal.unionByName(linked).filter("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def keep_one(docs: DataFrame, shingle: int = KEEP_SHINGLE, similarity: float = KEEP_SIMILARITY) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest doc_id (nulls last).

    Rows link when their sets of ``shingle`` words have a Jaccard similarity of ``similarity`` at least;
    null and empty texts link to each other. SimHash links come first, each checked by the sets.
    """
    prints = written(set_prints(docs, shingle, similarity))
    near = written(suggested(prints, written(fingerprints(docs, shingle))))
    roots = set_roots(docs, prints, shingle, similarity, near)
    rows = prints.join(roots, "sid", "left").select("doc_id", "text_hash", F.coalesce("root", "sid").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    keepers = rows.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("k_doc"), F.col("k.text_hash").alias("k_hash"))
    kept = docs.join(keepers, docs["doc_id"].eqNullSafe(keepers["k_doc"]) & (F.xxhash64(docs["text"]) == keepers["k_hash"]), "left_semi")
    twice = prints.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if twice else kept  # rows that agree in both have no order


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
