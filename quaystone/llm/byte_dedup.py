"""Substring dedup on bytes: repeated strings of ``LENGTH`` bytes, found by external induced sorting.

A byte is removed when a string of LENGTH bytes that covers it also starts anywhere else, in the same
document or another. Strings are judged on the input; overlaps count; no string crosses documents.

What is sorted: runs of windows that share their smallest 32-gram meet by that anchor. Runs that are
alike as a whole are merged before the shuffle (128 bits of hash), as copies may be a third of all
rows; such a run is repeated throughout. Of anchors with several different runs, or runs that may repeat
inside themselves, one packed string each goes to its bucket, and whole buckets form the shards: all
suffixes of a shard are put in order, and neighbours that share LENGTH bytes stand twice. (Equal windows
have equal anchors, so no repeat is split between shards.) A shard has SHARD_BYTES, or as many as its one
bucket has; what it needs above the limit of ``suffixes`` is kept in files of the task.

Null and empty texts have no bytes; rows that are equal repeat each other, so they lose all from
LENGTH bytes on; a null doc_id is a document like any other; texts of any length are read whole, in steps;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixes import LIMIT, Space, Strings, repeated
from .superkmers import RUNS, contested, long_gram, merged_runs, run_batch, runs, wanted_by_document, with_documents
from .textblocks import blocks, map_batches, mixed, row_key, table, written

LENGTH = 400
GRAM = 32
#: Bytes of packed strings that make a shard; a larger bucket is a shard of its own.
SHARD_BYTES = 3 << 20

_UNIT = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in blocks(batches, "text"):
        for found in runs(lambda a, b, data=data: _UNIT[data[a:b]], offs, k, min(GRAM, k)):
            yield run_batch(part, found)


PACKED = "bucket bigint, anchor bigint, sid bigint, times bigint, shift int, n int, body binary"


def _pack(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs."""
    types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    for part, data, offs in blocks(batches, "text"):
        rows: list[tuple] = []
        whole = data.tobytes()
        for i, wanted in enumerate(part.column("wanted").to_pylist()):
            for x in wanted or ():
                at = int(offs[i]) + x["first"]
                mine = whole[at : at + x["n"] + k - 1]
                if x["hot"]:
                    raw = np.frombuffer(mine, np.uint8)
                    for _, first, n, anchor, _, _ in runs(lambda a, b, raw=raw: _UNIT[raw[a:b]], np.array([0, len(mine)]), k, long_gram(k), 1):
                        rows += [(c, x["anchor"], x["sid"], x["times"], f, z, mine[f : f + z + k - 1]) for f, z, c in zip(first.tolist(), n.tolist(), anchor.view(np.int64).tolist(), strict=True)]
                else:
                    rows.append((x["anchor"], x["anchor"], x["sid"], x["times"], 0, x["n"], mine))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "anchor", "sid", "times", "shift", "n", "body"])


def _shards(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come in order; whole ones are gathered into shards and sorted."""
    held: list[tuple] = []
    strings = Strings(Space(LIMIT))

    def solve() -> pa.RecordBatch:
        twice = repeated(strings, k)
        out, at = [], 0
        for _, anchor, sid, shift, n in held:
            hit = np.flatnonzero(np.diff(np.concatenate([[0], twice[at : at + n], [0]]).astype(np.int8)))
            out += [(anchor, sid, shift + a, shift + b) for a, b in hit.reshape(-1, 2).tolist()]
            at += n + k  # n windows are n + k - 1 bytes, and one more place closes them
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["anchor", "sid", "a", "b"])

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "anchor", "sid", "shift", "n", "body")), strict=True):
            if strings.size > SHARD_BYTES and r[0] != held[-1][0]:
                yield solve()
                held.clear()
                strings = Strings(Space(LIMIT))
            held.append(r[:5])
            strings.add(r[5])
    if held:
        yield solve()


def _remove(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in blocks(batches, "text"):
        whole, removed, spans_, digest, kept = data.tobytes(), [], [], [], []
        for i, spans in enumerate(part.column("spans").to_pylist()):
            raw, merged = whole[offs[i] : offs[i + 1]], []
            for a, b in sorted((x["a"], x["b"] + k - 1) for x in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            at, rest = 0, []
            for a, b in merged:
                rest.append(raw[at:a])
                at = b
            rest = b"".join([*rest, raw[at:]])
            removed.append(len(raw) - len(rest))
            spans_.append(len(merged))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeated_bytes(docs: DataFrame, k: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row.

    Documents are dealt out by their key once (both joins use that exchange). A run, some 40 bytes,
    stands for about 185 windows.
    """
    keyed = row_key(docs)
    found = written(map_batches(keyed, lambda it: _runs(k, it), RUNS))
    whole = merged_runs(found)
    rows = contested(whole, (F.col("n_sids") > 1) | F.col("again_any"))
    packed = map_batches(with_documents(keyed, wanted_by_document(rows), "w_doc", "w_hash").select("text", "wanted"), lambda it: _pack(k, it), PACKED)
    buckets = packed.repartition("bucket").sortWithinPartitions("bucket")
    part = map_batches(buckets, lambda it: _shards(k, it), "anchor bigint, sid bigint, a int, b int")
    part = part.groupBy("anchor", "sid").agg(F.collect_list(F.struct("a", "b")).alias("part"))
    verdict = whole.filter("times > 1").select("anchor", "sid", "times").join(part, ["anchor", "sid"], "full")
    hit = found.join(verdict, ["anchor", "sid"]).select(
        F.col("doc_id").alias("s_doc"),
        F.col("text_hash").alias("s_hash"),
        F.when(F.col("times") > 1, F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b"))))
        .otherwise(F.transform("part", lambda x: F.struct((x["a"] + F.col("first")).alias("a"), (x["b"] + F.col("first")).alias("b"))))
        .alias("spans"),
    )
    spans = hit.groupBy("s_doc", "s_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return map_batches(with_documents(keyed, spans, "s_doc", "s_hash").select("doc_id", "text", "spans"), lambda it: _remove(k, it), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op2_byte_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")
