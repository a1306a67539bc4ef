"""Substring dedup on words: super-k-mers to buckets, where sorting counts windows exactly.

A window is ``WINDOW`` consecutive words; a word is removed when a window that covers it also starts
in a document with a smaller doc_id. Windows are judged on the input.

Runs of windows that are alike as a whole (128 bits of hash) are merged before the shuffle, as copies
may be a third of all rows: all of them outside the smallest document repeat it. Of the rest one packed
string each goes to the bucket of its anchor; there the windows are sorted, and equal ones (compared word by
word) take the smallest document among them. Anchors with very many strings are split by longer minimisers.

Null texts have no words; texts under WINDOW words lose nothing; rows with a null doc_id have no
order, so they lose nothing and take nothing; rows with one doc_id don't repeat each other, and
each keeps a row of its own; texts of any length are read whole, in steps; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .superkmers import RUNS, contested, long_gram, merged_runs, run_batch, runs, wanted_by_document, with_documents
from .textblocks import INVERSE, NOT_SPACE, ODD, blocks, map_batches, mixed, powers, row_key, span_hashes, table, word_bounds, written

WINDOW = 50
GRAM = 8
#: Bytes of packed strings that are sorted at once; a larger bucket is sorted whole.
SORT_BYTES = 6 << 20


def _runs(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in blocks(batches, "text"):
        s, e, n = word_bounds(data, offs, NOT_SPACE)
        h = span_hashes(data, s, e)
        for found in runs(lambda a, b, h=h: h[a:b], np.concatenate([[0], np.cumsum(n)]), k, min(GRAM, k)):
            yield run_batch(part, found)


PACKED = "bucket bigint, anchor bigint, sid bigint, least bigint, shift int, n int, words binary"


def _pack(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings (words joined by one space) of the wanted runs."""
    for part, data, offs in blocks(batches, "text"):
        rows: list[tuple] = []
        whole = data.tobytes()
        for i, wanted in enumerate(part.column("wanted").to_pylist()):
            if not wanted:
                continue
            words = whole[offs[i] : offs[i + 1]].split()
            for x in wanted:
                mine = words[x["first"] : x["first"] + x["n"] + k - 1]
                if x["hot"]:
                    own = b" ".join(mine)
                    e = np.cumsum([len(w) + 1 for w in mine]) - 1
                    h = span_hashes(np.frombuffer(own, np.uint8), np.concatenate([[0], e[:-1] + 1]), e)
                    for _, first, n, anchor, _, _ in runs(lambda a, b, h=h: h[a:b], np.array([0, len(mine)]), k, long_gram(k), 1):
                        rows += [(int(c), x["anchor"], x["sid"], x["least"], int(f), int(z), b" ".join(mine[f : f + z + k - 1])) for f, z, c in zip(first, n, anchor.view(np.int64), strict=True)]
                else:
                    rows.append((x["anchor"], x["anchor"], x["sid"], x["least"], 0, x["n"], b" ".join(mine)))
        if rows:
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "anchor", "sid", "least", "shift", "n", "words"])


def count_windows(rows: list[dict], k: int) -> Iterator[tuple[dict, int, int]]:
    """(row, first, end): windows of a row that also stand in a row with a smaller ``least``."""
    data = b"\n".join(r["words"] for r in rows)
    size = np.array([len(r["words"]) + 1 for r in rows])
    offs = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(data + b"\n", np.uint8)
    s, e, n = word_bounds(raw, offs, NOT_SPACE)
    h = span_hashes(raw, s, e)
    base = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(rows)), np.maximum(n - k + 1, 0))
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(n - k + 1, 0)) - np.maximum(n - k + 1, 0), np.maximum(n - k + 1, 0))
    at = base[owner] + shift
    p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(ODD, len(h), 0), dtype=np.uint64)])
    window = mixed((p[at + k] - p[at]) * powers(INVERSE, len(h) + 1, 1)[at])
    least = np.array([r["least"] for r in rows], np.int64)[owner]
    order = np.lexsort((least, window))
    same = np.flatnonzero(window[order][1:] == window[order][:-1]) + 1
    smallest = least.copy()
    text = data + b"\n"
    for j in same.tolist():  # the neighbour before is equal by hash: compare the words themselves
        x, y = at[order[j]], at[order[j - 1]]
        if text[s[x] : e[x + k - 1]] == text[s[y] : e[y + k - 1]]:
            smallest[order[j]] = smallest[order[j - 1]]
    hit = smallest < least
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)) | np.concatenate([[1], np.diff(owner) != 0, [1]]) if len(owner) else np.zeros(1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hit[a]:
            r = rows[owner[a]]
            yield r, int(shift[a]) + r["shift"], int(shift[a]) + r["shift"] + b - a


def _sorted_buckets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come in order; whole ones are gathered up to SORT_BYTES and sorted together."""
    held: list[dict] = []
    size = 0

    def solve(rows: list[dict]) -> pa.RecordBatch:
        out = [(r["anchor"], r["sid"], a, b) for r, a, b in count_windows(rows, k)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["anchor", "sid", "a", "b"])

    for batch in batches:
        for r in batch.to_pylist():
            if size > SORT_BYTES and r["bucket"] != held[-1]["bucket"]:
                yield solve(held)
                held, size = [], 0
            held.append(r)
            size += len(r["words"])
    if held:
        yield solve(held)


def _remove(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in blocks(batches, "text"):
        whole, total, removed, kept = data.tobytes(), [], [], []
        for i, spans in enumerate(part.column("spans").to_pylist()):
            words = whole[offs[i] : offs[i + 1]].split()
            gone = 0
            if spans:
                cover = np.zeros(len(words) + 1, np.int32)
                for x in spans:
                    cover[x["a"]] += 1
                    cover[x["b"] + k - 1] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                gone = len(words) - int(keep.sum())
                total.append(len(words))
                words = [w for w, y in zip(words, keep.tolist(), strict=True) if y]
            else:
                total.append(len(words))
            removed.append(gone)
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept]), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def remove_repeated_words(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every row.

    Documents are dealt out by their key once (both joins use that exchange); what else moves are
    runs of some 40 bytes for about twenty windows each, and the packed strings that need sorting.
    """
    keyed = row_key(docs)
    found = written(map_batches(keyed.filter(F.col("doc_id").isNotNull()), lambda it: _runs(k, it), RUNS))
    whole = merged_runs(found)
    rows = contested(whole, F.col("low") < F.col("high"))
    packed = map_batches(with_documents(keyed, wanted_by_document(rows), "w_doc", "w_hash").select("text", "wanted"), lambda it: _pack(k, it), PACKED)
    buckets = packed.repartition("bucket").sortWithinPartitions("bucket")
    part = map_batches(buckets, lambda it: _sorted_buckets(k, it), "anchor bigint, sid bigint, a int, b int")
    part = part.groupBy("anchor", "sid").agg(F.collect_list(F.struct("a", "b")).alias("part"))
    verdict = whole.filter("times > 1").select("anchor", "sid", "least").join(part, ["anchor", "sid"], "full")
    # the smallest document of a run loses what sorting found, later ones the whole run
    hit = found.join(verdict, ["anchor", "sid"]).select(
        F.col("doc_id").alias("s_doc"),
        F.col("text_hash").alias("s_hash"),
        F.when(F.col("doc_id") > F.col("least"), F.array(F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b"))))
        .otherwise(F.transform("part", lambda x: F.struct((x["a"] + F.col("first")).alias("a"), (x["b"] + F.col("first")).alias("b"))))
        .alias("spans"),
    )
    spans = hit.filter("spans is not null").groupBy("s_doc", "s_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return map_batches(with_documents(keyed, spans, "s_doc", "s_hash").select("doc_id", "text", "spans"), lambda it: _remove(k, it), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op8_word_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents")).drop("kept")
