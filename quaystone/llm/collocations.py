"""Phrase collocations of each language, mined by SON partitioning.

A phrase that occurs ``support`` times in a language reaches its proportional share of that in at least one shard. So:

1. Words are counted for each language and shard (SHARDS shards, by a hash of doc_id).
2. Every shard is mined completely at support * its share of the language's words, rounded up. A shard is as large as the
   corpus makes it, so it is spread over ranges of the phrases' hashes: tasks send sorted 40-bit hashes with counts, and
   one group for each language, shard and range keeps those that are locally frequent. The number of ranges follows
   the number of words, so a group stays the same size.
3. The union of what is locally frequent is a bitmap of phrase hashes, of at most MAX_BITS bits.
4. A second scan counts every phrase that the bitmap lets through, by its text. A false hit of the bitmap, or a collision of
   hashes in step 2, only means that a phrase is counted in vain: counts are exact.

All phrases of 1 to LONGEST words are mined, since the parts of a frequent phrase are frequent too and their counts
are needed for its cuts. In step 4 a task tells phrases of one chunk apart by 64-bit hashes.

Null text is empty, null lang is ``und``; repeated rows count each; ties are broken as ``rank_phrases`` says; texts of any
length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textblocks import FOLD, blocks, map_batches, member_table, mixed, span_hashes, table, text_bytes, word_bounds, written

SUPPORT, LONGEST, TOP = 30, 4, 2000
#: Containment: a phrase goes if a longer one around it has at least so many hundredths of its occurrences.
CONTAINED = 80
SHARDS = 8
#: Phrase hashes that a task holds before it sends them, and about as many as a group of the mining step meets.
CHUNK = 1 << 21
#: Bits of the bitmap for each candidate, and at most: 32 MB. Beyond that more phrases pass in vain; results stay the same.
BITS_EACH, MAX_BITS = 64, 28
#: Buckets of a language in which the best are found before they meet.
BUCKETS = 64

_BREAK = member_table(lambda b: b in b".,;:!?" or 10 <= b <= 13)
_WORD = member_table(lambda b: b not in b" \t.,;:!?" and not 10 <= b <= 13)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and piece numbers of the words in a block of lower-case bytes."""
    s, e, n = word_bounds(data, offs, _WORD)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    return s, e, breaks[s] + np.repeat(np.arange(len(n)), n)


def phrase_hashes(h: np.ndarray, piece: np.ndarray, seed: np.uint64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to LONGEST words: hashes of the phrases, which differ by language, and the number of their first word."""
    out, g = [], mixed(h + seed)
    at = np.arange(len(h))
    for n in range(1, LONGEST + 1):
        if n > 1:
            whole = piece[at[at + n - 1 < len(h)]] == piece[at[at + n - 1 < len(h)] + n - 1]
            keep = np.flatnonzero(at + n - 1 < len(h))[whole]
            at = at[keep]
            g = mixed(g[keep] * MULTIPLIER + h[at + n - 1])
        out.append((g, at))
    return out


def _parted(docs: DataFrame) -> DataFrame:
    """lang, shard and text; what the passes read."""
    lang = F.coalesce(F.col("lang"), F.lit("und")).alias("lang")
    return docs.select(lang, F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), "text")


def _parts(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch by their keys."""
    groups = pa.table({**{k: batch.column(k) for k in keys}, "_i": np.arange(batch.num_rows)}).group_by(list(keys)).aggregate([("_i", "list")])
    for row in groups.to_pylist():
        yield tuple(row[k] for k in keys), batch.take(pa.array(row["_i_list"]))


def seed_of(lang: str) -> np.uint64:
    data, offs = text_bytes(pa.array([lang]))
    return span_hashes(data, offs[:-1], offs[1:])[0] if len(data) else np.uint64(0)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, int] = {}
    for batch in batches:
        for part, data, offs in blocks([batch], "text"):
            n = pa.array(word_bounds(data, offs, _WORD)[2])
            sums = pa.table({"lang": part.column("lang"), "shard": part.column("shard"), "n": n}).group_by(["lang", "shard"]).aggregate([("n", "sum")])
            for row in sums.to_pylist():
                key = row["lang"], row["shard"]
                total[key] = total.get(key, 0) + row["n_sum"]
    yield pa.RecordBatch.from_pylist([{"lang": k[0], "shard": k[1], "n": n} for k, n in total.items()], schema=pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64())]))


def word_counts(docs: DataFrame, support: int) -> DataFrame:
    """lang, shard, its words, all words of the language, and the shard's local support."""
    each = map_batches(_parted(docs), _count_words, "lang string, shard int, n bigint").groupBy("lang", "shard").agg(F.sum("n").alias("n_shard"))
    whole = each.groupBy("lang").agg(F.sum("n_shard").alias("n"))
    share = F.ceil(F.col("n_shard").cast("decimal(20,0)") * support / F.col("n").cast("decimal(20,0)"))
    return each.join(whole, "lang").filter("n > 0").withColumn("local", F.greatest(share, F.lit(1)).cast("bigint"))


def packed(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 40-bit numbers and their counts as byte planes, compressed: planes of sorted numbers begin alike."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 4::-1].T
    return (pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True), pa.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True))


def unpacked(n: int, values: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.zeros((n, 8), np.uint8)
    raw[:, 4::-1] = np.frombuffer(pa.decompress(values, 5 * n, codec="zstd"), np.uint8).reshape(5, n).T
    c = np.ascontiguousarray(np.frombuffer(pa.decompress(counts, 4 * n, codec="zstd"), np.uint8).reshape(4, n).T)
    return raw.view("<u8").ravel().astype(np.uint64), c.view("<u4").ravel().astype(np.int64)


def _send(bits: int) -> Callable:
    """Phrase hashes of a task by language, shard and range (the first ``bits`` bits), counted within chunks."""
    chunk = CHUNK

    def emit(held: dict[tuple, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (lang, shard), arrays in held.items():
            u, c = np.unique(np.concatenate(arrays) >> np.uint64(24 - bits), return_counts=True)
            cuts = np.searchsorted(u, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(40))
            rows = []
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[r], cuts[r + 1]
                values, counts = packed(u[a:b] & np.uint64((1 << 40) - 1), c[a:b])
                rows.append({"lang": lang, "shard": shard, "part": r, "n": int(b - a), "hashes": values, "counts": counts})
            yield pa.RecordBatch.from_pylist(rows, schema=_SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for key, rows in _parts(batch, "lang", "shard"):
                seed = seed_of(key[0])
                for _, data, offs in blocks([rows], "text"):
                    lower = FOLD[data]
                    s, e, piece = words_of(lower, offs)
                    for g, _ in phrase_hashes(span_hashes(lower, s, e), piece, seed):
                        held.setdefault(key, []).append(g)
                        size += len(g)
                    if size >= chunk:
                        yield from emit(held)
                        held, size = {}, 0
        yield from emit(held)

    return run


_SENT = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def mine(group: pa.Table) -> pa.Table:
    """What is locally frequent in one language's shard and range of hashes."""
    parts = [unpacked(n, v, c) for n, v, c in zip(*(group.column(k).to_pylist() for k in ("n", "hashes", "counts")), strict=True)]
    v, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    keep = v[first][np.add.reduceat(c, first) >= group.column("local")[0].as_py()]
    values, _ = packed(keep, np.ones(len(keep), np.int64))
    return pa.table({"part": group.column("part").slice(0, 1), "n": pa.array([len(keep)], pa.int64()), "hashes": pa.array([values], pa.binary())})


def candidates(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Locally frequent phrases of every shard as packed hashes: part, n, hashes; ``part`` is a range of 2**range_bits(words)."""
    bits = range_bits(words)
    sent = map_batches(_parted(docs), _send(bits), "lang string, shard int, part int, n bigint, hashes binary, counts binary")
    joined = sent.join(words.select("lang", "shard", "local"), ["lang", "shard"])
    return joined.groupBy("lang", "shard", "part").applyInArrow(mine, "part int, n bigint, hashes binary")


def range_bits(words: DataFrame) -> int:
    total = words.agg(F.sum("n_shard")).first()[0] or 0
    return min(16, max(0, int(total * LONGEST // (SHARDS * CHUNK)).bit_length()))


def bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """Which first bits of a phrase's hash some candidate has, one bit each; ``bits``: of the ranges in ``found``."""
    total = found.agg(F.sum("n")).first()[0] or 0
    wide = min(MAX_BITS, max(bits + 3, 16, int(total * BITS_EACH).bit_length()))

    def slice_of(group: pa.Table) -> pa.Table:
        out = np.zeros(1 << (wide - bits), bool)
        for n, values in zip(group.column("n").to_pylist(), group.column("hashes").to_pylist(), strict=True):
            v, _ = unpacked(n, values, pa.compress(bytes(4 * n), codec="zstd", asbytes=True))
            out[v >> np.uint64(40 - (wide - bits))] = True
        return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    step = (1 << (wide - bits)) // 8
    whole = np.zeros((1 << wide) // 8, np.uint8)
    for row in found.groupBy("part").applyInArrow(slice_of, "part int, bits binary").toLocalIterator():  # 2**wide bits in all
        whole[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return whole


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans as an Arrow string column."""
    n = ends - starts
    offs = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(starts - offs[:-1], n) + np.arange(offs[-1])
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def count_candidates(docs: DataFrame, whole: np.ndarray, support: int) -> DataFrame:
    """lang, phrase, words, f: exact counts of all phrases that occur ``support`` times or more."""
    sent = docs.sparkSession.sparkContext.broadcast(whole)
    wide, chunk = len(whole).bit_length() + 2, CHUNK // 16  # phrases are held with their texts; Spark adds a task's counts up as well

    def counted(lang: str, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """held: word count, hashes, counts and texts of the distinct phrases of a block."""
        for n in range(1, LONGEST + 1):
            blocks_ = [h for h in held if h[0] == n and len(h[1])]
            if blocks_:
                u, first, at = np.unique(np.concatenate([h[1] for h in blocks_]), return_index=True, return_inverse=True)
                c = np.bincount(at, np.concatenate([h[2] for h in blocks_]), len(u)).astype(np.int64)
                texts = pa.chunked_array([h[3] for h in blocks_]).take(pa.array(first)).cast(pa.string()).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), texts, pa.array(np.full(len(u), n), pa.int32()), pa.array(c)], names=["lang", "phrase", "words", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        held: dict[str, list[tuple]] = {}
        size = 0
        for batch in batches:
            for (lang,), rows in _parts(batch, "lang"):
                seed = seed_of(lang)
                for _, data, offs in blocks([rows], "text"):
                    lower = FOLD[data]
                    s, e, piece = words_of(lower, offs)
                    for n, (g, at) in enumerate(phrase_hashes(span_hashes(lower, s, e), piece, seed), 1):
                        bit = g >> np.uint64(64 - wide)
                        hit = np.flatnonzero(known[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8)) & 1)
                        u, first, c = np.unique(g[hit], return_index=True, return_counts=True)
                        held.setdefault(lang, []).append((n, u, c, _phrases(lower, s, e, at[hit[first]], n)))
                        size += len(u)
                    if size >= chunk:
                        for key, parts in held.items():
                            yield from counted(key, parts)
                        held, size = {}, 0
        for key, parts in held.items():
            yield from counted(key, parts)

    found = map_batches(_parted(docs).select("lang", "text"), run, "lang string, phrase string, words int, f bigint")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= support)


def _phrases(data: np.ndarray, s: np.ndarray, e: np.ndarray, word: np.ndarray, n: int) -> pa.Array:
    """Phrases of ``n`` words from their first words on, joined by one space."""
    parts = [spans(data, s[word + k], e[word + k]) for k in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def _joined(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def rank_phrases(frequent: DataFrame, totals: DataFrame, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    frequent: lang, phrase, words, f, all phrases of a support (so every part of a phrase is there); totals: lang, n.
    The score is that of the worst cut, of equal ones the earliest; order by score and a, larger first, then by phrase. Products are decimals of 38 digits.
    """
    big = lambda c: c.cast("decimal(20,0)")
    w = F.split("phrase", " ")
    many = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), w.alias("w"))
    inner = many.filter("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))")).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = many.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (big(F.col("longer")) * 100 < big(F.col("a")) * contained)).drop("longer")
    cut = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.withColumn("first", _joined(F.col("w"), 1, F.col("k"))).withColumn("rest", _joined(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")))
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    scored = worst.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of a language are among the best of its buckets, so no task sorts all of them
    best = scored.withColumn("b", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).withColumn("i", F.row_number().over(Window.partitionBy("lang", "b").orderBy(*order))).filter(F.col("i") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """Collocations of 2 to LONGEST words of each language (``rank_phrases``)."""
    words = written(word_counts(docs, support))  # a row for each language and shard
    found = written(candidates(docs, words))
    whole = bitmap(found, range_bits(words))
    frequent = written(count_candidates(docs, whole, support))
    return rank_phrases(frequent, words.select("lang", "n").distinct(), top, contained)


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
