"""Quality classifier: logistic regression on hashed word n-grams, fitted with FTRL-proximal.

A text's features are the shares of its hashed 1- and 2-grams (words are runs of letters and digits,
other visible characters form words of their own; a word that comes again at once counts once more,
in a slot that all such words share); its score is a sparse dot product with the
weights. Scores read the text alone. An empty or null text has no n-grams and gets the bias.

The fit takes at most about ``sample_docs`` labelled ids, chosen by a hash of doc_id (documented
bound), in one task; the weights have a fixed size (2**BITS) and are broadcast for scoring.

Repeated rows are scored each; of several texts for one labelled id the one of the smallest hash is fitted, of
several labels the commoner (1 if even); rows and labels without an id are not fitted; texts of any length are
read whole; an empty table gives no rows, and without labels every score is one half; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks, map_batches, member_table, mixed, span_hashes, table, word_bounds

BITS = 18
SAMPLE_DOCS = 8000
THRESHOLD = 0.7
#: Features are shares of a text, so small; they are multiplied by this.
SCALE = 16.0
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 4

#: Slots of "the same word again" next to it and after one other.
AGAIN = (12345, 54321)
LETTERS = member_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
MARKS = member_table(lambda b: 33 <= b <= 126 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram indices of the texts in a block, text after text, and the offsets of each text."""
    s1, e1, _ = word_bounds(data, offs, LETTERS)
    s2, e2, _ = word_bounds(data, offs, MARKS)
    s = np.concatenate([s1, s2])
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.concatenate([e1, e2])[order]
    h = span_hashes(data, s, e)
    bounds = np.searchsorted(s, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) else h
    inside = doc[:-1] == doc[1:]
    shift = np.uint64(64 - BITS)
    # a word that comes again at once, or after one other, is an n-gram of its own whatever the word
    again = [np.flatnonzero((h[:-k] == h[k:]) & (doc[:-k] == doc[k:])) for k in (1, 2)]
    index = np.concatenate([(h >> shift).astype(np.int64), (pair[inside] >> shift).astype(np.int64), *(np.full(len(a), AGAIN[k]) for k, a in enumerate(again))])
    owner = np.concatenate([doc, doc[:-1][inside], *(doc[a] for a in again)])
    order = np.argsort(owner, kind="stable")
    return index[order], np.searchsorted(owner[order], np.arange(len(offs)))


def linear(weights: np.ndarray, bias: float, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores before the logistic function: bias plus SCALE times the mean weight of a text's n-grams."""
    total = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
    n = np.diff(at)
    return bias + SCALE * (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, l1: float = L1) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (indices, values, label) in the given order; the bias has no penalty."""
    size = 1 << bits
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(EPOCHS):
        for idx, val, y in rows:
            zi, ni = z[idx], n[idx]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            wb = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ val + wb, -35, 35)))
            g = (p - y) * val
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[idx] = zi + g - sigma * wi
            n[idx] = ni + g * g
            gb = p - y
            sb = (np.sqrt(n[size] + gb * gb) - np.sqrt(n[size])) / ALPHA
            z[size] += gb - sb * wb
            n[size] += gb * gb
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:size].astype(np.float32), float(-z[size] / ((BETA + np.sqrt(n[size])) / ALPHA))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in blocks(batches, "text"):
        index, at = features(data, offs)
        idx, cnt = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            u, c = np.unique(index[a:b], return_counts=True)
            idx.append(u.astype(np.int32).tobytes())
            cnt.append(c.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], names=["doc_id", "y", "idx", "cnt"])


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for d, y, i, c in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "y", "idx", "cnt")), strict=True):
            v = np.frombuffer(c, np.int32)
            rows.append((d, np.frombuffer(i, np.int32), (SCALE * v / max(1, v.sum())).astype(np.float32), y))
    # an order that no property of the text decides
    rows.sort(key=lambda r: (int(mixed(np.array([r[0]], np.int64).view(np.uint64))[0]), r[3], len(r[1])))
    weights, bias = ftrl([r[1:] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])


def held_out(fold: int = 4, rest: int = 2) -> F.Column:
    """crc32 of doc_id as text leaves ``rest``; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample_docs: int) -> DataFrame | None:
    """doc_id, y and text of about ``sample_docs`` labelled ids that are not held out; None without any.

    Null labels are left out; of several for a doc_id the larger mean side wins; of several texts the one of smallest hash.
    """
    known = labels.select("doc_id", column).dropna().filter(~held_out()).groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y"))
    total = known.count()
    if not total:
        return None
    kept = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / total)))
    picked = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id")  # about sample_docs rows of two numbers
    once = picked.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))  # so the bound holds
    return once.select("doc_id", "y", F.col("t.text").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows that are not held out.

    labels: doc_id, quality (null labels are left out; of several for a doc_id the larger mean side
    wins). Without any labelled row the weights are zero and the bias is that of the label prior 1/2.
    """
    picked = labelled(docs, labels, "quality", sample_docs)
    if picked is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    seen = map_batches(picked, _featurise, "doc_id bigint, y int, idx binary, cnt binary")
    # the shuffle keeps the featurising parallel; the bounded sample meets in one task
    row = seen.repartition(1).mapInArrow(_fit, "weights binary, bias double").first()
    return np.frombuffer(row["weights"], np.float32), row["bias"]


def scores(part: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, model: tuple[np.ndarray, float]) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(linear(*model, *features(data, offs)), -35, 35)))


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and the score of each whole text.

    One map over the scan; the broadcast holds 2**BITS weights (1 MB) whatever the corpus size.
    """
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part, data, offs, sent.value))], names=["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, score double")


def keep_quality(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in blocks(batches, "text"):
            yield part.filter(pa.array(scores(part, data, offs, sent.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, *model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
