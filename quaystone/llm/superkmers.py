"""Super-k-mers: runs of consecutive windows that share their minimisers, for words or bytes.

A window is ``k`` consecutive units of one document; the m-gram of smallest hash among its m-grams is
its anchor, so equal windows have equal anchors wherever they stand. Consecutive windows of one
anchor form a run, described by 64 bits of the anchor and 64 of all its units (``sid``). Where an anchor has
very many different runs, they are split by minimisers of three quarters of a window's length: only what
shares so long a passage still meets, and a shorter one that many documents hold decides nothing.

Runs with equal (anchor, sid) are merged by a map-side aggregation, so a passage that a third of all
documents hold stays one row; one of each travels on as text, if its anchor has several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import INVERSE, ODD, powers, mixed

_PLACE = np.uint64((1 << 20) - 1)
#: Windows handled at once; with k it must stay under 2**20.
STEP = 1 << 17
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)

KEY = ["doc_id", "text_hash"]
RUNS = "doc_id bigint, text_hash bigint, anchor bigint, sid bigint, first int, n int, again boolean"


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w consecutive values."""
    n, s = len(h) - w + 1, 1
    while 2 * s <= w:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[:n], h[w - s : w - s + n])


def long_gram(k: int) -> int:
    """Length of the minimisers that split an anchor with very many runs."""
    return max(1, k - k // 4)


def runs(units: Callable[[int, int], np.ndarray], offs: np.ndarray, k: int, m: int, order: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, windows, anchor, sid, again) arrays of the runs in a block.

    units(a, b): 64-bit hashes of the units a..b of the block; offs: document borders in units.
    order: which order of hashes picks the minimiser that the windows of a run share.
    again: the anchor's place moves inside the run, so the run may hold one window twice.
    Works in steps of STEP windows, so a document of any length needs the same memory.
    """
    total, w, at_doc = int(offs[-1]), k - m + 1, np.arange(len(offs) - 1)
    for c in range(0, max(0, total - k + 1), STEP):
        hi = min(total, c + STEP + k - 1)
        size, count = hi - c, hi - c - k + 1
        power, inverse = powers(ODD, size + 1, 0), powers(INVERSE, size + 1, 1)
        p = np.zeros(size + 1, np.uint64)
        np.cumsum(units(c, hi) * power[:size], out=p[1:])
        gram = (p[m:] - p[:-m]) * inverse[: size - m + 1]
        place = np.arange(len(gram), dtype=np.uint64)
        low = sliding_min(mixed(gram ^ np.uint64(0x5851F42D4C957F2D * (order + 1) & (1 << 64) - 1)) & ~_PLACE | place, w)
        anchor = mixed(gram[low & _PLACE])
        doc = np.repeat(at_doc, np.diff(np.clip(offs, c, c + count)))
        here = np.arange(c, c + count)
        valid = offs[doc + 1] - here >= k
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        new[1:] |= valid[1:] & ~valid[:-1]
        last = valid.copy()
        last[:-1] &= ~valid[1:] | new[1:]
        a, b = np.flatnonzero(new), np.flatnonzero(last)
        n = b - a + 1
        sid = mixed((p[b + k] - p[a]) * inverse[a] + n.astype(np.uint64) * _SECOND)
        again = (low[a] & _PLACE) != (low[b] & _PLACE)
        d = doc[a]
        yield d, here[a] - offs[d], n, anchor[a], sid, again


def run_batch(part: pa.RecordBatch, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    d, first, n, anchor, sid, again = found
    at = pa.array(d)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").take(at), part.column("text_hash").take(at), pa.array(anchor.view(np.int64)), pa.array(sid.view(np.int64)), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(again)],
        names=["doc_id", "text_hash", "anchor", "sid", "first", "n", "again"],
    )


#: Distinct runs of an anchor from which they are split by longer minimisers.
HOT = 256


def merged_runs(found: DataFrame) -> DataFrame:
    """One row for each (anchor, sid): its smallest document, how often it occurs, one place of it."""
    return found.groupBy("anchor", "sid").agg(
        F.min("doc_id").alias("least"),
        F.count("*").alias("times"),
        F.min(F.struct("doc_id", "text_hash", "first", "n")).alias("at"),
        F.max("again").alias("again"),
    )


def contested(whole: DataFrame, needs: F.Column) -> DataFrame:
    """Rows of ``merged_runs`` whose anchor has something to compare; ``hot`` marks anchors with many.

    needs: a condition over n_sids, low, high (the smallest and largest ``least``) and again_any.
    """
    anchors = whole.groupBy("anchor").agg(F.count("*").alias("n_sids"), F.min("least").alias("low"), F.max("least").alias("high"), F.max("again").alias("again_any"))
    return whole.join(anchors.filter(needs).select("anchor", (F.col("n_sids") > HOT).alias("hot")), "anchor")


def wanted_by_document(rows: DataFrame) -> DataFrame:
    """The places whose text is asked for, gathered for each document (as many as it has runs at most)."""
    want = F.struct("anchor", "sid", "least", "times", "hot", F.col("at.first").alias("first"), F.col("at.n").alias("n"))
    return rows.groupBy(F.col("at.doc_id").alias("w_doc"), F.col("at.text_hash").alias("w_hash")).agg(F.collect_list(want).alias("wanted"))


def with_documents(docs: DataFrame, side: DataFrame, doc: str, text_hash: str) -> DataFrame:
    """Left join of (doc_id, text_hash, text) with rows that have one for each document."""
    return docs.join(side, docs["doc_id"].eqNullSafe(side[doc]) & (docs["text_hash"] == side[text_hash]), "left")
