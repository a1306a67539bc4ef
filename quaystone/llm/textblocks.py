"""Arrow helpers of the text operators: whole texts as byte blocks, words as offsets and hashes.

Every operator runs as ``mapInArrow`` over the partitions Spark planned. A task walks its batches
in blocks of a few MB, so its memory does not grow with the partition.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block holds; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

ODD = np.uint64(0x9E3779B97F4A7C15 & ~7 | 3)  # 3 modulo 8: powers stay far from 1 modulo 2**64
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one serves on a local master (tests); on a cluster it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            root = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(root)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage as a Parquet table in the shared folder: compact, and columns can be left unread."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_paths: dict[int, str] = {}


def forget(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more; other frames are left alone."""
    if path := _paths.pop(id(df), None):
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its values; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if offs is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return raw, o - o[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text each, with their bytes and offsets."""
    for batch in batches:
        data, offs = text_bytes(batch.column(column))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b


def word_bounds(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` bytes, and the number of runs of each text.

    member: 256 booleans. A run never crosses the border of two texts.
    """
    m = member[data]
    s, e = m.copy(), m.copy()
    if len(m):
        s[1:] &= ~m[:-1]
        e[:-1] &= ~m[1:]
        full = offs[1:] > offs[:-1]
        first, last = offs[:-1][full], offs[1:][full] - 1
        s[first], e[last] = m[first], m[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


_kept: list[np.ndarray] = []


def powers(base: np.uint64, n: int, slot: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, kept by each worker."""
    while len(_kept) < 2:
        _kept.append(np.ones(1, np.uint64))
    if len(_kept[slot]) < n:
        p = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        p[0] = 1
        _kept[slot] = np.multiply.accumulate(p)
    return _kept[slot][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h`` (one to one)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Bytes whose running sum is held at once; a longer block is worked off in such parts.
SUM_BYTES = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (ordered by start), from a running polynomial sum.

    The value of a span depends on its bytes alone, wherever it stands.
    """
    if len(data) > SUM_BYTES and len(starts):
        cuts = np.searchsorted(starts, np.arange(0, len(data) + SUM_BYTES, SUM_BYTES))
        parts = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                lo = int(starts[a])
                parts.append(_span_hashes(data[lo : int(ends[a:b].max())], starts[a:b] - lo, ends[a:b] - lo))
        return np.concatenate(parts)
    return _span_hashes(data, starts, ends)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(ODD, n, 0), out=total[1:])
    h = (total[ends] - total[starts]) * powers(INVERSE, n + 1, 1)[starts]
    return mixed(h + (ends - starts).astype(np.uint64))


def member_table(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(i) for i in range(256)], bool)


#: Bytes of words that white space ends (space and 9 to 13).
NOT_SPACE = member_table(lambda b: b != 32 and not 9 <= b <= 13)
#: ASCII letters folded to lower case.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def row_key(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, with ``text_hash``: rows that agree in all three are alike."""
    return df.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
