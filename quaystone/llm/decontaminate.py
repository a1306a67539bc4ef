"""Benchmark decontamination with an FM-index per shard of the corpus.

A shard is a run of documents inside one task. Its words become numbers of the benchmark's
vocabulary (0: any other word), stretches that are too short to hold a window are dropped, and the
rest gets a suffix order, its Burrows-Wheeler transform, a wavelet matrix with ranks and sampled
suffix positions. All windows of the benchmark search backwards at once; occurrences are located
through the samples and merged into removal spans.

What is broadcast is bounded: items of more than ITEM_WORDS words are cut into pieces that share WINDOW - 1 words (so
no window is lost), and a benchmark above ``MAX_BENCHMARK_BYTES`` is worked off in parts of that size, one
map after the other, of about 21 bytes a window (some 10 MB).

Null and empty texts have no words; texts of any length are read whole (a longer one than a shard is a
shard); repeated rows are treated alike; benchmark items without words have no window; equal windows of several
items count for each; windows of items without an id hit words but name no item; an empty benchmark hits
nothing; empty documents give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textblocks import FOLD, blocks, member_table, span_hashes, table, text_bytes, word_bounds, written

WINDOW = 10
SAMPLE_RATE = 8
MAX_BENCHMARK_BYTES = 3 << 20
ITEM_WORDS = 20_000
#: Parts whose maps follow each other in one job.
PARTS_AT_ONCE = 4
SHARD_BYTES = 4 << 20
#: Word bytes once A-Z are lower-cased: digits, a-z and everything outside ASCII.
WORD = member_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, spans array<struct<start:int,end:int>>, items array<bigint>"


class Phrases:
    """The benchmark's distinct windows over a vocabulary of word numbers (from 1)."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        data, offs = text_bytes(pa.array([t for _, t in items], pa.string()))
        data = FOLD[data]
        s, e, n = word_bounds(data, offs, WORD)
        self.vocabulary, ids = np.unique(span_hashes(data, s, e), return_inverse=True)
        self.text = (ids + 1).astype(np.int32)
        at = np.concatenate([[0], np.cumsum(n)])
        windows = np.where(n > 0, np.maximum(n - WINDOW, 0) + 1, 0)
        owner = np.repeat(np.arange(len(items)), windows)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + at[owner]
        length = np.minimum(n, WINDOW)[owner]
        rows = self._rows(first, length)
        _, one, same = np.unique(rows.view(f"V{rows.itemsize * WINDOW}").ravel(), return_index=True, return_inverse=True)
        self.first, self.length = first[one].astype(np.int32), length[one].astype(np.int64)
        # the ids of the items that have a window, one after the other
        known = np.array([i is not None for i, _ in items], bool)[owner]
        item = np.array([i or 0 for i, _ in items], np.int64)[owner]
        pairs = np.unique(np.stack([same[known], item[known]], 1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
        self.item, self.item_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)).astype(np.int32)
        #: Words of windows below full length: a stretch that holds one of them may be short.
        self.short = np.zeros(len(self.vocabulary) + 1, bool)
        self.short[self._rows(self.first, self.length)[self.length < WINDOW]] = True
        self.short[0] = False
        self._words = None

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def _rows(self, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Windows as rows of word numbers, padded with 0 at the left."""
        k = np.arange(WINDOW) - WINDOW
        place = first[:, None] + length[:, None] + k
        return np.where(k >= -length[:, None], self.text[np.maximum(place, 0)], 0).astype(np.int32) if len(self.text) else np.zeros((len(first), WINDOW), np.int32)

    @property
    def words(self) -> np.ndarray:
        if self._words is None:
            self._words = self._rows(self.first, self.length)
        return self._words

    def items(self, window: int) -> list[int]:
        return self.item[self.item_at[window] : self.item_at[window + 1]].tolist()

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        k = np.searchsorted(self.vocabulary, h)
        k[k == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[k] == h, k + 1, 0)


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t, each read up to its next 0; equal ones stand in text order.

    Prefix doubling, as many rounds as the longest stretch between zeros asks for.
    """
    n, bits = len(t), max(1, int(t.max()).bit_length())
    zero = np.flatnonzero(t == 0)
    left = zero[np.searchsorted(zero, np.arange(n))] - np.arange(n)  # symbols before the next 0
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(step):
        key <<= bits
        if i < n:
            key[: n - i] |= np.where(left[: n - i] >= i, t[i:], 0)
    while True:
        order = np.argsort(key, kind="stable")
        if step > left.max():
            return order
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = np.where(left[: n - step] >= step, new[step:] + 1, 0)
        key = new * (n + 2) + after
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit plane for each bit, with counts of ones before each place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits = bits
        now = symbols.astype(np.int32)
        for b in reversed(range(bits)):
            bit = (now >> b) & 1
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place``; both are arrays."""
        low, high = np.zeros_like(place), place
        for k, ones in enumerate(self.planes):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            a, b = ones[low], ones[high]
            low = np.where(bit, self.zeros[k] + a, low - a)
            high = np.where(bit, self.zeros[k] + b, high - b)
        return high - low


class FMIndex:
    def __init__(self, t: np.ndarray):
        """t: symbols; 0 separates stretches and stands at the end."""
        self.size = len(t)
        order = suffix_order(t)
        self.bwt = t[order - 1]
        top = int(t.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=top))])
        self.tree = WaveletMatrix(self.bwt, max(1, int(top - 1).bit_length()))
        # the first place of each stretch is sampled too: no step ever crosses a 0
        self.sampled = (order % SAMPLE_RATE == 0) | (self.bwt == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns (rows, padded with 0 at the left)."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.size, np.int64)
        for k in reversed(range(words.shape[1])):
            c = words[:, k]
            live = np.flatnonzero((c > 0) & (low < high))
            if not len(live):
                continue
            x = c[live]
            known = x < len(self.before) - 1
            high[live[~known]] = low[live[~known]]
            live, x = live[known], x[known]
            low[live], high[live] = self.before[x] + self.tree.rank(x, low[live]), self.before[x] + self.tree.rank(x, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order, by steps back to the next sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[at[live]]
            got = live[done]
            out[got] = self.samples[self.sample_rank[at[got]]] + steps[got]
            live = live[~done]
            c = self.bwt[at[live]]
            at[live] = self.before[c] + self.tree.rank(c, at[live])
            steps[live] += 1
        return out


def stretches(ids: np.ndarray, doc: np.ndarray, phrases: Phrases) -> np.ndarray:
    """Which words stand in a stretch of vocabulary words, inside one text, that may hold a window."""
    n = len(ids)
    known = ids > 0
    new = np.ones(n, bool)
    new[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, n))
    keep = (length >= WINDOW) | np.logical_or.reduceat(phrases.short[ids], first)
    return np.repeat(keep & known[first], length)


def occurrences(ids: np.ndarray, doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window among the words of a shard."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not len(phrases.length):
        return none, none
    place = np.flatnonzero(stretches(ids, doc, phrases))
    if not len(place):
        return none, none
    cut = np.ones(len(place), bool)
    cut[1:] = (np.diff(place) > 1) | (doc[place[1:]] != doc[place[:-1]])
    where = np.arange(len(place)) + np.cumsum(cut) - 1  # a 0 stands before each stretch but the first, and at the end
    t = np.zeros(where[-1] + 2, np.int64)
    t[where] = ids[place]
    word = np.zeros(len(t), np.int64)
    word[where] = place
    index = FMIndex(t)
    low, high = index.search(phrases.words)
    count = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return word[index.locate(rows)], window


def _search(phrases: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in blocks(batches, "text", SHARD_BYTES):
        data = FOLD[data]
        s, e, n = word_bounds(data, offs, WORD)
        doc = np.repeat(np.arange(part.num_rows), n)
        first, window = occurrences(phrases.ids(span_hashes(data, s, e)), doc, phrases)
        begin = np.concatenate([[0], np.cumsum(n)])
        spans: list[list[tuple[int, int]]] = [[] for _ in range(part.num_rows)]
        items: list[set[int]] = [set() for _ in range(part.num_rows)]
        order = np.argsort(first, kind="stable")
        for w, k in zip(first[order].tolist(), window[order].tolist(), strict=True):
            d = int(doc[w])
            a = w - int(begin[d])
            b = a + int(phrases.length[k])
            if spans[d] and a <= spans[d][-1][1]:
                spans[d][-1] = (spans[d][-1][0], max(b, spans[d][-1][1]))
            else:
                spans[d].append((a, b))
            items[d].update(phrases.items(k))
        if "spans" in part.schema.names:  # what earlier parts of the benchmark found
            for d, (old, had) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)):
                spans[d] = merged(spans[d] + [(x["start"], x["end"]) for x in old])
                items[d].update(had)
        columns = [
            part.column("doc_id"),
            pa.array(n, pa.int64()),
            pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
        ]
        rest = [c for c in part.schema.names if c not in ("doc_id", "n_words", "n_hit", "spans", "items")]
        yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in rest)], names=["doc_id", "n_words", "n_hit", "spans", "items", *rest])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of more than ``most`` words as several rows that have all their windows."""
    for part, data, offs in blocks(batches, "text"):
        s, e, n = word_bounds(FOLD[data], offs, WORD)
        begin, rows = np.concatenate([[0], np.cumsum(n)]), []
        for i, (item, text) in enumerate(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
            if n[i] <= most:
                rows.append((item, text))
            else:
                for a in range(int(begin[i]), int(begin[i + 1]) - WINDOW + 1, most - WINDOW + 1):
                    b = min(a + most, int(begin[i + 1]))
                    rows.append((item, data[s[a] : e[b - 1]].tobytes().decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "text"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_bytes: int = MAX_BENCHMARK_BYTES, keep: Column | None = None, cut: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, spans (in words, merged, end exclusive), items of every document, with its text.

    keep: one more column to hand through, as ``kept``. cut: the text without its hit words, in the same pass.

    No shuffle of documents: one map over the scan for each ``max_bytes`` of benchmark text.
    """
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    items = items.mapInArrow(lambda it, most=ITEM_WORDS: _pieces(most, it), "item_id bigint, text string")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // max_bytes))
    out = docs.select("doc_id", "text") if keep is None else docs.select("doc_id", "text", keep.alias("kept"))
    more = out.schema.fields[1:]
    for p in range(parts):
        of = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        sent = sc.broadcast(Phrases([(r["item_id"], r["text"]) for r in of.collect()]))  # about max_bytes of text
        end = cut and p == parts - 1
        if p and p % PARTS_AT_ONCE == 0:
            out = written(out)
        out = out.mapInArrow(lambda it, sent=sent, end=end: _without(_search(sent.value, it)) if end else _search(sent.value, it), StructType([*StructType.fromDDL(SCHEMA).fields, *more]))
    return out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their hit words, and what stands between hit words of one span."""
    for part, data, offs in blocks(batches, "text"):
        spans = part.column("spans").to_pylist()
        hit = [i for i, x in enumerate(spans) if x]
        texts = part.column("text").to_pylist()
        if hit:
            s, e, n = word_bounds(FOLD[data], offs, WORD)
            begin = np.concatenate([[0], np.cumsum(n)])
            for i in hit:
                at, rest = int(offs[i]), []
                for x in spans[i]:
                    rest.append(data[at : s[begin[i] + x["start"]]].tobytes())
                    at = int(e[begin[i] + x["end"] - 1])
                texts[i] = b"".join([*rest, data[at : offs[i + 1]].tobytes()]).decode("utf-8", "replace")
        k = part.schema.get_field_index("text")
        yield part.set_column(k, "text", pa.array(texts, pa.string()))


def remove_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the words that benchmark windows cover; ``n_chars`` follows the text.

    What is hit is judged on the given text: words that come together where others were taken out are not
    looked at again. What stands between two hit words of one span goes with them. Documents without a hit stay as
    they are; so do null texts.
    """
    others = [c for c in docs.columns if c != "text"]
    found = find_contamination(docs, benchmark, keep=F.struct(*others), cut=True)
    hit = F.size("spans") > 0
    out = {c: F.col("kept")[c] for c in others} | {"text": F.col("text")}
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(hit, F.char_length("text").cast(kind)).otherwise(out["n_chars"])
    return found.select(*(out[c].alias(c) for c in docs.columns))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
