"""LM scoring by logistic context mixing, and the add-one unigram base score.

A text is a string of bytes with an end mark. Each byte is a few yes/no steps down a code tree of what
stands before it (Huffman trees of the training corpus: of the last two bytes where these are letters and
frequent, else of the last one). Several hashed contexts (the last two, three and five bytes, the word
so far) each predict a step from counts of the training corpus; their predictions meet in the
logistic domain, under weights that a gate (step depth, kind of the last byte) picks. Two tables refine
the outcome: one learnt in training, indexed by the last byte and the mixed prediction, and one of the
text's own, indexed by the kind of the last byte and the mixed prediction.

Learning: all training documents are counted, one sixteenth of them for the mixing weights and the
trained refining table instead of the context tables, so these are learnt on texts that the tables
haven't seen. While a document is scored its own copy of the weights and its own refining table keep
learning, every ``STRIDE`` bytes up to 1 KB and then whenever a sixteenth of what was read has come on
top; every step is predicted from what came before the last update, so the score is the logarithm of
a probability. Context counts stay those of the training corpus. The tables' slots grow with the
training bytes up to 2**MAX_BITS for each context (one byte a slot); they and the most frequent
TOP_TOKENS token counts are all that is broadcast. Other tokens' counts come by a join.

Null and empty texts have one token, the end; repeated rows are learnt from and scored each; a null
doc_id is trained on and not held out; an empty training part leaves even odds at every step; other
columns are ignored; texts of any length are scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out
from .textblocks import FOLD, INVERSE, NOT_SPACE, ODD, blocks, map_batches, mixed, powers, span_hashes, table, word_bounds, written

CONTEXTS = 4
#: Slots of a context table: a power of two about a quarter of the training bytes, inside these bounds.
MIN_BITS, MAX_BITS = 16, 22
SLICE = 1 << 14
TOP_TOKENS = 400_000
END = 255  # no byte of UTF-8
END_TOKEN = 0x1D8E4E27C47D124F
MIXER_SHARE = 16
#: Code trees of two letters: so many at most, of those that stand so often in the training texts.
TREES, OFTEN = 1024, 200
GATES = 32
BUCKETS = 24
#: Learning rate, first weights, and the weight (in observations) that a text's own refining table begins with.
RATE, FIRST_WEIGHT, OWN = 0.01, 0.35, 8.0
#: Bytes between two updates, up to sixteen times as many; after that a sixteenth of what was read.
STRIDE = 64
#: Bounds of mixed log odds, so that they fall into the BUCKETS of three quarters each.
FAR = np.float32(8.99)
#: Slots that the steps of one context share, by kind of context: next to each other in memory, and many enough for all.
LINES = (1 << 12, 1 << 10, 1 << 6, 1 << 8)
#: Slots that are enough for a kind of context, whatever the corpus (64: no bound).
ENOUGH = (18, 20, 64, 64)
#: Log odds are kept as whole numbers of this size.
UNIT = 14.0
PIECE = 1 << 16
#: Bytes whose counts are merged before they are added, and whose contexts are made at once.
FILL_BYTES, NEAR_BYTES = 1 << 22, 1 << 18
SCORE_BYTES = 1 << 19

_KIND = np.array([1 if 65 <= b <= 90 or 97 <= b <= 122 else 2 if b in (32, 10, 9, 13) else 3 if b >= 128 else 0 for b in range(256)], np.int64)
_LETTER = _KIND == 1
_OUTSIDE = _KIND & 1 == 0  # bytes that are no part of a word
_SPREAD = mixed(np.arange(1, 257, dtype=np.uint64))
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def table_bits(train_bytes: int, most: int = MAX_BITS) -> int:
    """The logarithm of the slots of the largest context tables."""
    return min(most, max(MIN_BITS, (train_bytes // 4).bit_length()))


def bits_of(bits: int) -> list[int]:
    """The logarithms of all tables' slots: two bytes have no more than so many contexts, three few enough."""
    return [min(bits, n) for n in ENOUGH]


def starts_of(bits: int) -> list[int]:
    """Where the tables stand one after the other, and their length in all."""
    return [0, *itertools.accumulate(1 << n for n in bits_of(bits))]


class Codes:
    """Code trees: the steps (node, depth, bit) of every byte under every tree, in flat arrays.

    Trees 0 to 255 belong to the byte before, later ones to two letters before; ``tree_of`` (the byte before the
    last, the last) says which one holds.
    """

    def __init__(self, pairs: np.ndarray, triples: np.ndarray | None = None):
        """pairs: 256 x 256 counts of a byte (column) after another (row); triples: rows of (two letters, byte, count)."""
        self.tree_of = np.tile(np.arange(256), 256).astype(np.int32)
        shared = pairs.sum(0)
        counts = [(row if row.any() else shared) * 256 + 1 for row in pairs.astype(np.int64)]
        if triples is not None and len(triples):
            two, at = np.unique(triples[:, 0], return_inverse=True)
            total = np.bincount(at, weights=triples[:, 2])
            chosen = np.flatnonzero(total >= OFTEN)
            chosen = chosen[np.lexsort((two[chosen], -total[chosen]))][:TREES]
            number = np.full(len(two), -1)
            number[chosen] = np.arange(len(chosen))
            own = np.zeros((len(chosen), 256), np.int64)
            seen = number[at] >= 0
            own[number[at[seen]], triples[seen, 1]] = triples[seen, 2]
            for k, c in enumerate(chosen.tolist()):
                last = pairs[int(two[c]) & 255].astype(np.float64)
                counts.append(own[k] * 1024 + np.ceil(1023 * last / max(1.0, last.max())).astype(np.int64) + 1)
                self.tree_of[int(two[c])] = 255 + k + 1
        steps, lengths, done = [], [], {}
        for c in counts:
            key = c.tobytes()
            if key not in done:
                done[key] = self._tree(c)
            steps.append(done[key][0])
            lengths.append(done[key][1])
        length = np.concatenate(lengths)
        self.length = length.astype(np.uint8)
        self.start = (np.cumsum(length) - length).astype(np.int32)
        self.flat = np.concatenate(steps)

    @staticmethod
    def _tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The steps of all bytes, from the root on, and how many each has."""
        heap = [int(c) << 10 | k for k, c in enumerate(counts)]
        heapq.heapify(heap)
        up, side = np.full(511, -1), np.zeros(511, np.int64)
        for n in range(256, 511):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a & 1023], up[b & 1023] = n, n
            side[b & 1023] = 1
            heapq.heappush(heap, ((a >> 10) + (b >> 10)) << 10 | n)
        now, path = np.arange(256), []
        while (up[now] >= 0).any():
            path.append(np.where(up[now] >= 0, (up[now] - 256) << 4 | side[now], -1))
            now = np.where(up[now] >= 0, up[now], now)
        steps = np.stack(path[::-1], 1)  # from the root; short ones stand at the end
        there = steps >= 0
        length = there.sum(1)
        depth = np.cumsum(there, 1) - 1
        return (steps | np.minimum(depth, 7) << 1)[there].astype(np.uint16), length


_MARK = ((np.arange(4096, dtype=np.uint32) >> np.uint32(4)) + np.uint32(1)) * np.uint32(0x9E3779B2) | np.uint32(1)  # of packed steps, a hash of the node

_MARKS = np.repeat(_MARK[:, None], CONTEXTS, 1)

#: Zeros in front of every text of a block, so that its first bytes see nothing of the text before.
PAD = 5


def padded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block with an end mark after every text and PAD zeros before it, and the place in its text of each byte (negative: a zero)."""
    n = np.diff(offs)
    size = n + PAD + 1
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin + PAD, size)
    out = np.zeros(len(place), np.uint8)
    inside = place >= 0
    inside[begin + size - 1] = False
    out[inside] = data
    out[begin + size - 1] = END
    return out, place


def contexts(b: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The byte before, both bytes before, and 32-bit hashes of each context, for positions lo..hi of a padded block."""
    a = max(0, lo - BACK)
    n, text = hi - a, b[a:hi]
    past = []
    for k in range(1, 6):
        x = np.zeros(n, np.uint32)
        x[k:] = text[:-k]
        past.append(x)
    two = past[0] | past[1] << 8
    three = two | past[2] << 16
    five = (three * _M[0]) ^ ((past[3] | past[4] << 8) * _M[1])
    # the word so far, its last twelve bytes: a polynomial over the letters since its start
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(_OUTSIDE.take(past[0]), at, 0))
    start = np.maximum(start, at - 12)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_SPREAD.take(text) * powers(ODD, n, 0), out=running[1:])
    word = ((running[:n] - running.take(start)) * powers(INVERSE, n, 1).take(start) >> np.uint64(20)).astype(np.uint32) ^ past[0] * _M[2]
    hashed = []
    for k, h in enumerate((two, three, five, word)):
        h = (h[lo - a :] + np.uint32(k + 1)) * _M[k]
        h ^= h >> np.uint32(15)
        h *= _M[(k + 1) % 4]
        hashed.append(h)
    last = past[0][lo - a :].astype(np.int64)
    return last, past[1][lo - a :].astype(np.int64) << 8 | last, hashed


BACK = 18


def steps_of(codes: Codes, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index into ``pair`` and packed step of every step, and where the steps of each pair end."""
    n = codes.length.take(pair).astype(np.int64)
    ends = np.cumsum(n)
    if not len(n):
        return ends, codes.flat[:0], ends
    new = np.zeros(int(ends[-1]), np.int8)
    new[ends[:-1]] = 1
    of = np.cumsum(new, dtype=np.int64)
    flat = (codes.start.take(pair) - ends + n).take(of)
    flat += np.arange(len(flat))
    return of, codes.flat.take(flat), ends


def update_places(end: int) -> np.ndarray:
    """The places of a text before which its weights are updated, up to ``end``."""
    out = list(range(STRIDE, 16 * STRIDE, STRIDE))
    while not out or out[-1] < end:
        out.append(16 * STRIDE if len(out) < 16 else out[-1] + out[-1] // 16)
    return np.array(out)


def home(hashed: np.ndarray, k: int, bits: int) -> np.ndarray:
    """First slots of the lines that the steps of contexts of kind ``k`` share, in a table of 2**bits slots."""
    x = hashed >> np.uint32(32 - bits)
    x &= np.uint32(0xFFFFFFFF - min(LINES[k], 1 << bits) + 1)
    return x


def in_line(hashed: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The slots of steps inside their contexts' lines."""
    x = hashed * _MARKS.take(steps, axis=0)
    x >>= np.uint32(33 - max(LINES).bit_length())
    pairs = x.view(np.uint64)  # two columns at a time
    for k in range(CONTEXTS // 2):
        pairs[:, k] &= np.uint64(LINES[2 * k + 1] - 1 << 32 | LINES[2 * k] - 1)
    return x


class Tables:
    """Counts of both outcomes in every context's slots; the steps of one context lie in one line of slots."""

    def __init__(self, bits: int = MIN_BITS):
        self.bits = bits_of(bits)
        self.counts = [np.zeros(2 << n, np.uint32) for n in self.bits]  # a slot's outcomes stand together

    def add(self, codes: Codes, data: np.ndarray, offs: np.ndarray) -> None:
        b, place = padded(data, offs)
        for c in range(0, len(b), FILL_BYTES):
            hi = min(len(b), c + FILL_BYTES)
            keys: list[list[np.ndarray]] = [[] for _ in range(CONTEXTS)]
            for lo in range(c, hi, NEAR_BYTES):
                up = min(hi, lo + NEAR_BYTES)
                real = np.flatnonzero(place[lo:up] >= 0)
                _, two, hashed = contexts(b, lo, up)
                pair = ((codes.tree_of.take(two) << 8 | b[lo:up]).take(real)).astype(np.uint64)
                for k, h in enumerate(hashed):
                    keys[k].append(h.take(real).astype(np.uint64) << np.uint64(20) | pair)
            for k in range(CONTEXTS):
                # equal (context, pair) once, with its count; in the order of the slots
                key = np.concatenate(keys[k])
                keys[k].clear()
                key.sort()
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                times = np.diff(np.append(first, len(key))).astype(np.uint32)
                key = key.take(first)
                for a in range(0, len(key), 1 << 16):
                    some = key[a : a + (1 << 16)]
                    h = (some >> np.uint64(20)).astype(np.uint32)
                    of, steps, _ = steps_of(codes, (some & np.uint64(0xFFFFF)).astype(np.int64))
                    at = h.take(of) * _MARK.take(steps)
                    at >>= np.uint32(33 - max(LINES).bit_length())
                    at &= np.uint32(LINES[k] - 1)
                    at |= home(h, k, self.bits[k]).take(of)
                    at <<= np.uint32(1)
                    at |= steps & np.uint16(1)
                    np.add.at(self.counts[k], at.astype(np.intp), times[a : a + (1 << 16)].take(of))


def stretched(counts: np.ndarray) -> np.ndarray:
    """Log odds of outcome 1 (counts stand in pairs) in units of 1 / UNIT, as bytes; few counts stay near even odds."""
    c = counts.reshape(-1, 2).astype(np.float64) + 0.3
    return np.rint(np.clip(np.log(c[:, 1] / c[:, 0]), -9, 9) * UNIT).astype(np.int8)


class Mixer:
    """Weights by gate and the trained refining table, learnt online."""

    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = np.full((GATES, CONTEXTS), FIRST_WEIGHT, np.float32) if weights is None else weights
        odds = (np.arange(BUCKETS) - (BUCKETS - 1) / 2) * 0.75
        prior = 1 / (1 + np.exp(-odds))
        self.refine = np.stack([np.tile(16 * (1 - prior), 256), np.tile(16 * prior, 256)]) if refine is None else refine

    def run(self, codes: Codes, odds: np.ndarray, data: np.ndarray, offs: np.ndarray, learn: bool = False) -> np.ndarray:
        """Natural log probability of each text of a block, its end included.

        odds: the bytes of all tables, one after the other. learn: the weights and the trained table keep what they
        learn, else each text starts from them.
        """
        b, place = padded(data, offs)
        n_docs = len(offs) - 1
        bits = next(n for n in range(MIN_BITS, 65) if starts_of(n)[-1] >= len(odds))
        tables, begin = bits_of(bits), starts_of(bits)
        # longer texts have smaller numbers: those that still go on come first
        size = np.diff(offs) + 1
        number = np.empty(n_docs, np.int64)
        number[np.argsort(-size, kind="stable")] = np.arange(n_docs)
        shorter = np.sort(-size)
        doc = np.repeat(number, size + PAD)
        total = np.zeros(n_docs)
        copies = 1 if learn else n_docs
        own = np.tile(self.weights / np.float32(UNIT), (copies, 1))  # a row for each text and gate
        trained = (self.refine[1] / self.refine.sum(0)).astype(np.float32)
        # a text's own table begins with what training found for the kind of byte
        of_kind = np.stack([self.refine.reshape(2, 256, BUCKETS)[:, _KIND == k].sum(1) for k in range(4)], 1).reshape(2, -1)
        start = of_kind[1] / of_kind.sum(0)
        mine = np.tile(np.stack([OWN * (1 - start), OWN * start], 1), (copies, 1))  # both outcomes of each cell
        ends = update_places(int(size.max()) if n_docs else 0)
        level_of = np.repeat(np.arange(len(ends) + 1, dtype=np.uint16), np.diff(np.append(np.insert(ends, 0, 0), ends[-1] + 1)))
        for c in range(0, len(b), 2 * SCORE_BYTES):  # more than once for long texts only, which are alone in their block
            hi = min(len(b), c + 2 * SCORE_BYTES)
            before, two, each = contexts(b, c, hi)
            hashed, lines = np.empty((hi - c, CONTEXTS), np.uint32), np.empty((hi - c, CONTEXTS), np.uint32)
            for k, h in enumerate(each):
                hashed[:, k], lines[:, k] = h, home(h, k, tables[k]) + np.uint32(begin[k])
            pair = codes.tree_of.take(two) << 8 | b[c:hi]
            owner = doc[c:hi]
            # kind of the last byte and text, and the last byte
            where = (_KIND.take(before) + (0 if learn else owner * 4)) << 8 | before
            real = np.flatnonzero(place[c:hi] >= 0)
            level = level_of.take(place[c:hi].take(real))
            order = real.take(np.argsort(level, kind="stable"))
            passed = np.cumsum(np.bincount(level, minlength=1))
            for r in np.unique(level).tolist():
                live = 1 if learn else int(np.searchsorted(shorter, -(ends[r - 1] if r else 0), "left")) or n_docs
                rows, cells = live * GATES, live * 4 * BUCKETS
                slope, count, more = np.zeros((CONTEXTS, rows)), np.zeros(rows), np.zeros(2 * cells)
                text = (mine[:cells, 1] / (mine[:cells, 0] + mine[:cells, 1])).astype(np.float32)
                for part in self._parts(order[passed[r - 1] if r else 0 : passed[r]]):
                    of, steps, until = steps_of(codes, pair.take(part))
                    at = part.take(of)
                    bit = steps & np.uint16(1)
                    here = where.take(at)
                    kind = here >> 8
                    row = kind << 3
                    row += (steps & np.uint16(14)) >> np.uint16(1)
                    slot = in_line(hashed.take(at, axis=0), steps)
                    slot += lines.take(at, axis=0)
                    x = odds.take(slot.reshape(-1).astype(np.intp)).astype(np.float32).reshape(-1, CONTEXTS)
                    y = x * own.take(row, axis=0)
                    s = y[:, 0] + y[:, 1]
                    for k in range(2, CONTEXTS):
                        s += y[:, k]
                    np.clip(s, -FAR, FAR, out=s)
                    p = 1 / (1 + np.exp(-s))
                    s *= np.float32(1 / 0.75)
                    s += np.float32(BUCKETS / 2)
                    bucket = s.astype(np.int64)
                    here &= 255
                    here *= BUCKETS
                    here += bucket
                    kind *= BUCKETS
                    kind += bucket
                    final = trained.take(here)
                    final += text.take(kind)
                    final *= np.float32(0.25)
                    final += np.float32(0.5) * p
                    np.clip(final, 1e-6, 1 - 1e-6, out=final)
                    outcome = bit.astype(np.float32)
                    final -= 1 - outcome  # of outcome 0 the probability is the rest
                    np.abs(final, out=final)
                    who = owner.take(part)
                    edge = np.flatnonzero(who[1:] != who[:-1])  # the bytes of a text stand together
                    total[who[np.append(0, edge + 1)]] += np.add.reduceat(np.log(final), np.append(0, until.take(edge)), dtype=np.float64)
                    outcome -= p
                    count += np.bincount(row, minlength=rows)
                    for k in range(CONTEXTS):
                        slope[k] += np.bincount(row, weights=outcome * x[:, k], minlength=rows)
                    kind <<= 1
                    kind |= bit
                    more += np.bincount(kind, minlength=len(more))
                    if learn:
                        self.refine += np.bincount(here << 1 | bit, minlength=2 * self.refine.shape[1]).reshape(-1, 2).T
                own[:rows] += (RATE / UNIT**2 * slope / (1 + count / 128)).T.astype(np.float32)
                mine[:cells] += more.reshape(-1, 2)
        if learn:
            self.weights = own * np.float32(UNIT)
        return total[number]

    @staticmethod
    def _parts(at: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(0, len(at), PIECE):
            yield at[i : i + PIECE]


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block, without ends, and the number of each text's words."""
    low = FOLD[data]
    s, e, n = word_bounds(low, offs, NOT_SPACE)
    return span_hashes(low, s, e), n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens (kind 0), byte pairs (kind 1) and bytes after two letters (kind 2), summed within blocks."""
    pairs, triples = np.zeros(1 << 16, np.int64), np.zeros(1 << 21, np.int64)

    def rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    for part, data, offs in blocks(batches, "text", 8 << 20):
        h, _ = token_hashes(data, offs)
        key, n = np.unique(h, return_counts=True)
        yield rows(0, key.view(np.int64), n)
        yield rows(0, np.array([END_TOKEN], np.int64), np.array([part.num_rows]))
        b, place = padded(data, offs)
        text, last, before = b[PAD:], b[PAD - 1 : -1], b[PAD - 2 : -2]
        real = place[PAD:] >= 0
        pairs += np.bincount((last.astype(np.intp) << 8 | text)[real], minlength=1 << 16)
        letters = real & _LETTER.take(last) & _LETTER.take(before) & (text < 128)
        triples += np.bincount((before[letters].astype(np.intp) << 7 | last[letters]) << 7 | text[letters], minlength=1 << 21)
    for kind, counts in ((1, pairs), (2, triples)):
        found = np.flatnonzero(counts)
        yield rows(kind, found, counts[found])


def _fill(codes: Codes, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context tables of a task's documents, in compressed slices."""
    import zstandard

    tables, pack = Tables(bits), zstandard.ZstdCompressor(level=1)
    for _, data, offs in blocks(batches, "text", 2 << 20):
        tables.add(codes, data, offs)
    for counts, begin in zip(tables.counts, starts_of(bits), strict=False):
        for a in range(0, len(counts) // 2, SLICE):
            x = counts[2 * a : 2 * (a + SLICE)]
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([begin + a], pa.int32()), pa.array([pack.compress(x.tobytes())], pa.binary())], names=["slice", "counts"])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices, which come in order; one slice is held at a time."""
    import zstandard

    unpack, now, total = zstandard.ZstdDecompressor(), None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([stretched(total).tobytes()], pa.binary())], names=["slice", "odds"])

    for batch in batches:
        for s, c in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
            if s != now:
                if now is not None:
                    yield out()
                now, total = s, np.zeros(2 * SLICE, np.uint64)
            total += np.frombuffer(unpack.decompress(c.as_buffer()), np.uint32)
    if now is not None:
        yield out()


def _learn(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, odds = sent.value
    mixer, n = Mixer(), 0
    fresh = mixer.refine.copy()
    for part, data, offs in blocks(batches, "text", 1 << 16):
        mixer.run(codes, odds, data, offs, learn=True)
        n += len(data) + part.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mixer.weights.astype(np.float64).tobytes()], pa.binary()), pa.array([(mixer.refine - fresh).tobytes()], pa.binary())], names=["n", "weights", "refine"])


def _learnt_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights times bytes, and tables, summed over a task's rows."""
    n, weights, refine = 0, np.zeros(GATES * CONTEXTS), np.zeros(2 * 256 * BUCKETS)
    for batch in batches:
        for r in batch.to_pylist():
            n += r["n"]
            weights += np.frombuffer(r["weights"]) * r["n"]
            refine += np.frombuffer(r["refine"])
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(weights / n).tobytes()], pa.binary()), pa.array([refine.tobytes()], pa.binary())], names=["n", "weights", "refine"])


def _score(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, odds, weights, refine, top, top_n, total, distinct = sent.value
    mixer = Mixer(weights, refine)
    for part, data, offs in blocks(batches, "text", SCORE_BYTES):
        score = mixer.run(codes, odds, data, offs) / np.log(10)
        h, n = token_hashes(data, offs)
        k = np.minimum(np.searchsorted(top, h), max(len(top) - 1, 0))
        known = top[k] == h if len(top) else np.zeros(len(h), bool)
        c = np.where(known, top_n[k] if len(top) else 0, 0)
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc[known], weights=np.log10((c[known] + 1) / (total + distinct + 1)), minlength=len(n))
        at = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=len(n)))])
        rare = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h[~known].view(np.int64)))
        bits = -score / log10(2) / (np.diff(offs) + 1)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(n + 1, pa.int64()), pa.array(np.bincount(doc[known], minlength=len(n)), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), rare],
            names=["doc_id", "n_tokens", "known", "base", "score", "bits_per_byte", "rare"],
        )


class Model:
    """What training leaves: codes, odds of all slots, mixing weights, refining table."""

    def __init__(self, codes: Codes, odds: np.ndarray, mixer: Mixer):
        self.codes, self.odds, self.mixer = codes, odds, mixer


def train(docs: DataFrame, pairs: np.ndarray, triples: np.ndarray | None = None, bits: int | None = None) -> Model:
    """Context tables from fifteen sixteenths of ``docs``, weights from the rest (by a hash of the row).

    Both are maps over the scan; what the tasks learn (12,416 numbers each) is averaged by bytes seen in tasks
    of its own. bits: of the tables; from the number of bytes (the sum of ``pairs``) if None.
    """
    sc = docs.sparkSession.sparkContext
    codes = Codes(pairs, triples)
    bits = table_bits(int(pairs.sum())) if bits is None else bits
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(MIXER_SHARE)) == 0
    sent_codes = sc.broadcast(codes)
    filled = map_batches(docs.filter(~share).select("text"), lambda it: _fill(sent_codes.value, bits, it), "slice int, counts binary")
    summed = map_batches(filled.repartition("slice").sortWithinPartitions("slice"), _sum_slices, "slice int, odds binary")
    odds = np.zeros(starts_of(bits)[-1], np.int8)
    for r in summed.toLocalIterator():  # 2**bits bytes for each table at most
        odds[r["slice"] : r["slice"] + SLICE] = np.frombuffer(r["odds"], np.int8)
    sent = sc.broadcast((codes, odds))
    learnt = map_batches(docs.filter(share).select("text"), lambda it: _learn(sent, it), LEARNT)
    learnt = map_batches(learnt.repartition(SUM_TASKS), _learnt_sums, LEARNT).collect()  # SUM_TASKS rows
    mixer = Mixer()
    if seen := sum(r["n"] for r in learnt):
        mixer.weights = (sum(r["n"] * np.frombuffer(r["weights"]) for r in learnt) / seen).reshape(GATES, CONTEXTS).astype(np.float32)
        for r in learnt:
            mixer.refine = mixer.refine + np.frombuffer(r["refine"]).reshape(2, -1)
    return Model(codes, odds, mixer)


LEARNT = "n bigint, weights binary, refine binary"
#: Tasks that sum what the learning tasks return (100 KB each) before the driver does.
SUM_TASKS = 8


def score_texts(docs: DataFrame, training: DataFrame, top_tokens: int = TOP_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row of ``docs``.

    Tokens are told apart by 64-bit hashes. Shuffled: token counts summed within tasks, table slices,
    and the tokens outside the ``top_tokens`` most frequent.
    """
    sc = docs.sparkSession.sparkContext
    counted = written(map_batches(training.select("text"), _count, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    tokens = counted.filter("kind = 0").select("key", "n")
    pairs, triples = np.zeros(1 << 16, np.int64), []
    for r in counted.filter("kind > 0").collect():  # 65,536 pairs and 346,112 triples at most
        if r["kind"] == 1:
            pairs[r["key"]] = r["n"]
        else:
            triples.append((r["key"] >> 14 << 8 | r["key"] >> 7 & 127, r["key"] & 127, r["n"]))
    size = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct"), F.max(F.when(F.col("key") == END_TOKEN, F.col("n"))).alias("ends")).first()
    total, distinct, ends = size["total"], size["distinct"], size["ends"] or 0
    least, room = 1, top_tokens
    for r in tokens.groupBy("n").agg(F.count("*").alias("many")).orderBy(F.desc("n")).limit(top_tokens).toLocalIterator():
        room -= r["many"]
        if room < 0:
            least = r["n"] + 1
            break
    picked = tokens.filter(F.col("n") >= least).toPandas()  # top_tokens rows at most
    keys = picked["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = train(training, pairs.reshape(256, 256), np.array(triples, np.int64).reshape(-1, 3))
    sent = sc.broadcast((model.codes, model.odds, model.mixer.weights, model.mixer.refine, keys[order], picked["n"].to_numpy(np.int64)[order], total, distinct))
    scored = map_batches(docs.select("doc_id", "text"), lambda it: _score(sent, it), "doc_id bigint, n_tokens bigint, known bigint, base double, score double, bits_per_byte double, rare array<bigint>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    each = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    less = tokens.filter((F.col("n") < least))
    rare = each.join(less, "key", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("r_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total + distinct + 1)))).alias("r_base"),
    )
    end = log10((ends + 1) / (total + distinct + 1))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("r_known", F.lit(0)) + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0)) + end).alias("base_score"),
        "score",
        "bits_per_byte",
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, docs.filter(~held_out(7)))
    return scored.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
