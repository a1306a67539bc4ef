"""SentencePiece encoding and decoding, giant documents in parallel.

The ids are those of the given model. A model of merges (BPE) is encoded by the library's own merges;
no piece goes over a border between a visible character and a following space, nor over a line end,
so merges on both sides of a border don't touch, and a text above ``CHUNK`` characters is cut at such
borders (a stretch without one stays whole) and its chunks are encoded apart.

A unigram model is a max-plus problem: the segmentation into pieces with the largest sum of scores;
characters that no piece holds fall back to their bytes. Of equally good segmentations the one whose
last piece is longest wins, at every place. What follows is about such models.

A text up to ``CHUNK`` characters is encoded where it lies: no piece goes over a border between a
visible character and a following space, so it falls into units that a worker remembers. A longer
text is cut into chunks. A border may be crossed by a piece, so the state at a border is how many
characters of the next chunk the crossing piece took; each chunk yields a matrix of the best sums
from every state at its left to every state at its right. These combine by the max-plus product, which is
associative: ``SPAN`` neighbours give one matrix, spans of spans one each, up to the document; on the
way back a span's border states give those inside it, and every chunk is traced back on its own. So no task
holds more than SPAN matrices of a document, however long that is.

Null and empty texts have no pieces and decode to the empty text; repeated rows are encoded alike;
pieces are spelt with plain spaces inside the method, so U+2581 in a text is an ordinary character
and comes back; columns named piece_ids, piece_score or decoded are replaced, others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from .textblocks import blocks, map_batches, table, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 16
#: Neighbouring matrices that are combined into one.
SPAN = 64
#: Units that a worker remembers before it starts anew.
REMEMBERED = 120_000
#: Longer units are solved when they come, and not remembered.
LONGEST_UNIT = 32
#: Bytes of text whose units are looked up together.
TOGETHER = 1 << 20
SPACE = "▁"
#: Units of a text, where no piece has a space after another character, where none holds a line end
#: either, and where, further, none has a letter in front of another character.
UNITS = (
    re.compile(r" +[^ ]*|[^ ]+"),
    re.compile(r"\n| +[^ \n]*|[^ \n]+"),
    re.compile(r"\n| +(?:[^\w \n]|[\d_])*[^\W\d_]*|(?:[^\w \n]|[\d_])+[^\W\d_]*|[^\W\d_]+"),
)
#: Places that no piece goes over, where none holds a line end.
BORDER = re.compile(r"(?<=[^ ]) |(?<=\n)[^\n]|\n")
AFTER_LETTER = re.compile(r"[^\W\d_][\W\d_]")
LOW = -np.inf
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary: scores and ids by piece, bytes by id. Its size is the model's, whatever the corpus."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float], byte_ids: list[int], out: list[bytes]):
        self.ids, self.scores, self.byte_ids, self.out = ids, scores, byte_ids, out
        self.longest = max(map(len, ids), default=1)
        #: By character, down to the score under 0 where a piece ends.
        self.trie: dict = {}
        for p, s in scores.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[0] = s
        self.unknown = min(scores.values(), default=0.0) - 10.0
        assert not any(" " in p.lstrip(" ") for p in ids), "a piece goes over a word's end"
        self.cuts_at_newline = not any("\n" in p for p in ids)
        self.unit = UNITS[self.cuts_at_newline + (self.cuts_at_newline and not any(AFTER_LETTER.search(p) for p in ids))]
        self.known: dict[str, tuple[bytes, float]] = {}
        self._hashed = None

    def __getstate__(self):
        return self.ids, self.scores, self.byte_ids, self.out

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unused(i) or m.is_unknown(i))]
        names = [m.id_to_piece(i) for i in range(n)]
        out = [b""] * n
        for i in plain:
            out[i] = names[i].replace(SPACE, " ").encode()
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(byte_ids):
            out[i] = bytes([b])
        # inside the method a piece is spelt with plain spaces
        return cls({names[i].replace(SPACE, " "): i for i in plain}, {names[i].replace(SPACE, " "): m.get_score(i) for i in plain}, byte_ids, out)

    def matches(self, text: str, at: int) -> list[tuple[int, float]]:
        """(end, score) of the pieces that begin at a place, shortest first; a lone character always has one."""
        out, node, end, n = [], self.trie, at, len(text)
        while end < n and (node := node.get(text[end])) is not None:
            end += 1
            if 0 in node:
                out.append((end, node[0]))
        if not out or out[0][0] > at + 1:
            out.insert(0, (at + 1, self.unknown))
        return out

    def spelt(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]

    def path(self, text: str, start: int, stop: int, limit: int | None = None) -> tuple[list[int], float]:
        """Ids and score of the best way from ``start`` to ``stop``; pieces begin before ``limit`` (``stop`` if None)."""
        limit = stop if limit is None else limit
        best = {start: (0.0, start)}
        for at in range(start, limit):
            if at not in best:
                continue
            here = best[at][0]
            for end, s in self.matches(text, at):
                if end <= stop and (end not in best or here + s > best[end][0]):
                    best[end] = (here + s, at)
        found, at = [], stop
        while at > start:
            before = best[at][1]
            found.append(text[before:at])
            at = before
        return [i for piece in reversed(found) for i in self.spelt(piece)], best[stop][0]

    def solved(self, text: str) -> tuple[bytes, float]:
        """Ids (32 bits each) and score of a unit."""
        got = self.known.get(text)
        if got is None:
            ids, score = self.path(text, 0, len(text))
            got = np.array(ids, np.int32).tobytes(), score
        return got

    def remember(self, wanted: set[str]) -> None:
        """Solves the short units among ``wanted`` that aren't known, all of one length at once."""
        missing = wanted - self.known.keys()
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = wanted
        short = sorted((u for u in missing if len(u) <= LONGEST_UNIT), key=len, reverse=True)
        if short:
            self._solve(short)

    def _solve(self, units: list[str]) -> None:
        """The best way through each unit; all move on together, longest first, place after place."""
        n = len(units[0])
        code = np.array(units, f"U{n}").view(np.uint32).reshape(len(units), n).T.astype(np.uint64)
        length = np.array([len(u) for u in units])
        best = np.full((n + 1, len(units)), LOW)
        back = np.zeros((n + 1, len(units)), np.int8)
        piece = np.full((n + 1, len(units)), -1, np.int32)
        best[0] = 0.0
        for at in range(n):
            rows = np.arange(int(np.searchsorted(-length, -at)))  # those longer than at
            h = np.zeros(len(rows), np.uint64)
            for end in range(at + 1, min(n, at + self.longest) + 1):
                h = (h + code[end - 1, rows]) * _BASE
                h ^= h >> np.uint64(29)
                score, ids = self._score(h)
                going = ids > -2
                if end == at + 1:
                    score[score == LOW] = self.unknown
                    ids = np.maximum(ids, -1)
                elif not going.any():
                    break
                new = score + best[at, rows]
                better = new > best[end, rows]
                r = rows[better]
                best[end, r], back[end, r], piece[end, r] = new[better], at, ids[better]
                rows, h = rows[going], h[going]
        # back along all ways at once; a piece of -1 is a character spelt in bytes
        at, rows, steps = length.copy(), np.arange(len(units)), []
        while (at > 0).any():
            steps.append(np.where(at > 0, piece[at, rows], -2))
            at = np.where(at > 0, back[at, rows], 0)
        way = np.array(steps[::-1]).T
        total = best[length, rows].tolist()
        flat, size = way[way > -2].astype(np.int32).tobytes(), 4 * np.cumsum((way > -2).sum(1))
        bytes_needed = (way == -1).any(1)
        for u, a, b, score, odd in zip(units, [0, *size[:-1].tolist()], size.tolist(), total, bytes_needed.tolist(), strict=True):
            self.known[u] = (np.array(self.path(u, 0, len(u))[0], np.int32).tobytes() if odd else flat[a:b]), score

    def _score(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of pieces by hash; where there is none LOW and -1, or -2 if none even begins so."""
        if self._hashed is None:
            scores: dict[str, float] = {}
            for p, s in self.scores.items():
                scores[p] = s
                for k in range(1, len(p)):
                    scores.setdefault(p[:k], LOW)
            hashes = []
            for p in scores:
                x = 0
                for c in p:
                    x = (x + ord(c)) * int(_BASE) & (1 << 64) - 1
                    x ^= x >> 29
                hashes.append(x)
            keys, values = np.array([*hashes, 0], np.uint64), np.array([*scores.values(), LOW])
            ids = np.array([*(self.ids.get(p, -1) for p in scores), -2], np.int32)
            assert len(np.unique(keys)) == len(keys)
            place, left = [], np.arange(len(keys) - 1)
            while len(left):  # what finds its slot taken goes to the next table
                slots = np.full(1 << 18, len(keys) - 1, np.int32)
                slots[self._slot(keys[left], len(place))] = left
                left = left[slots[self._slot(keys[left], len(place))] != left]
                place.append(slots)
            self._hashed = keys, values, ids, place
        keys, values, ids, place = self._hashed
        found = np.full(len(h), len(keys) - 1)
        for k, slots in enumerate(place):
            i = slots[self._slot(h, k)]
            hit = keys[i] == h
            found[hit] = i[hit]
        return values[found], ids[found]

    @staticmethod
    def _slot(h: np.ndarray, k: int) -> np.ndarray:
        return (h >> np.uint64(46 - 11 * k)) & np.uint64((1 << 18) - 1)

    def units(self, text: str) -> list[str]:
        return self.unit.findall(text)

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        cut = [self.units(" " + t) if t else [] for t in texts]
        self.remember({u for units in cut for u in units})
        known, out = self.known.get, []
        for units in cut:
            got = [known(u) or self.solved(u) for u in units]
            out.append((np.frombuffer(b"".join([x[0] for x in got]), np.int32), sum([x[1] for x in got])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def cuts(self, text: str, first: int, last: int) -> tuple[int, int] | None:
        """The first and last places of first..last that no piece goes over, if there are two."""
        at = [m.start() for m in re.finditer(BORDER if self.cuts_at_newline else r"(?<=[^ ]) ", text) if first <= m.start() <= last]
        return (at[0], at[-1]) if len(at) > 1 else None

    def reach(self, text: str, start: int, length: int, states: int) -> np.ndarray:
        """Best sums from ``start`` to length + 0 .. length + states - 1, with pieces that begin before ``length``."""
        best = np.full(length + states + self.longest, LOW)
        best[start] = 0.0
        for at in range(start, length):
            if best[at] > LOW:
                for end, s in self.matches(text, at):
                    if best[at] + s > best[end]:
                        best[end] = best[at] + s
        return best[length : length + states]

    def matrix(self, text: str, length: int) -> np.ndarray:
        """Transfer matrix of a chunk: ``length`` characters of its own, then those a piece may take from the next."""
        states = self.longest
        m = np.full((states, states), LOW)
        found = self.cuts(text, min(states, length), length)
        if found is None:
            for k in range(min(states, length + 1)):
                m[k] = self.reach(text, k, length, states)
        else:
            a, b = found
            head = np.array([self.reach(text, k, a, 1)[0] for k in range(states)])
            units = self.units(text[a:b])
            self.remember(set(units))
            middle = sum(self.solved(u)[1] for u in units)
            m = head[:, None] + middle + self.reach(text, b, length, states)[None, :]
        for k in range(length + 1, states):  # a piece that goes over the whole chunk
            m[k] = LOW
            m[k, k - length] = 0.0
        return m

    def trace(self, text: str, length: int, left: int, right: int) -> list[int]:
        """Ids of the pieces that begin in the chunk, between two known states."""
        if left >= length:
            return []
        found = self.cuts(text, min(self.longest, length), length)
        if found is None or not left <= found[0]:
            return self.path(text, left, length + right, length)[0]
        a, b = found
        units = self.units(text[a:b])
        self.remember(set(units))
        middle = [i for u in units for i in np.frombuffer(self.solved(u)[0], np.int32).tolist()]
        return self.path(text, left, a)[0] + middle + (self.path(text, b, length + right, length)[0] if b < length + right else [])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative, with the transfer matrices of neighbouring chunks."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def combined(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring matrices, pair by pair."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def states(matrices: list[np.ndarray], left: int = 0, right: int = 0) -> list[int]:
    """Border states of the best path between two known ones."""
    size = len(matrices[0])
    forward = [np.where(np.arange(size) == left, 0.0, LOW)[None, :]]
    for m in matrices:
        forward.append(product(forward[-1], m))
    out = [right]
    for f, m in zip(forward[-2::-1], matrices[::-1], strict=True):
        out.append(int(np.argmax(f[0] + m[:, out[-1]])))
    return out[::-1]


class Merges:
    """A model of merges: the library's own merges are the ids, from the bytes of the model file.

    U+2581 in a text, which the library takes for a space, is spelt in bytes instead.
    """

    def __init__(self, proto: bytes, pieces: Pieces):
        from sentencepiece import SentencePieceProcessor

        self.proto, self.pieces = proto, pieces
        self.model = SentencePieceProcessor(model_proto=proto)
        self.scores = np.array([self.model.get_score(i) for i in range(self.model.get_piece_size())])
        self.mark = [pieces.byte_ids[b] for b in SPACE.encode()]
        self.lead = self.model.encode("\n")
        # no piece goes over a line end: what stands behind one is encoded as if nothing stood before it
        assert pieces.cuts_at_newline and all(self.model.encode("\n" + t)[: len(self.lead)] == self.lead for t in ("", "a", " a", "\n"))

    def __reduce__(self):
        return Merges, (self.proto, self.pieces)

    def inner(self, text: str) -> list[int]:
        """Ids of a text that begins at a border: without the space that the library puts before a text."""
        out: list[int] = []
        for k, t in enumerate(text.split(SPACE)):
            out += self.mark * (k > 0)
            if t:
                out += self.model.encode("\n" + t, num_threads=1)[len(self.lead) :]
        return out

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        plain = iter(self.model.encode([t for t in texts if t and SPACE not in t], num_threads=1))
        ids = [np.array([] if not t else self.inner(" " + t) if SPACE in t else next(plain), np.int32) for t in texts]
        return [(x, float(self.scores[x].sum())) for x in ids]

    def decode(self, ids: np.ndarray) -> str:
        return self.pieces.decode(ids)

    def borders(self, text: str, chunk: int) -> list[int]:
        """Ends of the chunks: the last border of each ``chunk`` characters, or else the next one behind them."""
        at, out = 0, []
        places = np.array([m.start() for m in BORDER.finditer(text)] + [len(text)])
        while at < len(text):
            k = int(np.searchsorted(places, at + chunk, "right"))
            if k == 0 or places[k - 1] <= at:
                k += 1
            at = int(places[k - 1])
            out.append(at)
        return out


def is_merges(proto: bytes) -> bool:
    """Whether a model file's trainer_spec (field 2) has model_type (field 3) 2, that is BPE."""

    def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            x = shift = 0
            while True:
                b = raw[at]
                at += 1
                x |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return x

        while at < len(raw):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                n = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, raw[at : at + n]
                at += n

    return any(k == 2 and (3, 2) in list(fields(spec)) for k, spec in fields(proto))


def load(path: str) -> Pieces | Merges:
    pieces = Pieces.load(path)
    with open(path, "rb") as f:
        proto = f.read()
    return Merges(proto, pieces) if is_merges(proto) else pieces


def _small(pieces: Pieces | Merges, with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in blocks(batches, "text", TOGETHER):
        got = pieces.encode_all([t or "" for t in part.column("text").to_pylist()])
        at = np.concatenate([[0], np.cumsum([len(x) for x, _ in got])])
        ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([x for x, _ in got])))
        back = [pa.array([pieces.decode(x) for x, _ in got], pa.string())] if with_text else []
        yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([float(x) for _, x in got], pa.float64()), *back], names=[*part.schema.names, "piece_ids", "piece_score", *["decoded"] * with_text])


def _cut(pieces: Pieces | Merges, chunk: int, overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
            t = " " + t
            ends = pieces.borders(t, chunk) if isinstance(pieces, Merges) else [min(s + chunk, len(t)) for s in range(0, len(t), chunk)]
            starts = [0, *ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(starts), pa.int64()), pa.array([h] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()), pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int32()), pa.array([t[s : e + overlap] for s, e in zip(starts, ends, strict=True)])],
                names=["doc_id", "text_hash", "chunk", "length", "part"],
            )


def _merged(merges: Merges, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and their scores of chunks that end at borders."""
    for batch in batches:
        ids = [np.array(merges.inner(t), np.int32) for t in batch.column("part").to_pylist()]
        sums = [float(merges.scores[x].sum()) for x in ids]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "chunk")), pa.array(sums, pa.float64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "chunk", "sum", "ids"])


def _matrices(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = [pieces.matrix(t, n).tobytes() for t, n in zip(batch.column("part").to_pylist(), batch.column("length").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text_hash", "chunk")] + [pa.array(m, pa.binary())], names=["doc_id", "text_hash", "chunk", "matrix"])


def _square(raw: bytes) -> np.ndarray:
    size = int(round((len(raw) // 8) ** 0.5))
    return np.frombuffer(raw, np.float64).reshape(size, size)


def _span(rows: pd.DataFrame) -> pd.DataFrame:
    """SPAN neighbours' matrices as one."""
    rows = rows.sort_values("chunk")
    whole = combined([_square(m) for m in rows["matrix"]])
    return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1], "text_hash": rows["text_hash"].iloc[:1], "chunk": rows["span"].iloc[:1], "matrix": [whole.tobytes()]})


def _inside(rows: pd.DataFrame) -> pd.DataFrame:
    """The border states inside a span, from those at its ends, which every row holds."""
    rows = rows.sort_values("chunk")
    ms = [_square(m) for m in rows["matrix"]]
    s = states(ms, int(rows["s_left"].iloc[0]), int(rows["s_right"].iloc[0]))
    return pd.DataFrame({"doc_id": rows["doc_id"], "text_hash": rows["text_hash"], "chunk": rows["chunk"], "left": s[:-1], "right": s[1:], "sum": [m[a, b] for m, a, b in zip(ms, s[:-1], s[1:], strict=True)]})


def border_states(matrices: DataFrame) -> DataFrame:
    """doc_id, text_hash, chunk, left, right, sum of every chunk, from doc_id, text_hash, chunk, matrix."""
    key = ["doc_id", "text_hash"]
    levels = [written(matrices)]
    top = levels[0].agg(F.max("chunk")).first()[0] or 0
    while top:
        spans = levels[-1].withColumn("span", F.floor(F.col("chunk") / SPAN).cast("int")).groupBy(*key, "span").applyInPandas(_span, levels[0].schema)
        levels.append(written(spans))
        top //= SPAN
    found = levels[-1].select(*key, F.col("chunk").alias("span"), F.lit(0).alias("s_left"), F.lit(0).alias("s_right"))
    if len(levels) == 1:  # every document is one chunk
        levels.append(levels[0])
        found = found.withColumn("span", F.floor(F.col("span") / SPAN).cast("int"))
    for level in levels[-2::-1]:
        there = level.withColumn("span", F.floor(F.col("chunk") / SPAN).cast("int"))
        mine = [there[k].eqNullSafe(found[k]) for k in (*key, "span")]
        both = there.join(found, mine).select(*(there[c] for c in there.columns), "s_left", "s_right")
        inside = written(both.groupBy(*key, "span").applyInPandas(_inside, "doc_id bigint, text_hash bigint, chunk int, left int, right int, sum double"))
        found = inside.select(*key, F.col("chunk").alias("span"), F.col("left").alias("s_left"), F.col("right").alias("s_right"))
    return inside


def _traced(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [pieces.trace(t, n, a, b) for t, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "length", "left", "right")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text_hash", "chunk", "sum")), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "chunk", "sum", "ids"])


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, with_text: bool = False) -> DataFrame:
    """``docs`` (any columns) with ``piece_ids`` array<int> and ``piece_score`` double.

    with_text: and ``decoded``, the text of the ids, without a second pass over small texts.

    Texts up to ``chunk`` characters: one map, no shuffle. Longer ones: their chunks are dealt out,
    one 2 KB matrix for each chunk meets the others of its document, and the ids are joined again.
    """
    docs = docs.drop("piece_ids", "piece_score", *["decoded"] * with_text)
    pieces = load(model)
    merges = isinstance(pieces, Merges)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    n = F.coalesce(F.char_length("text"), F.lit(0))
    schema = StructType([*docs.schema.fields]).add("piece_ids", ArrayType(IntegerType())).add("piece_score", DoubleType())
    if with_text:
        schema = schema.add("decoded", StringType())
    small = docs.filter(n <= chunk).mapInArrow(lambda it: _small(sent.value, with_text, it), schema)
    giant = docs.filter(n > chunk)
    key, overlap = ["doc_id", "text_hash"], 0 if merges else pieces.longest
    one = giant.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(key)
    parts = map_batches(one, lambda it: _cut(sent.value, chunk, overlap, it), "doc_id bigint, text_hash bigint, chunk int, length int, part string").repartition(*key, "chunk")
    traced_schema = "doc_id bigint, text_hash bigint, chunk int, sum double, ids array<int>"
    if merges:
        traced = map_batches(parts, lambda it: _merged(sent.value, it), traced_schema)
    else:
        ms = map_batches(parts, lambda it: _matrices(sent.value, it), "doc_id bigint, text_hash bigint, chunk int, matrix binary")
        borders = border_states(ms)
        at = [parts[k].eqNullSafe(borders[k]) for k in (*key, "chunk")]
        both = parts.join(borders, at).select(*(parts[k] for k in (*key, "chunk", "length", "part")), "left", "right", "sum")
        traced = map_batches(both, lambda it: _traced(sent.value, it), traced_schema)
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]))
    whole = traced.groupBy(*key).agg(ids.alias("piece_ids"), F.sum("sum").alias("piece_score"))
    mine = giant["doc_id"].eqNullSafe(whole["doc_id"]) & (F.xxhash64(giant["text"]) == whole["text_hash"])
    back = giant.join(whole, mine).select(*(giant[c] for c in docs.columns), "piece_ids", "piece_score")
    return small.unionByName(decode(back, model) if with_text else back)


def _decoded(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            text = [pieces.decode(x.values.to_numpy()) if x.is_valid else "" for x in part.column("piece_ids")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*part.schema.names, "decoded"])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (any columns, with piece_ids) and ``decoded``: the text of the ids; one map."""
    encoded = encoded.drop("decoded")
    sent = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))
    return encoded.mapInArrow(lambda it: _decoded(sent.value, it), StructType([*encoded.schema.fields]).add("decoded", StringType()))


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, score, ids_sha256 (of the comma-joined ids) and whether decoding gives the text back."""
    both = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=True)
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("bigint").alias("n_ids"),
        F.col("piece_score").alias("score"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
