"""Toxicity: noisy-channel deobfuscation, then a logistic score of the restored text.

The channel writes a word in other characters (``1d10t``), with letters repeated (``idiooot``) or spaced out
(``i d i o t``, ``i.d.i.o.t``). A span that may be written so becomes a lattice: each run of one character is a node
whose options are the symbols it may stand for, with a channel cost. Viterbi finds the path that is likeliest under a
character language model (four symbols, counted over all texts); its states are the last three symbols, so the
result is the lattice's best path and no beam is cut. Spans without an alternative stay as they are.

The score is a logistic regression (``quality.ftrl``) on the distinct words of the restored text and on their
beginnings of 4 to 7 bytes. It reads the text alone. A null or empty text has no words and gets the bias.

Labels are learned from at most about ``sample_docs`` labelled ids (documented bound; as in ``quality``); the
language model counts every text and has 28**4 entries whatever the corpus; the weights are 2**BITS.

Repeated rows are scored each; texts of any length are read whole; an empty table gives no
rows, and without labels every score is one half; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .quality import ftrl, held_out, labelled
from .textblocks import FOLD, NOT_SPACE, blocks, map_batches, member_table, mixed, span_hashes, table, word_bounds

BITS = 20
SAMPLE_DOCS = 8000
THRESHOLD = 0.3
L1 = 2.0

#: Symbols of the language model: 0 ends a word, 1 to 26 are letters, 27 is any other letter.
SYMBOLS, END, OTHER = 28, 0, 27
#: Weight of the shorter context where the longer one was seen seldom.
BACKOFF = 5.0

# Letters that a character is commonly written for.
WRITTEN = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "<": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
}
#: Letters behind a star between two letters.
STARRED = "aeiou"
#: Logarithms of what the channel does: another character for a letter, a character that is none inside or beside a word,
#: a letter written twice or more often for one, for two.
SWAP, MARK, SKIP, TWICE, PAIR, LONGER, LONG_PAIR = -0.7, -2.5, -3.0, -4.0, 0.0, -0.2, -2.0

Options = list[tuple[str, float]]


def lattice(span: str) -> list[Options]:
    """Nodes of a lower-case span: what each run of one character may stand for, ' ' being the end of a word."""
    nodes: list[Options] = []
    i, n = 0, len(span)
    while i < n:
        c, j = span[i], i + 1
        while j < n and span[j] == c:
            j += 1
        run = j - i
        if "a" <= c <= "z":
            nodes.append([(c, 0.0)] if run == 1 else [(c + c, PAIR), (c, TWICE)] if run == 2 else [(c, LONGER), (c + c, LONG_PAIR)])
        elif c in WRITTEN:
            letters = [(x, SWAP) for x in WRITTEN[c]]
            nodes.append([(" ", MARK), ("", SKIP), *letters, *((x + x, 2 * s) for x, s in letters if run > 1)])
        elif c == "*" and run == 1 and 0 < i < n - 1 and span[i - 1].isalpha() and span[j].isalpha():
            nodes.append([(" ", MARK), ("", SKIP), *((x, SWAP) for x in STARRED)])
        elif c.isalpha():
            nodes += [[(c, 0.0)]] * run
        else:
            nodes.append([(" ", MARK), ("", SKIP)])
        i = j
    return nodes


def symbol(c: str) -> int:
    return END if c == " " else ord(c) - 96 if "a" <= c <= "z" else OTHER


def restored(span: str, model) -> str:
    """The likeliest reading of a span; of equal ones the first in the order of the lattice's options.

    model: natural logarithms of the next symbol, at ((third last * 28 + second last) * 28 + last) * 28 + next.
    """
    size = SYMBOLS**3
    best: dict[int, tuple] = {0: (0.0, None)}
    for options in lattice(span):
        new: dict[int, tuple] = {}
        for state, (score, path) in best.items():
            for text, cost in options:
                s, v, p = state, score + cost, path
                for c in text:
                    k = symbol(c)
                    if k:
                        at = s * SYMBOLS + k
                        v += model[at]
                        s, p = at % size, (c, p)
                    elif s:  # a word ends; what ends again stays ended
                        v += model[s * SYMBOLS]
                        s, p = 0, (c, p)
                if s not in new or new[s][0] < v:
                    new[s] = (v, p)
        best = new
    path, top = None, None
    for state, (score, p) in best.items():
        v = score + (model[state * SYMBOLS] if state else 0.0)
        if top is None or v > top:
            top, path = v, p
    out = []
    while path is not None:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else OTHER if b >= 192 else END for b in range(256)], np.int32)


def symbol_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How often each symbol follows the last three of its word, in the texts of a block; words never cross texts."""
    ends = np.zeros(len(data) + 1, bool)
    ends[offs] = True
    keep = (data < 128) | (data >= 192)  # a letter beyond ASCII counts by its first byte
    s = _SYMBOL[data]
    # one end before the block, one after each text; ends in a row are one
    full = np.concatenate([[END], np.insert(s[keep], np.cumsum(np.concatenate([[0], keep]))[offs[1:]], END)]).astype(np.int32)
    full = full[np.concatenate([[True], (full[1:] != END) | (full[:-1] != END)])]
    one = full[:-1]
    two = np.where(one != END, np.concatenate([[END], full[:-2]]), END)
    three = np.where(two != END, np.concatenate([[END, END], full[:-3]])[: len(two)], END)
    return np.bincount(((three * SYMBOLS + two) * SYMBOLS + one) * SYMBOLS + full[1:], minlength=SYMBOLS**4)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**4, np.int64)
    for _, data, offs in blocks(batches, "text"):
        total += symbol_counts(data, offs)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])


def log_model(counts: np.ndarray) -> np.ndarray:
    """Natural logarithms of the next symbol after three, each order falling back on the one below."""
    c = counts.reshape((SYMBOLS,) * 4).astype(np.float64)
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in (1, 2, 3, 4):
        n = c.sum(axis=tuple(range(4 - order)))
        p = (n + BACKOFF * p) / (n.sum(axis=-1, keepdims=True) + BACKOFF)
    return np.log(p).astype(np.float32).ravel()


def fit_characters(docs: DataFrame) -> np.ndarray:
    """The language model of all texts: every task adds up its counts, at most 28**4 rows reach the driver."""
    seen = map_batches(docs.select("text"), _count, "at int, n bigint")
    rows = seen.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**4, np.int64)
    counts[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return log_model(counts)


_LETTER = member_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_ASCII = member_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
#: Readings that a task keeps at hand; the next span beyond that starts the memory anew.
MEMORY = 1 << 17


def odd_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the spans that may be obfuscated, and the number of spans up to each text.

    Such a span is a run of visible characters with a Latin letter and either a character that is no letter or the same
    letter twice in a row; or three or more single characters, a Latin letter among them, one white-space character apart.
    """
    s, e, _ = word_bounds(data, offs, NOT_SPACE)
    lower = FOLD[data]
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    latin, letters = total(_ASCII[data]), total(_LETTER[data])
    again = total(np.concatenate([[False], (lower[1:] == lower[:-1]) & _ASCII[data[1:]]]) if len(data) else [])
    inside = lambda t: t[e] - t[s]
    odd = (inside(latin) > 0) & ((inside(letters) < e - s) | (again[e] - again[np.minimum(s + 1, e)] > 0))
    single = (e - s == 1) & (data[s] < 128) if len(s) else np.zeros(0, bool)
    joined = np.zeros(len(s), bool)  # the next span goes on here
    if len(s) > 1:
        text = np.searchsorted(offs, s, "right")
        joined[:-1] = single[:-1] & single[1:] & (s[1:] - e[:-1] == 1) & (text[1:] == text[:-1])
    first = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]])) if len(s) else np.zeros(0, np.int64)
    last = np.flatnonzero(~joined & np.concatenate([[False], joined[:-1]])) if len(s) else first
    spaced = (last - first >= 2) & (latin[e[last]] > latin[s[first]])
    first, last = first[spaced], last[spaced]
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    alone = np.flatnonzero(odd & (np.cumsum(edge[:-1]) == 0))
    a, b = np.concatenate([s[alone], s[first]]), np.concatenate([e[alone], e[last]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order], np.searchsorted(a[order], offs)


class Restorer:
    """Whole texts with their spans restored; a task's texts share the memory of readings."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = memoryview(model), {}

    def texts(self, data: np.ndarray, offs: np.ndarray) -> Iterator[bytes]:
        raw = FOLD[data].tobytes()
        a, b, at = odd_spans(data, offs)
        a, b = a.tolist(), b.tolist()
        for t, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            parts, here = [], lo
            for k in range(at[t], at[t + 1]):
                span = raw[a[k] : b[k]]
                reading = self.known.get(span)
                if reading is None:
                    if len(self.known) >= MEMORY:
                        self.known.clear()
                    reading = self.known[span] = restored(span.decode("utf-8", "replace"), self.model).encode()
                parts += (raw[here : a[k]], reading)
                here = b[k]
            parts.append(raw[here:hi])
            yield b"".join(parts)


#: Bytes of the beginnings of words that are features beside the whole words.
PREFIXES = (4, 5, 6, 7)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text in a block of lower-case bytes, and the offsets of each text."""
    s, e, n = word_bounds(data, offs, _LETTER)
    doc = np.repeat(np.arange(len(offs) - 1), n)
    h = span_hashes(data, s, e)
    _, once = np.unique(mixed(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    once.sort()
    s, e, doc, h = s[once], e[once], doc[once], h[once]
    index, owner = [h], [doc]
    for k in PREFIXES:
        long = e - s >= k
        index.append(mixed(span_hashes(data, s[long], s[long] + k) + np.uint64(k)))
        owner.append(doc[long])
    slots = (np.concatenate(index) >> np.uint64(64 - BITS)).astype(np.int64)
    both = np.unique(np.concatenate(owner) << BITS | slots)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(offs)))


def weight_of(n: np.ndarray | int) -> np.ndarray | float:
    """The value that each of a text's ``n`` distinct features has."""
    return 4.0 / (1.0 + np.log1p(n))


def _block_features(restorer: Restorer, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    texts = list(restorer.texts(data, offs))
    new = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return features(np.frombuffer(b"".join(texts), np.uint8), new)


def _fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for d, y, i in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "y", "idx")), strict=True):
            idx = np.frombuffer(i, np.int32)
            rows.append((d, idx, np.full(len(idx), weight_of(len(idx)), np.float32), y))
    # an order that no property of the text decides
    rows.sort(key=lambda r: (int(mixed(np.array([r[0]], np.int64).view(np.uint64))[0]), r[3], len(r[1])))
    weights, bias = ftrl([r[1:] for r in rows], BITS, L1)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, characters: np.ndarray, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows that are not held out (doc_id, toxic)."""
    picked = labelled(docs, labels, "toxic", sample_docs)
    if picked is None:
        return np.zeros(1 << BITS, np.float32), 0.0
    sent = docs.sparkSession.sparkContext.broadcast(characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for part, data, offs in blocks(batches, "text"):
            index, at = _block_features(restorer, data, offs)
            idx = [index[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(idx, pa.binary())], names=["doc_id", "y", "idx"])

    seen = map_batches(picked, run, "doc_id bigint, y int, idx binary")
    row = seen.repartition(1).mapInArrow(_fit, "weights binary, bias double").first()  # the bounded sample meets in one task
    return np.frombuffer(row["weights"], np.float32), row["bias"]


def deobfuscate(docs: DataFrame, characters: np.ndarray) -> DataFrame:
    """``docs`` with a column ``restored``: the lower-case text with its odd spans read; null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(characters)
    rest = [c for c in docs.columns if c != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(sent.value)
        for part, data, offs in blocks(batches, "text"):
            null = part.column("text").is_null().to_pylist()
            out = [None if x else t.decode("utf-8", "replace") for x, t in zip(null, restorer.texts(data, offs), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.select(rest).columns, pa.array(out, pa.string())], names=[*rest, "restored"])

    return docs.mapInArrow(run, StructType([docs.schema[c] for c in rest]).add("restored", "string"))


def score_toxicity(docs: DataFrame, characters: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id and the score of each whole text: one map over the scan, 7 MB broadcast whatever the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast((characters, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = sent.value
        restorer = Restorer(model)
        for part, data, offs in blocks(batches, "text"):
            index, at = _block_features(restorer, data, offs)
            total = np.concatenate([[0.0], np.cumsum(w[index], dtype=np.float64)])
            z = bias + weight_of(np.diff(at)) * (total[at[1:]] - total[at[:-1]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))], names=["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, score double")


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    characters = fit_characters(docs)
    weights, bias = fit_toxicity(docs, table(spark, sf_dir, "labels"), characters)
    scored = score_toxicity(docs, characters, weights, bias)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
