"""Lattices against every path, the language model against plain counts, spans and scores on odd inputs."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa

from quaystone.llm import toxicity as tx
from quaystone.llm.textblocks import table, text_bytes

from .data import frame


def log_of(texts):
    data, offs = text_bytes(pa.array(texts))
    return tx.log_model(tx.symbol_counts(data, offs))


WORDS = "idiot trash the and loser erth moron stupid ing class book".split()


def sample(r, n=400):
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 9))) for _ in range(n)]


def path_score(reading, cost, model):
    """The score of one whole path, symbol by symbol."""
    state, v = (0, 0, 0), cost
    for c in reading:
        k = tx.symbol(c)
        if k == 0 and state == (0, 0, 0):
            continue
        v += model[((state[0] * 28 + state[1]) * 28 + state[2]) * 28 + k]
        state = (0, 0, 0) if k == 0 else (*state[1:], k)
    if state != (0, 0, 0):
        v += model[((state[0] * 28 + state[1]) * 28 + state[2]) * 28]
    return v


def test_viterbi_finds_the_best_of_all_paths():
    r = random.Random(5)
    model = log_of(sample(r))
    spans = ["1d10t", "i d i o t", "m0r0n!", "st*pid", "cl4$$", "b00k", "tt..h3", "él0s3r", "7r4$h", "", "a"]
    spans += ["".join(r.choice("idt01!$. sé*") for _ in range(r.randint(1, 7))) for _ in range(60)]
    for span in spans:
        paths = itertools.product(*tx.lattice(span))
        best = max(path_score("".join(t for t, _ in p), sum(c for _, c in p), model) for p in paths)
        # the found reading, with the cheapest way to it
        got = tx.restored(span, model)
        ways = [sum(c for _, c in p) for p in itertools.product(*tx.lattice(span)) if re.sub(" +", " ", "".join(t for t, _ in p)).lstrip(" ") == got]
        assert ways and math.isclose(path_score(got, max(ways), model), best, abs_tol=1e-4), span


def test_words_come_back():
    model = log_of(sample(random.Random(1)))
    for span, word in {"1d10t": "idiot", "i d i o t": "idiot", "l.o.s.e.r": "loser", "m0r0n!!": "moron", "stuuupid": "stupid", "tr@$h": "trash", "st*pid": "stupid", "book": "book"}.items():
        assert tx.restored(span, model).strip() == word


def test_counts_of_symbols():
    texts = ["Ab é-x", "", None, "a  b", "zé9q " * 3, "ab", "cd"]
    want = np.zeros(28**4, np.int64)
    for t in texts:
        for w in re.findall(r"[A-Za-zÀ-\U0010ffff]+", t or ""):
            ctx = [0, 0, 0]
            for c in [*w.lower(), " "]:
                k = tx.symbol(c)
                want[((ctx[0] * 28 + ctx[1]) * 28 + ctx[2]) * 28 + k] += 1
                ctx = [*ctx[1:], k]
    data, offs = text_bytes(pa.array(texts))
    assert (tx.symbol_counts(data, offs) == want).all()
    p = np.exp(tx.log_model(want).reshape(-1, 28).astype(np.float64))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def spans_by_hand(text):
    out, words = [], [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    one = lambda w: w[1] - w[0] == 1 and text[w[0]].isascii()
    k = 0
    while k < len(words):
        j = k
        while j + 1 < len(words) and one(words[j]) and one(words[j + 1]) and words[j + 1][0] - words[j][1] == 1:
            j += 1
        whole = text[words[k][0] : words[j][1]]
        if j - k >= 2 and re.search("[A-Za-z]", whole):
            out.append(whole)
        else:
            for a, b in words[k : j + 1]:
                w = text[a:b]
                if re.search("[A-Za-z]", w) and (re.search(r"[^A-Za-z\u0080-\U0010ffff]", w) or re.search(r"([a-z])\1", w.lower())):
                    out.append(w)
        k = j + 1
    return out


def test_spans_against_a_plain_search():
    r = random.Random(2)
    texts = ["".join(r.choice("abBé1! \n") for _ in range(r.randint(0, 40))) for _ in range(300)] + ["", "a b c", "1 2 3", "aa", "a", "!"]
    data, offs = text_bytes(pa.array(texts))
    a, b, at = tx.odd_spans(data, offs)
    raw = data.tobytes()
    for t, text in enumerate(texts):
        assert [raw[a[k] : b[k]].decode() for k in range(at[t], at[t + 1])] == spans_by_hand(text), text


def test_features_against_sets():
    texts = ["idiots idiots é ab", "", "longerword longerword2 abcd"]
    data, offs = text_bytes(pa.array(texts))
    index, at = tx.features(data, offs)
    sizes = []
    for t in texts:
        words = {w.encode() for w in re.findall(r"[a-z\u0080-\U0010ffff]+", t)}
        sizes.append(len(words) + sum(len({w[:k] for w in words if len(w) >= k}) for k in tx.PREFIXES))
    assert np.diff(at).tolist() == sizes
    alone, _ = tx.features(*text_bytes(pa.array(["idiots"])))
    assert set(alone) <= set(index[: at[1]])


def test_obfuscated_documents_score_like_plain_ones(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [r.choice("the and erth ing class book of tion".split()) for _ in range(20)]
        if toxic:
            words[4], words[11] = r.choice(["idiot", "moron"]), "stupid"
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    written = [(10_000, "the book of 1d10t and class stup1d tion"), (10_001, "the i d i o t book of $tup!d class"), (10_002, "the book of class and tion"), (10_003, None), (10_003, ""), (10_004, "the stupiiiid m0r0n " * 3000)]
    docs = frame(spark, rows + written)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    characters = tx.fit_characters(docs)
    got = {}
    for x in tx.score_toxicity(docs, characters, *tx.fit_toxicity(docs, marks, characters)).collect():
        got.setdefault(x["doc_id"], []).append(x["score"])
    assert sum(len(v) for v in got.values()) == len(rows) + len(written)
    assert min(got[10_000] + got[10_001] + got[10_004]) >= 0.3 > max(got[10_002])
    assert len(got[10_003]) == 2 and len(set(got[10_003])) == 1
    texts = {x["doc_id"]: x["restored"] for x in tx.deobfuscate(docs, characters).filter("doc_id >= 10000 and text is not null").collect()}
    assert texts[10_001].startswith("the idiot book of stupid")
    assert tx.deobfuscate(docs, characters).columns == [*docs.columns, "restored"]


def test_empty_tables(spark):
    none = frame(spark, [])
    characters = tx.fit_characters(none)
    assert np.allclose(np.exp(characters), 1 / 28)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    weights, bias = tx.fit_toxicity(none, labels, characters)
    assert tx.score_toxicity(none, characters, weights, bias).count() == 0
    assert [x["score"] for x in tx.score_toxicity(frame(spark, [(1, "x")]), characters, weights, bias).collect()] == [0.5]


def test_held_out_accuracy():
    import os

    from pyspark.sql import SparkSession

    spark, root = SparkSession.getActiveSession(), os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    root = root.replace("sf0.001", "sf0.01")
    rows = tx.op11_toxicity(spark, root).join(table(spark, root, "labels"), "doc_id").filter("held_out").collect()
    hit = sum(x["predicted"] == x["toxic"] for x in rows)
    assert len(rows) > 50 and hit / len(rows) > 0.9
    assert {(x["doc_id"], x["held_out"]) for x in rows} and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in rows)
