"""Collocations against a plain count of all phrases, on small tables with odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quaystone.llm import collocations as co


def by_hand(rows, support, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= support}
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2:
            continue
        around = [v for (g, x), v in f.items() if g == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if any(100 * v >= 80 * a for v in around):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rows, rank = [], Counter()
    for lang, s, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(rows)


def made(seed, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = "".join(r.choice(["a", "B", "é", "of the", "new", "x y z w", "of"]) + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(r.randint(0, 40)))
        rows.append((r.choice([None, i, i, 7]), r.choice([None, "", text, text, text, text, text]), r.choice(["en", "fr", None, "und"])))
    return rows + rows[:9] + [(1, "of the " * 5000, "en"), (2, "w" * 70_000 + " q", "es")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "p", 1) for r in rows], "doc_id bigint, text string, lang string, f bigint, phrase string, shard int")


@pytest.mark.parametrize("seed,support", [(1, 3), (2, 30), (3, 100)])
def test_against_all_phrases(spark, seed, support):
    rows = made(seed)
    got = sorted(tuple(x) for x in co.collocations(frame(spark, rows), support).collect())
    assert got == by_hand(rows, support) and got


def test_small_chunks_and_a_bitmap_that_lets_much_through(spark, monkeypatch):
    rows = made(4, 60)
    want = by_hand(rows, 5, 3)
    monkeypatch.setattr(co, "CHUNK", 500)
    monkeypatch.setattr(co, "MAX_BITS", 14)
    assert sorted(tuple(x) for x in co.collocations(frame(spark, rows), 5, 3).collect()) == want


def test_local_support_loses_nothing(spark):
    """Every frequent phrase is locally frequent in some shard, and the shards' shares add up."""
    rows = made(5)
    docs = frame(spark, rows)
    words = co.word_counts(docs, 30)
    for lang, total in words.groupBy("lang").sum("n_shard").collect():
        assert {x["n"] for x in words.filter(words["lang"] == lang).collect()} == {total}
        local = [x["local"] for x in words.filter(words["lang"] == lang).collect()]
        assert sum(x - 1 for x in local) < 30
    found = co.candidates(docs, words)
    bits = co.range_bits(words)
    whole = co.bitmap(found, bits)
    frequent = {(x["lang"], x["phrase"]) for x in co.count_candidates(docs, whole, 30).collect()}
    full = {(x["lang"], x["phrase"]) for x in co.count_candidates(docs, np.full_like(whole, 255), 30).collect()}
    assert frequent == full


def test_packed_numbers():
    r = np.random.default_rng(1)
    v = np.unique(r.integers(0, 1 << 40, 1000, dtype=np.uint64))
    c = r.integers(1, 1 << 32, len(v))
    a, b = co.unpacked(len(v), *co.packed(v, c))
    assert (a == v).all() and (b == c).all()


def test_empty_tables(spark):
    assert co.collocations(frame(spark, [])).count() == 0
    assert co.collocations(frame(spark, [(1, None, "en"), (2, "", None), (3, " .,", "fr")]), 1).count() == 0
