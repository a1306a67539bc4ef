"""Learnt operators by held-out accuracy, round trips and brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quaystone.llm import html_text, lm, quality, sentencepiece, vectors
from quaystone.llm.queries import QUERIES

from .data import frame, ordered, texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op1_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(r["quality"], got[r["doc_id"]]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(x["held_out"] for _, x in held)
    assert sum(y == x["predicted"] for y, x in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_quality_odd_inputs(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "a b c"), (4, "w " * 50_000), (4, "w " * 50_000)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in quality.score_quality(docs, *quality.fit_quality(docs, none)).collect()] == [0.5] * 5
    some = spark.createDataFrame([(1, 0), (2, None), (4, 1), (4, 1), (None, 1), (900, 0)], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, some)
    assert quality.score_quality(docs, *model).count() == 5
    kept = quality.keep_quality(docs, *model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.score_quality(frame(spark, []), *model).count() == 0


def brute_ftrl(rows):
    """Follow the regularised leader, number by number, as the published update has it."""
    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0
    q = quality

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(q.EPOCHS):
        for x, y in rows:
            w, wb = {i: weight(i) for i in x}, -zb / ((q.BETA + math.sqrt(nb)) / q.ALPHA)
            p = 1 / (1 + math.exp(-(sum(w[i] * v for i, v in x.items()) + wb)))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
            g = p - y
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / q.ALPHA * wb
            nb += g * g
    return {i: weight(i) for i in z}, -zb / ((q.BETA + math.sqrt(nb)) / q.ALPHA)


def test_fit_is_follow_the_regularised_leader():
    r = random.Random(7)
    rows = [({i: r.uniform(0.1, 3.0) for i in r.sample(range(40), r.randint(0, 9))}, r.randint(0, 1)) for _ in range(120)]
    weights, bias = quality.ftrl([(np.array(list(x), np.int64), np.array(list(x.values())), y) for x, y in rows])
    want, want_bias = brute_ftrl(rows)
    assert bias == pytest.approx(want_bias)
    assert all(weights[i] == pytest.approx(want.get(i, 0.0), rel=1e-5, abs=1e-7) for i in range(40)) and any(want.values())


def test_fit_takes_each_labelled_id_once(spark):
    docs = frame(spark, [(1, "good text"), (1, "good text"), (1, "other"), (4, "bad ###"), (8, "fine words")])
    labels = spark.createDataFrame([(1, 1), (4, 0), (8, 1)], "doc_id bigint, quality int")
    one = quality.fit_quality(docs, labels)
    again = quality.fit_quality(docs.unionByName(docs), labels)
    assert one[1] == again[1] and (one[0] == again[0]).all()


def test_scores_are_sparse_dot_products():
    data = np.frombuffer("one two !! two".encode(), np.uint8)
    index, at = quality.features(data, np.array([0, len(data), len(data)]))
    assert at.tolist() == [0, 8, 8]  # four words, three pairs, "two" again after one other
    w = np.random.default_rng(0).normal(size=1 << quality.BITS)
    assert quality.linear(w, 0.5, index, at) == pytest.approx([0.5 + quality.SCALE * w[index].mean(), 0.5])


# --- LM


def brute_base(rows, train):
    tok = lambda t: WORDS.findall((t or "").translate(LOW)) + ["\n"]
    c = Counter(x for d, t in rows if train(d) for x in tok(t))
    n, v = sum(c.values()), len(c)
    return [(d, len(tok(t)), sum(c[x] > 0 for x in tok(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok(t))) for d, t in rows]


@pytest.mark.parametrize("top", [400_000, 3, 0])
def test_base_scores(spark, top):
    rows = texts(7)
    docs = frame(spark, rows)
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    got = lm.score_texts(docs, docs.filter(~quality.held_out(7)), top).collect()
    want = ordered(brute_base(rows, train))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=lambda r: tuple((x is None, str(x)) for x in r[:4]))
    want = sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r[:4]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got) == pytest.approx(sorted(r[4] for r in want))


def trained(bodies, bits=16):
    """Codes and odds of a few texts."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in bodies])])
    b, place = lm.padded(data, offs)
    real = np.flatnonzero(place >= 0)
    two = (b[real - 2].astype(np.int64) << 8 | b[real - 1]), b[real]
    pairs = np.bincount((two[0] & 255) << 8 | two[1], minlength=1 << 16)
    letters = (lm._KIND[two[0] >> 8] == 1) & (lm._KIND[two[0] & 255] == 1) & (two[1] < 128)
    key, n = np.unique(two[0][letters] << 8 | two[1][letters], return_counts=True)
    codes, tables = lm.Codes(pairs.reshape(256, 256), np.stack([key >> 8, key & 255, n], 1)), lm.Tables(bits)
    tables.add(codes, data, offs)
    return codes, np.concatenate([lm.stretched(c) for c in tables.counts]), tables


def joined(texts_):
    return np.frombuffer(b"".join(texts_), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts_])]).astype(np.int64)


def path(codes, before, two, byte):
    tree = int(codes.tree_of[two])
    at = int(codes.start[tree << 8 | byte])
    return [int(x) for x in codes.flat[at : at + int(codes.length[tree << 8 | byte])]]


def brute_contexts(text, at):
    """The four context hashes at a place, from their definitions."""
    m32, past = (1 << 32) - 1, [text[at - k] if at >= k else 0 for k in range(1, 6)]
    mul = [int(x) for x in lm._M]
    two = past[0] | past[1] << 8
    three = two | past[2] << 16
    five = three * mul[0] & m32 ^ (past[3] | past[4] << 8) * mul[1] & m32
    start = at
    while start > 0 and at - start < 12 and not lm._OUTSIDE[text[start - 1]]:
        start -= 1
    word = sum(int(lm._SPREAD[text[i]]) * pow(int(lm.ODD), i - start, 1 << 64) for i in range(start, at)) & (1 << 64) - 1
    word = word >> 20 & m32 ^ past[0] * mul[2] & m32
    out = []
    for k, h in enumerate((two, three, five, word)):
        h = (h + k + 1) * mul[k] & m32
        h ^= h >> 15
        out.append(h * mul[(k + 1) % 4] & m32)
    return past[0], past[1] << 8 | past[0], out


def brute_slots(hashes, step, bits=16):
    mark = int(lm._MARK[step])
    return [((h * mark & (1 << 32) - 1) >> 20) & (lm.LINES[k] - 1) | (h >> 32 - bits) & ~(lm.LINES[k] - 1) for k, h in enumerate(hashes)]


def predictions(odds, hashes, step):
    return [int(odds[(k << 16) + i]) for k, i in enumerate(brute_slots(hashes, step))]


def brute_run(mixer, codes, odds, text):
    """Log probability of one text, step by step, with plain numbers."""
    weights = [[float(x) / lm.UNIT for x in row] for row in mixer.weights]
    table = mixer.refine[1] / mixer.refine.sum(0)
    own = {}
    for kind in range(4):
        for bucket in range(lm.BUCKETS):
            zero, one = (sum(float(mixer.refine[v][c * lm.BUCKETS + bucket]) for c in range(256) if lm._KIND[c] == kind) for v in (0, 1))
            own[kind, bucket] = [lm.OWN * zero / (zero + one), lm.OWN * one / (zero + one)]
    text, total, at = list(text) + [lm.END], 0.0, 0
    ends = lm.update_places(len(text)).tolist()
    while at < len(text):
        until = next((e for e in ends if e > at), len(text))
        slope, seen, later = {}, Counter(), []
        while at < min(until, len(text)):
            before, two, hashes = brute_contexts(text, at)
            kind = int(lm._KIND[before])
            for step in path(codes, before, two, text[at]):
                bit, row = step & 1, kind * 8 + (step >> 1 & 7)
                x = predictions(odds, hashes, step)
                s = min(max(sum(a * b for a, b in zip(x, weights[row])), -8.99), 8.99)
                p = 1 / (1 + math.exp(-s))
                bucket = int(s / 0.75 + lm.BUCKETS / 2)
                zero, one = own[kind, bucket]
                q = 0.5 * p + 0.25 * (float(table[before * lm.BUCKETS + bucket]) + one / (zero + one))
                total += math.log(q if bit else 1 - q)
                seen[row] += 1
                for k in range(4):
                    slope[row, k] = slope.get((row, k), 0.0) + (bit - p) * x[k]
                later.append((kind, bucket, bit))
            at += 1
        for (row, k), g in slope.items():
            weights[row][k] += lm.RATE / lm.UNIT**2 * g / (1 + seen[row] / 128)
        for kind, bucket, bit in later:
            own[kind, bucket][bit] += 1
    return total


def test_scores_step_by_step():
    """Mixing, gates, both refining tables and every update, against plain loops, whatever stands beside a text."""
    r = random.Random(3)
    words = ["the", "house", "of", "a", "river", "Größe", "x1", "日本", "and"]
    make = lambda n: " ".join(r.choices(words, k=n)).encode()
    codes, odds, _ = trained([make(60) for _ in range(60)])
    assert codes.tree_of.max() > 255  # trees of two letters are in use
    mixer = lm.Mixer()
    for _ in range(3):
        mixer.run(codes, odds, *joined([make(40) for _ in range(30)]), learn=True)
    assert np.abs(mixer.weights - lm.FIRST_WEIGHT).max() > 0.01
    several = [make(3), b"", make(300), b"zz\x00\xf0\x9f", make(40), make(150) * 3]
    got = lm.Mixer(mixer.weights, mixer.refine).run(codes, odds, *joined(several))
    assert got == pytest.approx([brute_run(mixer, codes, odds, t) for t in several], rel=2e-3)


def test_counts_are_those_of_every_step():
    r = random.Random(5)
    bodies = [" ".join(r.choices(["the", "cat", "é", "on"], k=r.randint(0, 30))).encode() for _ in range(20)] + [b""]
    codes, _, tables = trained(bodies)
    want = [Counter() for _ in range(4)]
    for body in bodies:
        text = list(body) + [lm.END]
        for at in range(len(text)):
            before, two, hashes = brute_contexts(text, at)
            for step in path(codes, before, two, text[at]):
                for k, slot in enumerate(brute_slots(hashes, step)):
                    want[k][slot * 2 + (step & 1)] += 1
    for k in range(4):
        found = np.flatnonzero(tables.counts[k])
        assert dict(zip(found.tolist(), tables.counts[k][found].tolist())) == want[k]


def test_model_is_a_probability():
    """The probabilities of all next bytes, the end included, sum to one after any beginning."""
    codes, odds, _ = trained([b"the cat sat on the mat and the hat " * 20])
    mixer = lm.Mixer()
    for start in (b"", b"the c", b"th", bytes(random.Random(0).choices(range(255), k=40))):
        total = 0.0
        before, two, hashes = brute_contexts(list(start), len(start))
        for x in range(256):
            q = 1.0
            for step in path(codes, before, two, x):
                s = sum(x / lm.UNIT * float(mixer.weights[int(lm._KIND[before]) * 8 + (step >> 1 & 7), k]) for k, x in enumerate(predictions(odds, hashes, step)))
                p = 1 / (1 + math.exp(-s))
                q *= p if step & 1 else 1 - p
            total += q
        assert total == pytest.approx(1.0, abs=1e-6)


def test_model_beats_noise_and_ignores_neighbours():
    codes, odds, _ = trained([f"the number {i} and the house of {i % 7} are here".encode() for i in range(300)])
    mixer = lm.Mixer()
    both = [b"the house of 5", b"eht esuoh fo 5", b""]
    score = lambda xs: mixer.run(codes, odds, *joined(xs))
    s = score(both)
    assert s[0] > s[1] + 10 and (s < 0).all()
    assert score(both[::-1])[::-1] == pytest.approx(s) and score(both[:1]) == pytest.approx(s[:1])
    assert len(mixer.run(codes, odds, *joined([]))) == 0


def test_tables_grow_with_the_training_bytes():
    assert [lm.table_bits(n) for n in (0, 1 << 18, 1 << 20, 1 << 40)] == [16, 17, 19, lm.MAX_BITS] and lm.table_bits(1 << 40, 26) == 26
    assert lm.starts_of(17) == [0, 1 << 17, 2 << 17, 3 << 17, 4 << 17] and lm.bits_of(22) == [18, 20, 22, 22]


def test_learning_of_tasks_is_averaged_by_bytes(spark):
    docs = frame(spark, texts(11, 80))
    counted = np.zeros(1 << 16, np.int64)
    counted[ord("a") << 8 | ord(" ")] = 50
    model = lm.train(docs.repartition(7), counted.reshape(256, 256), bits=16)
    assert len(model.odds) == 4 << 16 and np.abs(model.mixer.weights - lm.FIRST_WEIGHT).max() > 0


def test_lm_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    t_of = dict(rows)
    got = {r["doc_id"]: r for r in QUERIES["op3_lm_score"](spark, small).collect()}
    for d, n, known, total, base in brute_base(rows, lambda d: zlib.crc32(str(d).encode()) % 7 != 2):
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, zlib.crc32(str(d).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / (len(t_of[d].encode()) + 1))
    held = [r for d, r in got.items() if r["held_out"]]
    bits = -sum(r["score"] for r in held) / math.log10(2) / sum(len(t_of[r["doc_id"]].encode()) for r in held)
    assert bits < 2.9


def test_lm_empty_training(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    got = {r["doc_id"]: r for r in lm.score_texts(docs, docs.limit(0)).collect()}
    assert got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0.0 and got[2]["n_tokens"] == 1


# --- SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.Pieces.load()


def brute_encode(p, text):
    """The best sum over all segmentations, character by character."""
    t = " " + text
    best = [0.0] + [-math.inf] * len(t)
    for i in range(len(t)):
        for k in range(1, min(p.longest, len(t) - i) + 1):
            s = p.scores.get(t[i : i + k], p.unknown if k == 1 else -math.inf)
            best[i + k] = max(best[i + k], best[i] + s)
    return best[-1]


ODD = ["", "Hello  world\n é 漢", "the the the", "   lead", "trail   ", "x" * 300, "漢字" * 20, "a▁b", "\0\t\r\n", "!!!###the$$$", "😀 emoji 😀"]


def test_encoding_is_the_best_sum_and_comes_back(pieces):
    r = random.Random(2)
    for t in ODD + ["".join(r.choices("abct heion.,#é\n", k=r.randint(1, 200))) for _ in range(60)]:
        ids, score = pieces.encode(t)
        assert pieces.decode(ids) == t
        assert score == pytest.approx(brute_encode(pieces, t) if t else 0.0)


@pytest.mark.parametrize("chunk", [5, 16, 17, 100])
def test_chunks_give_the_same_sum(pieces, chunk):
    r = random.Random(chunk)
    for t in [x for x in ODD if x] + ["".join(r.choices("thean ", k=r.randint(1, 300))) for _ in range(20)]:
        whole = " " + t
        starts = range(0, len(whole), chunk)
        parts = [(whole[s : s + chunk + pieces.longest], min(chunk, len(whole) - s)) for s in starts]
        ms = [pieces.matrix(*x) for x in parts]
        at = sentencepiece.states(ms)
        assert sum(m[a, b] for m, a, b in zip(ms, at, at[1:])) == pytest.approx(pieces.encode(t)[1])
        ids = [i for (x, n), a, b in zip(parts, at, at[1:]) for i in pieces.trace(x, n, a, b)]
        assert pieces.decode(np.array(ids)) == t


def test_product_is_associative(pieces):
    m = [pieces.matrix("the house in the hill and so on"[i : i + 9 + pieces.longest], 9) for i in (0, 9, 18)]
    p = sentencepiece.product
    assert np.array_equal(p(p(m[0], m[1]), m[2]), p(m[0], p(m[1], m[2])))


@pytest.mark.parametrize("span", [2, 3, 64])
def test_border_states_of_spans(spark, monkeypatch, pieces, span):
    """Spans of spans give the border states that one pass over all matrices gives."""
    monkeypatch.setattr(sentencepiece, "SPAN", span)
    r = random.Random(span)
    rows, want = [], {}
    for d, n in ((1, 1), (2, 7), (None, 20), (4, 12)):
        t = " " + "".join(r.choices("the house an ", k=9 * n - 4))
        ms = [pieces.matrix(t[a : a + 9 + pieces.longest], min(9, len(t) - a)) for a in range(0, len(t), 9)]
        rows += [(d, 5, k, m.tobytes()) for k, m in enumerate(ms)]
        s = sentencepiece.states(ms)
        want[d] = sum(m[a, b] for m, a, b in zip(ms, s, s[1:]))
    got = sentencepiece.border_states(spark.createDataFrame(rows, "doc_id bigint, text_hash bigint, chunk int, matrix binary")).collect()
    assert len(got) == len(rows)
    for d, total in want.items():
        mine = sorted((x for x in got if x["doc_id"] == d), key=lambda x: x["chunk"])
        assert sum(x["sum"] for x in mine) == pytest.approx(total)
        assert mine[0]["left"] == 0 and mine[-1]["right"] == 0 and all(a["right"] == b["left"] for a, b in zip(mine, mine[1:]))


def test_giant_documents_of_a_unigram_model(spark, monkeypatch, pieces):
    """The scan in Spark, with this model's scores taken as those of a unigram model."""
    monkeypatch.setattr(sentencepiece, "load", lambda path: pieces)
    docs = frame(spark, [(1, "the house in the hills " * 30), (2, "short"), (None, "é 漢 xx " * 40), (1, "the house in the hills " * 30)])
    got = sentencepiece.decode(sentencepiece.encode(docs, chunk=32)).collect()
    assert len(got) == 4
    for r in got:
        assert r["decoded"] == r["text"] and r["piece_score"] == pytest.approx(pieces.encode(r["text"])[1])


def test_giant_documents_in_spark(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + texts(8, 20) + [(None, "giant one " * 30), (500, "giant two " * 40), (500, "giant two " * 40)]
    docs = frame(spark, rows)
    got = sentencepiece.decode(sentencepiece.encode(docs, chunk=64))
    again = sentencepiece.encode(docs, chunk=64, with_text=True)
    assert again.columns == got.columns and again.select("text", "decoded", "piece_ids").exceptAll(got.select("text", "decoded", "piece_ids")).count() == 0
    whole = {(r["doc_id"], r["text"]): r["piece_score"] for r in sentencepiece.encode(docs).collect()}
    out = got.collect()
    assert len(out) == len(rows) and got.columns == [*docs.columns, "piece_ids", "piece_score", "decoded"]
    for r in out:
        assert r["decoded"] == (r["text"] or "")
        assert r["piece_score"] == pytest.approx(whole[r["doc_id"], r["text"]])
    assert sentencepiece.encode(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_ids_are_the_library_s(spark, small, chunk):
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=sentencepiece.MODEL)
    odd = [t for t in ODD if "▁" not in t] + ["line\n  two\n\nthree " * 20, "x" * 200 + " y" * 200, "<s> </s> <0x0A> <unk>"]
    docs = frame(spark, list(enumerate(odd))).select("doc_id", "text").union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    for r in sentencepiece.encode(docs, chunk=chunk).collect():
        assert r["piece_ids"] == m.encode(r["text"] or "")
        assert r["piece_score"] == pytest.approx(sum(m.get_score(r["piece_ids"])) if r["piece_ids"] else 0.0)


def test_sentencepiece_query(spark, small):
    assert QUERIES["op9_sentencepiece"](spark, small).filter("not round_trip or n_ids <= 0").count() == 0


# --- vectors


def brute_nearest(rows, every, top):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            s = sorted((-float(v @ q), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = [(j, -x) for x, j in s[:top]]
    return out


def test_small_index_is_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)] + [(300 + i, r.normal(size=3).astype(np.float32).tolist()) for i in range(30)] + [(200, None), (201, []), (202, [0.0] * 8), (203, [math.nan] * 8), (204, [math.inf] * 8), (205, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, vector string, rank int")
    want = brute_nearest([(i, v) for i, v in rows], 20, 20)
    got = {}
    for x in vectors.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert vectors.nearest(df.limit(0)).count() == 0


def recall(rows, got, every=20, top=20):
    """The share of each query's true nearest that were found."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hit = total = 0
    for k in np.flatnonzero(ids % every == 0):
        s = x @ x[k]
        s[k] = -np.inf
        true = ids[np.lexsort((ids, -s))[:top]]
        hit += len(got[ids[k]] & set(true.tolist()))
        total += len(true)
    return hit / total


@pytest.mark.parametrize(("sf", "shard"), [("0.01", (64, 128)), ("0.1", (4096, 65536)), ("0.1", (200, 200))])
def test_recall(spark, monkeypatch, sf, shard):
    """At two sizes of table, with one shard to ten."""
    monkeypatch.setattr(vectors, "SHARD", shard)
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()
    got = {}
    for r in QUERIES["op6_nearest"](spark, f"/root/testdata/sf{sf}").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall([(r["vec_id"], r["embedding"]) for r in e], got) >= 0.95


def test_shards_grow_once_every_core_has_one():
    assert [vectors.shard_count(n, 8) for n in (0, 1, 5000, 51_282, 500_000, 10**7)] == [1, 1, 2, 8, 8, 153]


def test_repeated_ids_and_vectors(spark, monkeypatch):
    """Many rows of one id don't crowd out others; an id with two vectors is two queries with answers of their own."""
    monkeypatch.setattr(vectors, "SHARD", (16, 16))
    r = np.random.default_rng(2)
    v = [r.normal(size=4).astype(np.float32).tolist() for _ in range(60)]
    rows = [(20, v[0])] * 30 + [(41, v[0])] + [(100 + i, v[i]) for i in range(1, 60) if (100 + i) % 20] + [(60, v[1]), (60, v[2])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for x in vectors.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    distinct = sorted({(i, tuple(x)) for i, x in rows})
    want = {}
    for q, x in distinct:
        if q % 20 == 0:
            s = sorted((-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, y in distinct if i != q)[:20]
            want.setdefault(q, []).extend((k + 1, i, -z) for k, (z, i) in enumerate(s))
    assert got.keys() == want.keys() and len(got[60]) == 40
    for q in want:
        a, b = sorted(got[q]), sorted(want[q])
        assert [x[:2] for x in a] == [x[:2] for x in b]
        assert [x[2] for x in a] == pytest.approx([x[2] for x in b])
    assert got[20][0][1] == 41 or max(x[2] for x in got[20]) > float(np.dot(v[0], v[0]))


# --- HTML


def test_pages_of_the_smallest_table(spark, small):
    import html

    page = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op7_html_text"](spark, small).collect():
        body = re.search(r"<article>(.*?)</article>", page[r["page_id"]], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|article)>", body)]
        assert r["text"] == "\n\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<article><p>One &lt;b&gt; two &amp; three.\n four</p></article>", "One <b> two & three. four"),
        ('<div id="sidebar"><p>Some links to look at, with words.</p></div><article><h1>Title</h1><p>Short.</p></article>', "Title\n\nShort."),
        ("<article><p>Text here is good.</p><script>if (a<b) x('</p>')</script><style>p{}</style><!-- <p>no</p> --></article>", "Text here is good."),
        ('<article><p>The article says something here.</p><section class="comments"><p>I liked this very much, thank you all.</p></section></article>', "The article says something here."),
        ("<form><label>Name</label><button>Go</button></form><main><p>Main text of it.</p></main><footer><p>Imprint and more.</p></footer>", "Main text of it."),
        ('<article><p title="a > b">Quoted marks are fine.</p><p>Unclosed', "Quoted marks are fine.\n\nUnclosed"),
        ("<article><p>Euler wrote <math><mi>e</mi></math> once.</p><p>A <svg viewBox='0 0 1 1'/> b <object data='x'>instead</object>.</p><noscript>No script here.</noscript></article>", "Euler wrote e once.\n\nA b instead.\n\nNo script here."),
        ("<article><p>Text <svg><title>no</title><path d='M0'/></svg> goes on.</p><script src='x'></script><p>To the end.</p></article>", "Text goes on.\n\nTo the end."),
    ],
)
def test_page_parts(page, text):
    assert html_text.main_text(page) == text


LONG = "This is a sentence of some length that says what the page is about, and it goes on for a while. "
NEUTRAL = (
    "<div class='c1'><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>About us</a></li></ul></div>"
    "<div class='c2'><h1>A title</h1><p>" + LONG * 2 + "</p><p>Short.</p><p>" + LONG * 2 + "</p><h2>Next</h2><p>" + LONG + "</p></div>"
    "<div class='c3'><a href='/x'>Imprint</a> <a href='/y'>Privacy</a> <a href='/z'>Contact</a></div>"
)


def test_neutral_names_without_article():
    """Menus go by their links, short lines between long ones stay by their neighbours."""
    long = " ".join(LONG.split())
    assert html_text.main_text(NEUTRAL).split("\n\n") == ["A title", f"{long} {long}", "Short.", f"{long} {long}", "Next", long]


def test_the_cut_decides():
    """Labels that no block's own cost gives."""
    page = html_text.read(NEUTRAL)
    own = {b.text: b.score > 0 for b in page.blocks}
    kept = {b.text: k for b, k in zip(page.blocks, html_text.labels(page))}
    assert not own["Short."] and kept["Short."] and not own["Next"] and kept["Next"]
    comments = "<article><p>" + LONG * 2 + "</p></article><div id='comments'><div><div><p>" + LONG * 2 + "I agree.</p></div></div></div>"
    page = html_text.read(comments)
    assert [b.score > 0 for b in page.blocks] == [True, True] and html_text.labels(page) == [True, False]


def surrounding(page):
    """Each block's own cost with those of its section and of all elements around it (a whole element's dealt out to its blocks)."""
    below = Counter(x for b in page.blocks for x in b.place[1:])
    each = {x: page.costs[x] + html_text.WHOLE * (page.costs[x] > 0) / n for x, n in below.items()}
    return [b.score + cost + sum(each[x] for x in b.place[1:]) for b, (_, cost) in zip(page.blocks, html_text.sections(page))]


def neutral(page):
    page = re.sub(r"(?i)<(/?)(article|main|nav|aside|header|footer)\b", r"<\1div", page)
    return re.sub(r"""(?i)\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def test_labels_that_only_the_cut_gives(spark):
    """Labels that differ from the sign of all costs that bear on a block, most of them on pages without telling names and kinds."""
    changed = total = same = given = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        page, plain = html_text.read(r["html"] or ""), html_text.read(neutral(r["html"] or ""))
        assert [b.text for b in plain.blocks] == [b.text for b in page.blocks]
        kept, kept_plain = html_text.labels(page), html_text.labels(plain)
        given += sum((c > 0) != k for c, k in zip(surrounding(page), kept))
        changed += sum((c > 0) != k for c, k in zip(surrounding(plain), kept_plain))
        same += sum(x == y for x, y in zip(kept_plain, kept))
        total += len(kept)
    assert given > 0 and changed > total / 20 and same > total * 0.95


PARTS = ["<p>{}</p>", "<div>{}</div>", "<div class='ad'>{}</div>", "<ul><li>{}</li><li><a href='x'>{}</a></li></ul>", "<h2>{}</h2>", "<article>{}</article>", "<aside><p>{}</p></aside>", "{}<br>"]


def test_cut_of_whole_pages_is_minimal():
    """Every way to label the nodes of small pages costs at least as much as the cut."""
    r = random.Random(4)
    seen = 0
    while seen < 40:
        page = "".join(r.choice(["<div>", "<section>", "<article>", "</div>", "</article>", ""]) + r.choice(PARTS).replace("{}", " ".join(["word"] * r.randint(1, 30)) + r.choice([".", "", " |"])) for _ in range(r.randint(1, 4)))
        score, near = html_text.graph_of(html_text.read(page))
        n = len(score)
        if not 2 <= n <= 11:
            continue
        seen += 1
        edges = [(i, j, c) for i in range(n) for j, c in near[i].items()]
        cost = lambda side: sum(abs(s) for s, k in zip(score, side) if (s > 0) != k) + sum(c for i, j, c in edges if side[i] and not side[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.content_side(score, near)) == pytest.approx(best)


def test_cut_is_minimal():
    r = random.Random(9)
    for _ in range(60):
        n = r.randint(1, 8)
        score = [r.uniform(-3, 3) for _ in range(n)]
        near = [{} for _ in range(n)]
        for i in range(n):
            for j in range(i):
                if r.random() < 0.5:
                    near[i][j] = near[j][i] = r.uniform(0, 2)
        cost = lambda side: sum(abs(s) for s, k in zip(score, side) if (s > 0) != k) + sum(c for i in range(n) for j, c in near[i].items() if side[i] and not side[j])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        saved = [dict(x) for x in near]
        side = html_text.content_side(score, near)
        near[:] = saved
        assert cost(side) == pytest.approx(best)


def test_long_and_odd_pages(spark):
    rows = [(1, "u", "<article>" + "<p>words and words here.</p>" * 5000 + "</article>"), (2, None, None), (None, "u", "<nav>x</nav>"), (2, None, None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id bigint, url string, html string, n_chars int")
    got = {r["page_id"]: r["n_chars"] for r in html_text.extract_text(df).collect()}
    assert got == {1: 5000 * 21 + 4999 * 2, 2: 0, None: 0}
