"""Text operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from quaystone.llm import byte_dedup, decontaminate, jaccard, secrets, simhash, suffixes, superkmers, word_dedup
from quaystone.llm.queries import ORACLE_SQL, QUERIES

from .data import frame, ordered, texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- substring dedup


def brute_bytes(rows, k):
    bodies = [(d, (t or "").encode()) for d, t in rows]
    c = Counter(b[i : i + k] for _, b in bodies for i in range(len(b) - k + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if c[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, k):
    docs = [(d, WORDS.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in docs:
        for i in range(len(w) - k + 1 if d is not None else 0):
            x = tuple(w[i : i + k])
            least[x] = min(least.get(x, d), d)
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - k + 1 if d is not None else 0):
            if least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [256, 2])
def test_bytes_and_words_removed(spark, monkeypatch, hot):
    monkeypatch.setattr(superkmers, "HOT", hot)
    rows = [(d, t if t is None or len(t) < 5000 else t[:3000]) for d, t in texts(hot)]
    docs = frame(spark, rows)
    assert ordered(byte_dedup.remove_repeated_bytes(docs, 9).drop("kept").collect()) == ordered(brute_bytes(rows, 9))
    assert ordered(word_dedup.remove_repeated_words(docs, 7).drop("kept").collect()) == ordered(brute_words(rows, 7))


def test_queries_on_the_whole_smallest_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(QUERIES["op2_byte_dedup"](spark, small).collect()) == ordered(brute_bytes(rows, 400))
    assert ordered(QUERIES["op8_word_dedup"](spark, small).collect()) == ordered(brute_words(rows, 50))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, small, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df, r = QUERIES[name](spark, small), duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.select(*names).collect()) == ordered(r.fetchall())


def test_runs_do_not_hang_on_the_step(monkeypatch):
    units = np.random.default_rng(3).integers(0, 3, 700).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    offs = np.array([0, 300, 300, 310, 700])

    def anchors():
        out = {}
        for d, first, n, anchor, _, _ in superkmers.runs(lambda a, b: units[a:b], offs, 20, 6):
            for x in zip(d.tolist(), first.tolist(), n.tolist(), anchor.tolist()):
                out |= {(x[0], x[1] + i): x[3] for i in range(x[2])}
        return out

    whole = anchors()
    assert set(whole) == {(0, i) for i in range(281)} | {(3, i) for i in range(371)}
    monkeypatch.setattr(superkmers, "STEP", 64)
    assert anchors() == whole


def repeated(strings, k, limit):
    space = suffixes.Space(limit)
    held = suffixes.Strings(space)
    for x in strings:
        held.add(x)
    return suffixes.repeated(held, k).tolist(), space


def brute_repeated(strings, k):
    c = Counter(s[i : i + k] for s in strings for i in range(len(s) - k + 1))
    return [i + k <= len(s) and c[s[i : i + k]] > 1 for s in strings for i in range(len(s) + 1)]


@pytest.mark.parametrize(("limit", "part", "ranges", "places"), [(200, 7, 4, 3), (5000, 1 << 20, 2, 1 << 14), (1 << 26, 1 << 20, 512, 1 << 14), (3000, 64, 8, 3)])
def test_suffix_order_finds_repeats(monkeypatch, limit, part, ranges, places):
    """Blocks, ranges of symbols and the recursion at several sizes give what counting gives."""
    for name, value in (("PART", part), ("RANGES", ranges), ("RANGE_PLACES", places)):
        monkeypatch.setattr(suffixes, name, value)
    r, depth = random.Random(limit), 0
    for i in range(60):
        alphabet = r.choice([b"ab", b"a", b"abcdefgh", bytes(range(200))])
        base = [bytes(r.choice(alphabet) for _ in range(40)) for _ in range(3)]
        strings = [b"".join(b[r.randint(0, 30) :][: r.randint(1, 20)] for b in r.choices(base, k=r.randint(1, 4))) for _ in range(r.randint(1, 12))] + [b""] * (i % 3 == 0)
        k = r.choice([3, 7, 20])
        got, space = repeated(strings, k, limit)
        assert got == brute_repeated(strings, k)
        depth = max(depth, space.depth)
    assert depth > 0


def test_shards_above_the_memory_limit_use_files_and_recursion(spark, small):
    """Ordinary texts in 64 KB of memory: queues and arrays go to files, the string of names is sorted by recursion."""
    rows = [r["text"].encode() for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(150).collect()]
    strings = [t[:4000] for t in rows if t]
    got, space = repeated(strings, 100, 64 << 10)
    assert got == brute_repeated(strings, 100) and any(got)
    size = sum(map(len, strings))
    assert space.spilled > size and space.on_disk > size and space.depth >= 2
    same, roomy = repeated(strings, 100, suffixes.LIMIT)
    assert same == got and roomy.spilled == roomy.on_disk == 0 and roomy.depth == space.depth


def test_suffixes_come_in_order():
    r = random.Random(8)
    text = [r.choice([1, 2, 2, 3, 300, 301]) for _ in range(400)] + [0]
    got = np.concatenate([b[0] for b in suffixes.suffixes(np.array(text), 302, suffixes.Space(1000))]).tolist()
    assert got == sorted(range(400), key=lambda i: text[i:], reverse=True)


# --- SimHash


def brute_simhash(rows):
    prints = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOW))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)))
    v = np.array(prints, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    group = np.arange(len(v))
    while (new := np.where(near, group[None, :], len(v)).min(1)).tolist() != group.tolist():
        group = new
    least = {}
    for (d, _), g in zip(rows, group.tolist()):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [(d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, group.tolist())]


def hexed(df):
    return [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in df.collect()]


def test_simhash_components(spark):
    rows = texts(3, 50, share=False)
    long = " ".join(random.Random(5).choices([f"w{i}" for i in range(500)], k=400))
    rows += [(100 + i, long.replace(" w7", f" v{i}", 1)) for i in range(8)] + [(200, None), (201, ""), (202, "   ")]
    assert ordered(hexed(simhash.near_duplicates(frame(spark, rows)))) == ordered(brute_simhash(rows))


def test_simhash_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(QUERIES["op10_simhash"](spark, small).collect()) == ordered(brute_simhash(rows))


def test_pairs_at_every_distance():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(0, 300, 2):
        fp[i + 1] = fp[i]
        for b in r.choice(64, i % 6, replace=False):
            fp[i + 1] ^= np.uint64(1 << int(b))
    order = np.argsort(np.bitwise_count(fp ^ simhash.PIVOTS[0]), kind="stable")
    fp = fp[order]
    said = [0, 0]
    got = {x for a, b in simhash._within(fp, np.zeros(300, np.int64), 3, said) for x in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert got == want and said[0] > 10 * said[1] > 0  # the pivots discard most of what meets


def test_components_of_slices(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 3)
    r = random.Random(4)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    got = simhash._stars(60, (tuple(np.array(x) for x in zip(*pairs[i : i + 4])) for i in range(0, 45, 4)))
    root = list(range(60))
    for a, b in pairs:
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    assert got.tolist() == root


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, None), (8, ""), (1, "x y z w v u t s")]
    kept = simhash.keep_one(frame(spark, rows))
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(3, "a b c d"), (8, ""), (1, "x y z w v u t s")}
    assert kept.count() == 3


def changed_copies():
    r = random.Random(12)
    rows = []
    for _ in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([5, 30, 60, 200]))]
        rows.append(base)
        for _ in range(r.randint(0, 8)):
            x = list(r.choice(rows[-3:]))
            for _ in range(r.randint(1, 3)):
                x[r.randrange(len(x))] = r.choice(["new", "X", "é"])
            rows.append(x)
    rows += [["common", "line", "of", "many", "texts", "here", f"n{i}"] for i in range(10)] + [list("abcdefgh")] * 2
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def brute_copies(rows, shingle, similarity):
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= round(10 * similarity) * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    return {rows[x][0] for x in root}


@pytest.mark.parametrize(("shingle", "similarity"), [(5, 0.8), (3, 0.6)])
@pytest.mark.parametrize("large", [256, 2])
def test_copies_with_changed_words_go(spark, monkeypatch, shingle, similarity, large):
    monkeypatch.setattr(jaccard, "LARGE", large)
    rows = changed_copies()
    want = brute_copies(rows, shingle, similarity)
    assert len(want) < len(rows) - 2
    assert {r["doc_id"] for r in simhash.keep_one(frame(spark, rows), shingle, similarity).collect()} == want


# --- benchmark decontamination

BENCH_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(rows, items):
    win = {}
    for i, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOW))
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            win.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = BENCH_WORD.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in win:
                    hit.update(range(k, k + n))
                    found |= win[x] - {None}
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return out


def bench_case():
    r = random.Random(4)
    word = lambda: r.choice(["Ab", "c1", "é", "dd", "e", "zz"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 10, 30, 9, 2, 1, 0, 15])] + [(20, None), (21, "Ab, c1; ")]
    items.append((22, items[0][1]))
    items += [(None, "zz q c1 zz q c1 zz q c1 zz q"), (None, "é! q")]
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(r.randint(0, 12)))]
        for _ in range(r.randint(0, 2)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, 3)
            parts += [" ".join(w[a : a + r.randint(5, 30)]).upper(), r.choice(["q", "é!", ""])]
        rows.append((i, " ".join(parts)))
    return rows + [(None, rows[0][1]), (99, None), (98, ""), rows[1]], items


@pytest.mark.parametrize(("most", "words"), [(1 << 20, 20_000), (60, 20_000), (40, 12)])
def test_benchmark_hits(spark, monkeypatch, most, words):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", words)
    rows, items = bench_case()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, spans string")
    got = decontaminate.find_contamination(frame(spark, rows), bench, most)
    assert ordered((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()) == ordered(brute_hits(rows, items))


def test_what_is_sent_is_small():
    import pickle

    r = random.Random(1)
    text = " ".join(f"w{r.randint(0, 20_000)}" for _ in range(50_000))
    assert len(pickle.dumps(decontaminate.Phrases([(i, text[i * 3000 : i * 3000 + 3000]) for i in range(90)]))) < 5 * len(text)


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contamination(frame(spark, texts()), bench).filter("n_hit > 0").count() == 0


def test_benchmark_query(spark, small):
    read = lambda n, k: [tuple(r) for r in spark.read.parquet(f"{small}/{n}.parquet").select(k, "text").collect()]
    want = [(d, n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), h > 0) for d, n, h, i in brute_hits(read("documents", "doc_id"), read("benchmark", "item_id"))]
    assert ordered(QUERIES["op5_decontaminate"](spark, small).collect()) == ordered(want)


def test_benchmark_words_are_taken_out(spark):
    rows, items = bench_case()
    bench = spark.createDataFrame([x for x in items if x[1] and len(x[1].split()) >= 10], "item_id bigint, text string")
    docs = frame(spark, rows)
    clean = decontaminate.remove_contamination(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    known = {d: n - h for d, n, h, _ in brute_hits(rows, [x for x in items if x[1] and len(x[1].split()) >= 10])}
    for r in clean.collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        if r["doc_id"] is not None:
            assert len(BENCH_WORD.findall((r["text"] or "").translate(LOW))) == known[r["doc_id"]]


# --- secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute_base(t):
    t = t or ""
    f = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    f += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    f += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(f))


def secret_texts():
    r = random.Random(6)
    bits = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "api-key", "=", ":", " ", '"', "'", "abc123", "x", "AKIA", "akia", "ABCDEFGHIJKLMNOP1234", "deadbeef" * 3, "0123456789abcdef", "g", "é", "ſecret", "toKen", "漢", "\n"]
    out = ["".join(r.choices(bits, k=r.randint(0, 40))) for _ in range(400)]
    return out + [None, "", "token" * 2000 + "=abcdefgh", "f" * 50_000]


def test_base_spans(spark):
    rows = list(enumerate(secret_texts()))
    for r in secrets.find_secrets(frame(spark, rows)).collect():
        base = brute_base(rows[r["doc_id"]][1])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [len(re.findall(k, base)) for k in ("assign", "access", "hex")]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_checksums(spark):
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + secrets.base62_crc(body.encode()).decode()
    rows = [(0, f"é {good}!"), (1, "ghp_" + body + "000000"), (2, "card: 4111 1111 1111 1111."), (3, "card: 4111 1111 1111 1112"), (4, "IBAN DE89370400440532013000"), (5, "iban DE89370400440532013001"), (6, "card 0000000000000000")]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame(spark, rows)).collect()}
    assert got == {0: f"forge:2:{2 + len(good)}", 1: "", 2: "card:6:25", 3: "", 4: "iban:5:27", 5: "", 6: ""}


def test_redaction(spark):
    docs = frame(spark, [(1, 'é token = "abcdef0123456789abcdef0123" end'), (2, None), (3, "clean"), (4, "")])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact_secrets(docs).collect()}
    assert got == {1: ('é [ASSIGN]" end', 15), 2: (None, None), 3: ("clean", 5), 4: ("", 0)}


def test_secret_query(spark, small):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = QUERIES["op4_secret_scan"](spark, small).collect()
    assert len(got) == len(text)
    assert all(r["base_sha256"] == hashlib.sha256(brute_base(text[r["doc_id"]]).encode()).hexdigest() for r in got)


@pytest.mark.parametrize("op", [lambda d: byte_dedup.remove_repeated_bytes(d), lambda d: word_dedup.remove_repeated_words(d), lambda d: simhash.near_duplicates(d), lambda d: simhash.keep_one(d), lambda d: secrets.find_secrets(d), lambda d: secrets.redact_secrets(d)])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).count() == 0
