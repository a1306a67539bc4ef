"""Small document tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, text_hash string, row int, bucket int, sid string, anchor string, wanted int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t), None, "x", "y", 1, 2, "z", "w", 3) for d, t in rows], SCHEMA)


def texts(seed=1, n=60, words="abcdefgh", share=True):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcé") for _ in range(60)) for _ in range(3)]
    rows = []
    for _ in range(n):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 15)))
        for _ in range(r.randint(0, 3) if share else 0):
            x, a = r.choice(base).split(), r.randint(0, 40)
            t += " " + " ".join(x[a : a + r.randint(3, 30)])
        if r.random() < 0.2:
            t += " a" * 30
        rows.append((None if r.random() < 0.05 else r.randint(0, 40), None if r.random() < 0.05 else "" if r.random() < 0.05 else t + r.choice(["", "  \n", "\t"])))
    rows.append((77, "long " * 30_000))
    return rows + rows[:4]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
