"""The pipeline, stage by stage, against what each operator finds on the stage's own input."""

import pytest

import corpus_pipeline as cp
from quaystone.llm import decontaminate, quality, secrets, sentencepiece
from quaystone.llm.textblocks import table, written

from .data import frame, texts

METHODS = ["quality", "near_copies", "benchmark_passages", "secrets", "pieces"]


def first_of_groups(docs):
    """The smallest doc_id of each group of texts whose sets of five words are similar by 0.8, pair by pair."""
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    sets = [set() if not w else {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in ((t or "").encode().lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    return sorted(rows[x][0] for x in set(root))


def test_stages(spark, small):
    assert [n for n, _ in cp.STAGES] == METHODS
    docs = table(spark, small, "documents")
    columns, frames = docs.columns, {}
    for name, stage in cp.STAGES:
        frames[name] = docs, (docs := written(stage(spark, docs, small)))
        if name != "pieces":
            assert docs.columns == columns
    before, after = frames["quality"]
    scores = quality.score_quality(before, *quality.fit_quality(before, table(spark, small, "labels")))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scores.filter(f"score >= {quality.THRESHOLD}").collect()}
    before, after = frames["near_copies"]
    assert sorted(r["doc_id"] for r in after.collect()) == first_of_groups(before)
    before, after = frames["benchmark_passages"]
    assert before.count() == after.count()
    found = decontaminate.find_contamination(after, table(spark, small, "benchmark"))
    assert found.filter("n_hit > 0").count() == 0
    hit = {r["doc_id"] for r in decontaminate.find_contamination(before, table(spark, small, "benchmark")).filter("n_hit > 0").collect()}
    same = before.join(after, ["doc_id", "text"]).count()
    assert same == before.count() - len(hit)
    before, after = frames["secrets"]
    assert before.count() == after.count() and secrets.find_secrets(after).filter("n_assign + n_access + n_hex > 0").count() == 0
    before, after = frames["pieces"]
    assert sentencepiece.decode(after).filter("decoded != text").count() == 0 and after.count() == before.count()
    whole = cp.run(spark, small)
    assert whole.columns == after.columns and whole.select("doc_id", "text", "piece_ids").exceptAll(after.select("doc_id", "text", "piece_ids")).count() == 0


def test_near_copies_of_five_words(spark, small):
    docs = table(spark, small, "documents")
    assert sorted(r["doc_id"] for r in cp.near_copies(spark, docs, small).collect()) == first_of_groups(docs)


@pytest.mark.parametrize("rows", [[], texts(9, 20)])
def test_stages_on_odd_documents(spark, small, rows):
    docs = frame(spark, rows)
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, small))
    assert "piece_ids" in docs.columns and docs.count() <= len(rows)


def test_near_copies_come_from_fingerprints_first(spark, monkeypatch):
    from quaystone.llm import simhash

    words = [f"w{i * 7919 % 1009}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), " ".join(words).upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = []
    real = simhash.set_roots

    def watched(docs, prints, shingle, similarity, suggested):
        seen.extend((r["u"], r["v"]) for r in suggested.collect())
        return real(docs, prints, shingle, similarity, suggested)

    monkeypatch.setattr(simhash, "set_roots", watched)
    assert [r["doc_id"] for r in simhash.keep_one(docs).orderBy("doc_id").collect()] == [0, 2]
    assert len(seen) == 1 and seen[0][0] < seen[0][1]  # the longer text; the one in capitals has the same set
