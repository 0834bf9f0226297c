"""Stages of the pipeline on the smallest tables: what each keeps, and the columns it returns."""

import sys
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_line_recall import _distance, _words
from test_topk_near import _components, _shingles
from tokenizers import Tokenizer

import corpus_pipeline
from linkfold.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns(steps):
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns, name
        assert after.join(before, "doc_id", "left_anti").count() == 0
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None


def test_clean_documents_stay_and_toxic_ones_go(spark, steps):
    labels = table(spark, SF, "labels")
    kept = steps[0][2].join(labels, "doc_id")
    assert kept.filter("toxic = 1").count() <= 2
    assert kept.filter("toxic = 0").count() >= 0.95 * labels.join(steps[0][1], "doc_id").filter("toxic = 0").count()
    good = steps[1][2].join(labels, "doc_id").filter("quality = 1").count()
    assert good >= 0.95 * steps[1][1].join(labels, "doc_id").filter("quality = 1").count()


def test_lines_and_lengths(steps):
    _, before, after = steps[2]
    assert after.count() == before.count() and after.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_pieces_cover_what_is_left(steps):
    _, before, pieces = steps[4]
    assert pieces.select("doc_id").distinct().count() == before.count()
    assert pieces.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024


def test_classifier_stages_keep_what_their_model_accepts(spark, steps):
    from linkfold.llm import quality, toxicity

    labels = table(spark, SF, "labels")
    for (_, before, after), module, wanted in ((steps[0], toxicity, 0), (steps[1], quality, 1)):
        scored = {r["doc_id"]: r["predicted"] for r in module.score(before, module.fit(before, labels), keep=["doc_id"]).select("doc_id", "predicted").collect()}
        assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(i for i, p in scored.items() if p == wanted)
        texts = {r["doc_id"]: r["text"] for r in before.collect()}
        assert all(r["text"] == texts[r["doc_id"]] for r in after.collect())


def test_line_stage_against_all_pairs_of_lines(steps):
    """Every line that goes has an earlier one in its group; of those that all pairs would take out, nearly all go."""
    _, before, after = steps[2]
    texts, got = ({r["doc_id"]: r["text"] for r in f.collect()} for f in (before, after))
    places = {}
    for doc in sorted(texts):
        for k, line in enumerate((texts[doc] or "").split("\n")):
            if _words(line):
                places.setdefault(tuple(_words(line)), []).append((doc, k))
    kinds = list(places)
    bags, links = [Counter(w) for w in kinds], []
    for i, a in enumerate(kinds):
        for j in range(i):
            longer = max(len(a), len(kinds[j]))
            if min(len(a), len(kinds[j])) >= 0.85 * longer - 1e-9 and (bags[i] & bags[j]).total() >= 0.85 * longer - 1e-9:
                if _distance(a, kinds[j]) <= 0.15 * longer + 1e-9:
                    links.append((j, i))
    group = _components(range(len(kinds)), links)
    first = {}
    for n, k in enumerate(kinds):
        first[group[n]] = min([first.get(group[n], (1 << 60, 0)), *places[k]])
    gone = lost = 0
    for doc, text in texts.items():
        mine = [(k, x) for k, x in enumerate((text or "").split("\n"))]
        out = {k for n, w in enumerate(kinds) for d, k in places[w] if d == doc and (d, k) != first[group[n]]} if text else set()
        right = [x for k, x in mine if k not in out and x]
        left = [x for x in (got[doc] or "").split("\n") if x]
        assert not Counter(right) - Counter(left) and not Counter(left) - Counter(x for _, x in mine)
        gone, lost = gone + len(out), lost + len(left) - len(right)
    assert gone > 20 and lost <= 0.03 * gone


def test_near_stage_against_all_pairs_of_documents(steps):
    _, before, after = steps[3]
    sets = {r["doc_id"]: _shingles(r["text"]) for r in before.collect()}
    ids = sorted(sets)
    links = [(a, b) for k, b in enumerate(ids) for a in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    group = _components(ids, links)
    assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == [i for i in ids if group[i] == i or not sets[i]]


def test_packing_stage_against_the_library(steps):
    _, before, pieces = steps[4]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = Counter()
    for r in pieces.collect():
        sizes[r["doc_id"]] += r["length"]
    assert sizes == {r["doc_id"]: len(own.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before.collect()}


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[4][2].count()
