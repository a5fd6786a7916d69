"""The pipeline's stages, each against brute force on its own input."""

import pandas as pd
import pytest

import corpus_pipeline

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    found.append(docs.toPandas())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SF), name)
        found.append(docs.toPandas())
    return [x.set_index("doc_id").sort_index() for x in found]


def pairs(frame):
    return [(int(i), t) for i, t in frame["text"].items()]


def test_quality_rules(steps):
    before, after = steps[:2]
    failed = {i for i, t in pairs(before) if brute.rules(t)[-1]}
    assert failed and not failed & set(after.index)
    assert after.equals(before.loc[after.index])
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    kept = pd.Series(labels.index.isin(after.index), labels.index)
    assert kept[labels["quality"] == 1].mean() > 0.95 and kept[labels["quality"] == 0].mean() < 0.2


def test_line_dedup(steps):
    before, after = steps[1:3]
    assert [(i, kept) for i, _, _, kept in brute.lines(pairs(before))] == pairs(after)
    assert (after["n_chars"] == after["text"].str.len()).all() and not after["text"].equals(before["text"])


def test_one_document_of_each_group_stays(steps):
    before, after = steps[2:4]
    want = [i for i, _, c in brute.components(pairs(before)) if c == i]
    assert list(after.index) == sorted(want) and len(want) < len(before)
    assert after.equals(before.loc[after.index])


def test_decontamination(steps):
    before, after = steps[3:5]
    b = pd.read_parquet(f"{SF}/benchmark.parquet")
    items = list(zip(b["item_id"], b["text"], strict=True))
    bad = {i for i, t in pairs(before) if brute.contamination(t, items)[3]}
    assert bad and set(after.index) == set(before.index) - bad


def test_tokens(steps):
    before, after = steps[4:]
    assert list(after.index) == list(before.index)
    assert after["decoded_sha256"].to_dict() == {i: brute.sha(t) for i, t in pairs(before)}
    assert (after["token_ids"].map(len) == 4 * after["n_tokens"]).all()


def test_edges(spark):
    rows = [(1, None, None, None, None), (None, "x " * 20, "en", "s", 40), (2, "", "en", "s", 0), (3, "all of these words are different from each other in this text", "en", "s", 5), (3, "all of these words are different from each other in this text", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[1:]:
            now = corpus_pipeline.saved(stage(spark, now, SF), name)
        assert sorted((r["doc_id"] for r in now.collect()), key=repr) == ([1, 2, 3, None] if start is docs else [])
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).count() == 2


def test_texts_that_share_an_id(spark):
    text = lambda head, last: " ".join([*(f"{head}{i}" for i in range(40)), last])
    rows = [
        (1, text("a", "x")), (1, text("a", "y")), (1, text("b", "x")),  # near copies, and another text
        (2, text("a", "z")), (2, text("c", "x")),  # a copy of 1's, and a text that leads its own
        (3, text("d", "x")), (3, text("D", "x")), (4, text("d", "y")),  # equal sets
        (5, text("e", "x")), (6, None), (6, None), (6, "..  "), (7, text("b", "y")),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    heads = sorted((r["doc_id"], r["text"][0].lower()) for r in got if r["text"] and r["doc_id"] != 6)
    assert heads == [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (5, "e")]
    assert sum(r["doc_id"] == 6 for r in got) == 2


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == list(steps[-1].index)
