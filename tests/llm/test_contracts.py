"""Registered queries against brute force, over whole tables."""

import struct

import pandas as pd
import pytest

from rillstone.llm import queries

from . import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return [(int(i), t) for i, t in zip(d["doc_id"], d["text"], strict=True)]


def got(spark, name, *cols):
    return {tuple(r) for r in queries.QUERIES[name](spark, SF).select(*cols).collect()}


def test_op2(spark, docs):
    import zlib

    rows = queries.QUERIES["op2_hilbert_shards"](spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs}
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append((r["slot"], r["hilbert"]))
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(shards) == list(range(8))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    for own in shards.values():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
    along = [h for k in sorted(shards) for _, h in sorted(shards[k])]
    assert along == sorted(along)


def test_op3(spark, docs):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    enc = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t in docs:
        ids = enc.encode_ordinary(t)
        want.add((i, len(ids), brute.sha(struct.pack(f"<{len(ids)}I", *ids)), brute.sha(t)))
    assert got(spark, "op3_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op4(spark):
    import zlib

    rows = queries.QUERIES["op4_lang_id"](spark, SF).toPandas().set_index("doc_id")
    truth = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    assert len(rows) == len(truth)
    for i, held in rows["held_out"].items():
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert rows["score"].between(0, 1).all()
    out = rows[rows["held_out"]]
    right = out["lang_pred"] == truth.loc[out.index, "lang"]
    assert right[truth.loc[out.index, "n_chars"] >= 100].mean() > 0.97
    print("held out, all lengths", right.mean(), "under 100 characters", right[truth.loc[out.index, "n_chars"] < 100].mean(), (truth.loc[out.index, "n_chars"] < 100).sum())
    assert right.mean() > 0.95


def test_op5(spark, docs):
    want = {(i, n, gone, brute.sha(kept)) for i, n, gone, kept in brute.lines(docs)}
    assert got(spark, "op5_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == want


def test_op7(spark, docs):
    assert got(spark, "op7_jaccard_join", "doc_id", "n_shingles", "component_id") == set(brute.components(docs))


def test_op8(spark, docs):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(spark, "op8_quality_forest", "doc_id", *cols) == {(i, *brute.rules(t)) for i, t in docs}
    rows = queries.QUERIES["op8_quality_forest"](spark, SF).toPandas().set_index("doc_id")
    assert not (rows["kept"] & rows["base_failed"]).any()
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    kept = rows.loc[labels.index, "kept"]
    assert kept[labels["quality"] == 1].mean() > 0.97
    assert kept[labels["quality"] == 0].mean() < 0.3


def test_op9(spark):
    p = pd.read_parquet(f"{SF}/pages.parquet")
    want = set(brute.warc([(int(i), h) for i, h in zip(p["page_id"], p["html"], strict=True)]))
    assert got(spark, "op9_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want


def test_op10(spark, docs):
    b = pd.read_parquet(f"{SF}/benchmark.parquet")
    items = [(int(i), t) for i, t in zip(b["item_id"], b["text"], strict=True)]
    want = set()
    for i, t in docs:
        n, hit, found, bad = brute.contamination(t, items)
        want.add((i, n, hit, len(found), brute.sha(",".join(found)), bad))
    assert any(x[5] for x in want)
    assert got(spark, "op10_fm_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_op1(spark):
    rows = queries.QUERIES["op1_importance"](spark, SF).toPandas().set_index("doc_id")
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    good = (labels["quality"] == 1) & (labels["toxic"] == 0)
    assert rows["kept"].sum() == round(len(rows) * good.mean())
    cut = rows.loc[rows["kept"], "gumbel_key"].min()
    assert (rows.loc[~rows["kept"], "gumbel_key"] <= cut).all()
    kept = rows.loc[labels.index, "kept"]
    assert kept[good].mean() > kept[~good].mean() + 0.3


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = c.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    mine = queries.QUERIES[name](spark, SF)
    assert set(columns) == set(mine.columns)
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(want.fetchall()) if name != "op9_warc" else {tuple(r) for r in mine.select(*columns).collect()} == set(want.fetchall())
