"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import gzip
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.llm import byte_bpe, chat_format, common, decontaminate, hilbert_shards, importance, jaccard_join, lang_id, line_dedup, quality_forest, warc, words

from . import brute

random.seed(5)
LONG = " ".join(random.choice(["alpha", "beta", "Gamma", "ärger", "x9"]) + str(random.randrange(500)) for _ in range(40_000))
SHARED = "this line is shared by many documents, word for word"
TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "two words",
    "three little words here now",
    "Three  LITTLE words\there now",
    "ÄÖÜ ß 中文字符 \U0001f600 mixed",
    LONG,
    LONG + " tail",
    LONG[: len(LONG) // 2],
    *[f"{SHARED}\n own {i}\n  {SHARED.upper()} \nend" for i in range(7)],
]
ROWS = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(9, LONG, "en"), (4, "one", None), (None, SHARED, "en"), (None, None, None)]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    common.ready(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_words_match_regex():
    texts = [(t or "").encode() for _, t, _ in ROWS]
    w = words.words(texts, words.SPACED, fold=False)
    for i, t in enumerate(texts):
        own = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
        assert own == brute.WORD.findall(t.decode())
    names = {}
    for h, a, b in zip(w.hashes, w.starts, w.ends, strict=True):
        assert names.setdefault(w.data[a:b].tobytes(), h) == h
    assert len(set(names.values())) == len(names)


def test_long_words():
    a = words.words([b"x" * 100 + b" yy", b"yy " + b"X" * 100, b"x" * 64, b"x" * 65, b"x" * 8, b"x" * 9, b"x" * 16], words.SPACED, fold=True)
    assert a.hashes[0] == a.hashes[3] and a.hashes[1] == a.hashes[2] != a.hashes[0]
    assert len(set(a.hashes.tolist())) == 7


def thue_morse(letters):
    """Two different words that polynomial hashes modulo a power of two can't tell apart."""
    t, u = "a", "b"
    while len(t) < letters:
        t, u = t + u, u + t
    return t, u


@pytest.mark.parametrize("letters", [32, 64, 1024, 4096])
def test_regular_words_stay_apart(spark, letters):
    t, u = thue_morse(letters)
    docs = spark.createDataFrame([(1, t), (2, u), (3, " ".join([t] * 10 + [u] * 2)), (4, " ".join("ab"[int(c)] + x for c, x in zip("0110100110010110", [t, u] * 8, strict=True)))], "doc_id long, text string")
    want = sorted(brute.components([tuple(r) for r in docs.collect()]))
    assert rows_of(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == want and want[0][2] != want[1][2]
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(7, u)], "item_id long, text string"))
    assert rows_of(found, "doc_id", "n_hit") == [(1, 0), (2, 1), (3, 2), (4, 0)]
    turns = spark.createDataFrame([(1, " ".join([t, u] * 3 + [t, t, u, u, t, u])), (2, " ".join([t] * 12))], "doc_id long, text string")
    want = [(r["doc_id"], brute.rules(r["text"])[4]) for r in turns.collect()]
    assert rows_of(quality_forest.judge(turns, None, 1.0), "doc_id", "n_repeat_words") == want
    assert len(set(importance.cells([t.encode(), u.encode()])[0].tolist())) == 2


def test_parts_of_a_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"i": list(range(6)), "t": pa.array([b"", None, b"x" * 9, b"y" * 3, b"z", b"w" * 2], pa.binary())})
    for limit in (1, 3, 4, 100):
        parts = list(words.parts_of(batch, limit))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(6))
        assert all(len(p) == 1 or sum(len(t or b"") for t in p.column(1).to_pylist()) <= limit for p in parts)


def test_lines(docs, none):
    want = sorted(((i, n, gone, kept) for i, n, gone, kept in brute.lines([(i, t) for i, t, _ in ROWS])), key=repr)
    assert rows_of(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_text") == want
    assert rows_of(line_dedup.dedup_lines(docs, max_broadcast=0), "doc_id", "n_lines", "n_dropped", "kept_text") == want
    assert line_dedup.dedup_lines(none).count() == 0
    clash = line_dedup.dedup_lines(docs.withColumn("_row", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("_id", F.lit(2)))
    assert rows_of(clash, "doc_id", "n_lines", "n_dropped", "kept_text") == want and clash.filter("_row <> 1 or _id <> 2").count() == 0


def test_rules(spark, docs, none):
    want = sorted(((i, *brute.rules(t)) for i, t, _ in ROWS), key=repr)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    judged = quality_forest.judge(docs.withColumn("kept", F.lit("x")).withColumn("_text", F.lit("y")), None, float("inf"))
    assert rows_of(judged, *cols) == want
    assert judged.filter(F.col("kept") == F.col("base_failed")).count() == 0 and judged.filter("_text <> 'y'").count() == 0
    assert quality_forest.judge(none, None, 1.0).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_forest.fit(docs, empty) == (None, float("inf"))
    some = spark.createDataFrame([(9, 1, 0), (9, 0, 0), (10, 0, 1), (None, 1, 0), (3, None, None)], empty.schema)
    assert quality_forest.fit(docs, some)[0] is not None


def test_components(docs, none):
    want = sorted(brute.components([(i, t) for i, t, _ in ROWS]), key=repr)
    got = jaccard_join.jaccard_components(docs.withColumn("component_id", F.lit("x")), bucket_rows=50, pivots=2, task_shingles=2000)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert rows_of(jaccard_join.jaccard_components(docs, max_broadcast=0), "doc_id", "n_shingles", "component_id") == want
    assert jaccard_join.jaccard_components(none).count() == 0


def test_chains_and_borders(spark):
    """Chains of links, sizes just at and below the border, a common passage, and a large group of copies."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, base = [], fresh(104)
    for _ in range(12):  # a chain: neighbours link, ends don't
        texts.append(base)
        base = base[6:] + fresh(6)
    for cut in range(0, 40, 3):
        texts.append(texts[0][: 104 - cut] + fresh(cut))
    passage = fresh(60)
    texts += [fresh(20) + passage + fresh(20) for _ in range(60)] + [fresh(3) + passage for _ in range(40)]
    texts += [texts[20]] * 50
    rows = [(int(i * 7919 % 10007), " ".join(t)) for i, t in enumerate(texts)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=500, pivots=3, task_shingles=1000)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(rows), key=repr)


def families(seed):
    """Rows of families of texts: near copies of several degrees, and texts about equally far from each other."""
    rng = random.Random(seed)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for core, own in ((60, 2), (60, 14), (90, 30), (40, 10), (50, 16)):
        middle = fresh(core)
        texts += [middle + fresh(rng.randrange(own // 2, own + 1)) for _ in range(40)]
    base = fresh(80)
    for _ in range(120):  # copies of copies, a few words changed each time
        at = rng.randrange(len(base) - 4)
        base = base[:at] + fresh(rng.randrange(1, 5)) + base[at + rng.randrange(1, 5) :]
        texts.append(base)
    rng.shuffle(texts)
    return [(i * 31 % 1009, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("task_shingles,pivots,shrunk,copies", [(1500, 2, 0.25, 2), (900, 6, 0.95, 50)])
def test_regions_lose_no_link(spark, monkeypatch, task_shingles, pivots, shrunk, copies):
    """With regions that mostly stay together and are joined in blocks, and with ones that mostly are split again."""
    monkeypatch.setattr(jaccard_join, "BLOCKS", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 20)
    monkeypatch.setattr(jaccard_join, "SHRUNK", shrunk)
    monkeypatch.setattr(jaccard_join, "COPIES", copies)
    rows = families(task_shingles)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), pivots=pivots, task_shingles=task_shingles)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute.components(rows), key=repr)


def test_tables_that_nothing_reads_are_removed(spark, docs):
    from rillstone.sources import scratch

    there = lambda: set(scratch.names(spark, scratch.folder(spark)))
    before = there()
    got = jaccard_join.jaccard_components(docs)
    assert got.count() == len(ROWS)
    assert {x.rsplit("-", 1)[0] for x in there() - before} == {"sketches", "classes", "found"}


def test_windows_spare_overlaps(monkeypatch):
    """The same components with and without windows, and fewer overlaps counted with them."""
    import numpy as np

    rng, base, texts = random.Random(3), [f"v{i}" for i in range(120)], []
    for i in range(200):  # copies of copies
        base = base[: i % 110] + [f"u{i}", f"x{rng.randrange(9)}"] + base[i % 110 + 2 :]
        texts.append(" ".join(base).encode())
    sets = list(jaccard_join.shingle_sets(texts))
    size, values, n = np.array([len(s) for s in sets]), np.concatenate(sets), len(sets)
    monkeypatch.setattr(jaccard_join, "MATCHES", 5000)

    def parts(links):
        label = list(range(n))
        for a, b in links:
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
        return label

    for whole in (True, False):
        one = np.zeros(n, np.int64), size, values, np.ones(n, bool), np.full(n, whole)
        (some, counted), (all_, most) = jaccard_join.joined(*one), jaccard_join.joined(*one, radius=1.0)
        assert parts(some) == parts(all_) and len(some) == len(all_) and counted < 0.7 * most


def test_contamination(spark, docs, none):
    item = "three little words here now and some more to make the window long enough for thirteen"
    items = [(1, "THREE little"), (10, "x9"), (2, None), (3, "..."), (None, "one"), (4, item), (4, item), (5, "中文字符"), (6, "two words one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(100, "so: " + item + "; " + item, "en"), (101, item[:40], "en"), (102, "three little three little three", "en")], SCHEMA)
    rows = docs.unionByName(more)
    want = sorted(((r["doc_id"], *brute.contamination(r["text"], items)) for r in rows.collect()), key=repr)
    for block_words in (10**6, 20):
        found = decontaminate.decontaminate(rows.withColumn("spans", F.lit(1)), bench, block_words=block_words)
        got = rows_of(found.select("doc_id", "n_words", "n_hit", "items", "contaminated"), "*")
        assert [(a, b, c, list(d), e) for a, b, c, d, e in got] == want
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    left = decontaminate.decontaminate(more, bench).select("doc_id", decontaminate.cleaned(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in left}[100] == "so: "  # the spans of neighbouring words are one


NAMES = ["_t", "_at", "_part", "_rank", "_sha1", "s", "i", "a.b", "_row", "_text", "_id", "_tag", "_c", "_key", "_gone", "_v", "_salt", "_lines", "hilbert"]


def cleaners(spark):
    """Each operator on tables with columns (doc_id, text, lang), as a function that keeps all others."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    bench = spark.createDataFrame([(1, "THREE little"), (2, "two words one x9 more words than fit")], "item_id long, text string")
    ids = spark.createDataFrame([(9,)], "doc_id long")
    dims = lambda: {"lang_cell": hilbert_shards.category(F.col("lang"))}
    return {
        "importance": lambda d: importance.resample(importance.score(d, importance.fit(d, ids)), 5),
        "hilbert": lambda d: hilbert_shards.shard_by_hilbert(d, dims(), [F.col("doc_id"), F.col("text")], 3),
        "bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, path, pattern), path, pattern),
        "lang": lambda d: lang_id.predict(d, lang_id.fit(d)),
        "lines": lambda d: line_dedup.dedup_lines(d, max_broadcast=0),
        "jaccard": lambda d: jaccard_join.jaccard_components(d),
        "forest": lambda d: quality_forest.judge(d, None, 1.0),
        "warc": lambda d: warc.with_record_types(d, id_col="doc_id", html_col="text", max_broadcast=0),
        "contamination": lambda d: decontaminate.decontaminate(d, bench),
        "contamination in blocks": lambda d: decontaminate.decontaminate(d, bench, block_words=3),
    }


@pytest.mark.parametrize("name", ["importance", "hilbert", "bpe", "lang", "lines", "jaccard", "forest", "warc", "contamination", "contamination in blocks"])
def test_columns_of_any_name_stay(spark, docs, name):
    run = cleaners(spark)[name]
    keep = [c for c in NAMES if name != "hilbert" or c != "hilbert"]
    wide = docs.withColumns({c: F.concat(F.lit(c + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in keep})
    plain, rich = run(docs), run(wide)
    new = [c for c in plain.columns if c not in docs.columns]
    assert set(rich.columns) == set(plain.columns) | set(keep)
    assert rich.filter(" or ".join(f"`{c}` is null or `{c}` <> concat('{c} of ', coalesce(string(doc_id), 'none'))" for c in keep)).count() == 0
    assert rich.count() == len(ROWS)
    if name not in ("hilbert", "warc"):  # these tell equal rows apart by where they are
        assert rows_of(rich, "doc_id", *new) == rows_of(plain, "doc_id", *new)


def test_bytes_that_are_no_utf8(spark):
    broken = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('616263FF20C328') || encode(repeat(' some words more', 9), 'utf-8') as string)").alias("text"), F.lit("en").alias("lang"))
    for name, run in cleaners(spark).items():
        assert run(broken).count() == 3, name
    assert bytes(cleaners(spark)["bpe"](broken).first()["decoded"]).startswith("abc\ufffd \ufffd(".encode())


def test_spans_of_several_blocks(spark):
    """Two items whose windows overlap in the text, each in a block of its own, leave one span."""
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "c d"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c d e"), (2, "d e f"), (3, "a"), (None, "h"), (4, "zz")], "item_id long, text string")
    for words_ in (1, 4, 1000):
        got = decontaminate.decontaminate(docs, bench, block_words=words_).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(8, 7, ["1", "2", "3"]), (2, 0, []), (0, 0, [])]
        assert [tuple(x) for x in got[0]["spans"]] == [(0, 11, 0, 6), (14, 15, 7, 8)]


def test_suffixes_and_search():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (40, 1), (300, 2), (500, 6)):
        string = np.concatenate([[0], rng.integers(0, top + 1, n), [0]])
        index = decontaminate.FMIndex(string, top, sample=3)
        text = "".join(chr(97 + c) if c else "." for c in string)
        parts = sorted({text[i : i + k] for i in range(len(text)) for k in (1, 2, 5) if "." not in text[i : i + k] and len(text[i : i + k]) == k} | {"b" * 5})
        symbols = np.zeros((len(parts), 5), np.int64)
        for r, p in enumerate(parts):
            symbols[r, 5 - len(p) :] = [ord(c) - 97 for c in p]
        found, lo, hi = index.search(symbols, np.array([len(p) for p in parts]))
        at = np.split(index.locate(lo, hi), np.cumsum(hi - lo)[:-1])
        places = {parts[f]: sorted(a) for f, a in zip(found, at, strict=False)}  # nothing found splits into one empty part
        for p in parts:
            assert places.get(p, []) == [i for i in range(len(text)) if text.startswith(p, i)]


def test_bpe(docs, none):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = byte_bpe.decode(byte_bpe.encode(docs.withColumn("n_tokens", F.lit("x")), path, pattern, chunk_chars=50), path, pattern)
    enc = byte_bpe.encoding(path, pattern)
    for r in rows.collect():
        assert r["n_tokens"] == len(enc.encode_ordinary(r["text"] or "")) == len(r["token_ids"]) // 4
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    both = byte_bpe.encode(docs, path, pattern, with_decoded=True)
    assert rows_of(both, "doc_id", "n_tokens", "token_ids", "decoded") == rows_of(rows, "doc_id", "n_tokens", "token_ids", "decoded")
    assert byte_bpe.encode(none, path, pattern).count() == 0


@pytest.mark.parametrize("text", ["it's we'll I'M 'tis don't", "a1b2 c3\n\n\t d  e", "日本語テキスト、漢字。かな 漢字", "x" * 300, " " * 300 + "y", "é́ à​ b!!! ..<|endoftext|>"])
def test_chunks_tokenise_alike(text):
    import public_tokenizers

    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for limit in (1, 2, 3, 7, 20):
        parts = list(byte_bpe.chunks(text * 3, limit))
        assert "".join(parts) == text * 3
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text * 3)


@pytest.mark.parametrize("text", [" " * 10_000, "a" + " " * 12_000 + "b  c", "x\n" + "\n" * 20_000, "\t" * 10_001 + "1" + " " * 9_999 + "."])
def test_long_blanks(text):
    import public_tokenizers

    enc = byte_bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert byte_bpe.token_ids(enc, text).tolist() == enc.encode_ordinary(text)
    longer = text.replace(" " * 9_999, " " * 400_000)
    assert enc.decode_bytes(byte_bpe.token_ids(enc, longer).tolist()) == longer.encode()


def test_languages(spark, docs, none):
    model = lang_id.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_id.predict(docs.withColumn("score", F.lit("x")), model).collect()}
    assert got[0] == got[1] == got[2] == (lang_id.UNKNOWN, 0.0) and got[9][0] == "en"
    assert {x for x, _ in got.values()} == {"en", lang_id.UNKNOWN}
    nothing = lang_id.fit(none)
    assert lang_id.predict(docs, nothing).filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert lang_id.predict(none, model).count() == 0
    whole = lang_id.ngram_counts(LONG.encode())
    lang_id._PIECE, old = 1000, lang_id._PIECE
    try:
        for a, b in zip(whole, lang_id.ngram_counts(LONG.encode()), strict=True):
            assert (a == b).all()
    finally:
        lang_id._PIECE = old


def test_importance(spark, docs, none):
    ids = spark.createDataFrame([(9,), (9,), (None,), (12,)], "doc_id long")
    ratios = importance.fit(docs, ids)
    weighed = importance.score(docs.withColumn("kept", F.lit(1)), ratios)
    assert weighed.filter("text is null and log_weight <> 0").count() == 0
    for k in (0, 5, 10**6):
        kept = importance.resample(weighed, k)
        assert kept.count() == len(ROWS) and kept.filter("kept").count() == min(k, len(ROWS))
    assert importance.resample(importance.score(none, ratios), 3).count() == 0
    assert not importance.fit(none, ids).any()


def test_importance_weights_are_the_models_ratio(spark):
    """Against plain Python that counts words and pairs by themselves."""
    import math
    from collections import Counter

    rng = random.Random(11)
    texts = [" ".join(rng.choice(["good", "fine", "Bad", "so", "is", "it"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    target = {i for i, t in enumerate(texts) if t.count("good") > t.count("Bad")}

    def grams(t):
        w = [x.lower() for x in t.split()]
        return w + list(zip(w, w[1:], strict=False))

    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i in target:
            good.update(grams(t))
    total, share = sum(raw.values()) + importance.BUCKETS, sum(good.values())

    def weight(g):
        expected = (raw[g] + 1) / total * share
        z2 = (good[g] - expected) ** 2 / (expected + 1)
        return math.log((good[g] + 1) / (expected + 1)) * z2 / (z2 + 100)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ratios = importance.fit(docs, spark.createDataFrame([(i,) for i in target], "doc_id long"))
    for r in importance.score(docs, ratios).collect():
        assert r["log_weight"] == pytest.approx(sum(map(weight, grams(r["text"]))), abs=1e-9)
    assert (ratios != 0).sum() >= len(raw)


def test_importance_samples_in_proportion(spark):
    """Of many rows few are drawn, those of twice the weight about twice as often; the noise is Gumbel's."""
    import math

    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, math.log(2.0)).otherwise(0.0).alias("log_weight"))
    got = importance.resample(rows, 2000)
    assert got.filter("kept").count() == 2000
    twice = got.filter("kept and doc_id % 2 = 0").count() / 2000
    assert abs(twice - 2 / 3) < 0.04
    mean, spread = got.agg(F.avg(F.col("gumbel_key") - F.col("log_weight")), F.var_pop(F.col("gumbel_key") - F.col("log_weight"))).first()
    assert abs(mean - 0.5772) < 0.03 and abs(spread - math.pi**2 / 6) < 0.06


def test_forest_scores_are_mean_path_lengths():
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), [[9, 9, 9]]])
    forest = quality_forest.Forest(x[:-1], x.min(axis=0), x.max(axis=0), trees=10, tree_rows=64)

    def mean_depth(n):
        return 0 if n < 2 else 1 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def path(tree, row):
        feature, threshold, left, value = tree
        at, steps = 0, 0
        while feature[at] >= 0:
            at = left[at] + (row[feature[at]] > threshold[at])
            steps += 1
        assert value[at] >= steps  # what a leaf holds counts as the mean depth of a tree over its rows
        return value[at]

    want = [2 ** (-np.mean([path(t, row) for t in forest.trees]) / mean_depth(64)) for row in x]
    assert np.allclose(forest.score(x), want) and forest.score(x).argmax() == len(x) - 1


def test_regression_by_hand():
    """The learner's weights against a plain-Python follow-the-regularised-leader."""
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        cells = np.sort(rng.choice(30, 6, replace=False))
        x = rng.random(6)
        rows.append(((cells, x / np.sqrt((x * x).sum())), int(cells[0] % 3)))
    model = lang_id.Model(["a", "b", "c"], np.ones(lang_id.BUCKETS))
    lang_id.learn(model, rows, seed=1)
    order = np.random.default_rng(1)
    aside = order.permutation(len(rows))
    seen, z, n = aside[8:], {}, {}

    def weight(i, k):
        own = z.get((i, k), 0.0)
        return 0.0 if abs(own) <= lang_id.L1 else -(own - math.copysign(lang_id.L1, own)) / ((lang_id.BETA + math.sqrt(n.get((i, k), 0.0))) / lang_id.ALPHA + lang_id.L2)

    for _ in range(lang_id.EPOCHS):
        for r in order.permutation(seen):
            (cells, x), lang = rows[r]
            pairs = [*zip(map(int, cells), map(float, x), strict=True), (-1, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in pairs for k in range(3)}
            e = [math.exp(sum(v * w[i, k] for i, v in pairs)) for k in range(3)]
            for i, v in pairs:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == lang))
                    old = n.get((i, k), 0.0)
                    n[i, k] = old + g * g
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(n[i, k]) - math.sqrt(old)) / lang_id.ALPHA * w[i, k]
    for i in range(30):
        assert np.allclose(model.weights[i], [weight(i, k) for k in range(3)], atol=1e-9)
    assert np.allclose(model.bias, [weight(-1, k) for k in range(3)], atol=1e-9) and 0.05 <= model.temperature <= 20


def test_shards_as_files(spark, docs, tmp_path):
    """A reader of one cell opens the files of its shards alone and finds all of its rows."""
    many = spark.range(4000).select((F.col("id") % 1000).alias("doc_id"), (F.col("id") % 23).cast("string").alias("lang"), F.repeat(F.lit("x"), (F.col("id") % 400).cast("int")).alias("text"))
    dims = {"lang_cell": hilbert_shards.category(F.col("lang")), "size_cell": hilbert_shards.magnitude(F.length("text"))}
    sharded = hilbert_shards.shard_by_hilbert(many, dims, [F.col("doc_id"), F.col("text")], 64)
    hilbert_shards.write_shards(sharded, list(dims), str(tmp_path / "shards"))
    every = spark.read.parquet(str(tmp_path / "shards" / "data"))
    wanted = {"lang_cell": every.first()["lang_cell"], "size_cell": every.first()["size_cell"]}
    got = hilbert_shards.read_cells(spark, str(tmp_path / "shards"), wanted)
    same = " and ".join(f"{c} = {v}" for c, v in wanted.items())
    assert got.count() == every.filter(same).count() > 0
    assert len(got.inputFiles()) < len(every.inputFiles()) / 3
    assert hilbert_shards.read_cells(spark, str(tmp_path / "shards"), {"lang_cell": 99}).count() == 0


def test_shards(spark, docs, none):
    dims = {"a": hilbert_shards.category(F.col("lang")), "b": hilbert_shards.magnitude(F.octet_length("text")), "c": F.lit(3)}
    for n in (1, 3, 8, 100):
        got = hilbert_shards.shard_by_hilbert(docs.withColumn("shard", F.lit("x")), dims, [F.col("doc_id"), F.col("text")], n)
        sizes = {}
        for r in got.collect():
            sizes.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in sizes.values()) and sum(map(len, sizes.values())) == len(ROWS)
        counts = [len(sizes.get(k, ())) for k in range(n)]
        assert max(counts) - min(counts) <= 1 and set(sizes) <= set(range(n))
    assert hilbert_shards.shard_by_hilbert(none, dims, [F.col("doc_id")]).count() == 0
    boxes = hilbert_shards.manifest(got, ["a", "b"])
    wanted = {r["shard"] for r in got.filter("b = 0").collect()}
    assert wanted <= {r["shard"] for r in hilbert_shards.prune(boxes, {"b": 0}).collect()}


def test_hilbert_is_a_curve(spark):
    for bits, dims in ((1, 2), (3, 2), (2, 3), (5, 3)):
        cells = spark.range((1 << bits) ** dims)
        axes = [F.expr(f"cast((id div {(1 << bits) ** i}) % {1 << bits} as int)") for i in range(dims)]
        rows = cells.select(hilbert_shards.hilbert_index(axes, bits).alias("h"), *[a.alias(f"x{i}") for i, a in enumerate(axes)]).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range((1 << bits) ** dims))
        for a, b in zip(rows, rows[1:], strict=False):
            assert sum(abs(a[f"x{i}"] - b[f"x{i}"]) for i in range(dims)) == 1


def test_chats(spark):
    esc = chat_format.ESC
    told = [(1, 1, "user", "a"), (1, 0, "sys\ntem", None), (1, 2, "user", "<|im_sep|>b<"), (1, 3, "assistant", "|x<|im_end|>\n"), (1, 4, "assistant", f"{esc}1{esc}0<|{esc}"), (1, 4, "assistant", "tie"), (1, 4, "assistant", "tie"), (None, None, None, None), (2, None, "assistant", ""), (2, 5, "assistant", "\n\n"), (3, 0, "<|im_start|>", "é中\U0001f600")]
    df = spark.createDataFrame(told, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x")).withColumn("_t", F.lit(1))
    got = chat_format.format_chats(df)
    back = got.select("conv_id", "formatted", chat_format.read_chats(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    order = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for r in back:
        own = [(t[2] or "", t[3] or "") for t in sorted((t for t in told if t[0] == r["conv_id"]), key=order)]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["loss"] == "".join(x for role, x in own if role == "assistant")
    assert {r["conv_id"] for r in back} == {1, 2, 3, None}
    assert chat_format.format_chats(df.limit(0)).count() == 0
    n = 2000  # turns enough for many parts of the running position
    long = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    r = chat_format.format_chats(long).select(chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size("loss_spans").alias("n")).first()
    assert r["loss"] == "".join(f"t{i}" for i in range(n) if i % 3) and r["n"] == sum(i % 3 > 0 for i in range(n))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (5, "http://b", "same"), (5, "http://b", "same"), (3, "u", None), (4, "u", ""), (None, "n", "null id"), (7, "l", "\r\n\r\nWARC/1.0\r\n\r\n" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).coalesce(2)
    for limit in (0, 10):
        typed = warc.with_record_types(pages, max_broadcast=limit)
        archives = warc.write_archives(typed, f"{tmp_path}/mono{limit}")
        normal = warc.normalise(archives, f"{tmp_path}/normal{limit}")
        got = warc.read_archives(normal).collect()
        assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(
            [(1, "revisit", 5), (2, "revisit", 5), (5, "response", None), (5, "revisit", 5), (3, "revisit", 4), (4, "response", None), (None, "response", None), (7, "response", None)], key=repr
        )
        full = {r["page_id"]: r for r in got if r["record_type"] == "response"}
        assert bytes(full[7]["payload"]).decode() == rows[-1][2] and full[5]["payload_bytes"] == 4
        for a in archives.join(normal, "path").collect():
            mono, members = gzip.open(a["path"]).read(), gzip.open(a["normal_path"]).read()
            assert mono == members
    few = warc.with_record_types(pages, min_bytes=5)
    assert few.filter("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.normalise(warc.write_archives(warc.with_record_types(pages.limit(0)), f"{tmp_path}/no"), f"{tmp_path}/no2")).count() == 0


def test_broken_archives():
    data = warc.record(1, "u", b"x", "response")
    with pytest.raises(ValueError):
        list(warc.records(iter([data[:-3]])))
    packed = gzip.compress(data * 3)
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(lambda n, it=iter([packed[:-20], b""]): next(it))))
    assert len(list(warc.records(warc.inflated(lambda n, it=iter([packed, gzip.compress(data), b""]): next(it))))) == 4


def test_overlaps_of_a_large_group_of_copies_take_two_numbers_a_match():
    members, own = 200, 100
    held = jaccard_join.Held(np.zeros(members, np.int64), np.full(members, own), np.tile(np.arange(1, own + 1, dtype=np.uint64), members))
    held.ordered(np.arange(members))
    tracemalloc.start()
    try:
        found = [len(a) for a, _, both in held.overlaps(np.arange(members), np.zeros(members, np.int64), np.full(members, members)) if (both == own).all()]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(found) == members * members
    assert most < 20 * members * members * own  # bytes; 16 are two 64-bit numbers
