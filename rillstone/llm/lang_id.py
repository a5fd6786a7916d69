"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies come from all training texts. The regression learns from a bounded
sample, row by row, by follow-the-regularised-leader with an L1 and an L2 penalty; a
temperature fitted on sampled rows that it did not see turns its scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exact, passing, ready, saved
from .words import mixed, with_columns_from_text

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Rows of a language to learn from, about; rows in all; passes over them.
ROWS_PER_LANG, MAX_ROWS, EPOCHS = 1000, 20_000, 2
#: Cells of all rows to learn from (8 bytes each, on the driver).
MAX_CELLS = 16_000_000
#: Of the learner: step size, its offset, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"
_PIECE = 1 << 20
_TABLE: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Each character's lower-case letter, or 32 for what is no letter."""
    if not _TABLE:
        out = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _TABLE.append(out)
    return _TABLE[0]


def ngram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash cells of the n-grams of a whole text, and how often each comes; None without a letter.

    What is no letter, or no UTF-8, counts as a blank, and a run of blanks as one.
    """
    if not text:
        return None
    table, total = _folded(), np.zeros(BUCKETS, np.int64)
    whole, tail, letters = text.decode(errors="replace"), np.full(1, 32, np.uint32), False
    for at in range(0, len(whole), _PIECE):
        now = table[np.frombuffer(whole[at : at + _PIECE].encode("utf-32-le"), np.uint32)]
        letters = letters or bool((now != 32).any())
        if at + _PIECE >= len(whole):
            now = np.append(now, np.uint32(32))
        joined = np.concatenate([tail, now])
        stays = np.ones(len(joined), bool)
        stays[1:] = (joined[1:] != 32) | (joined[:-1] != 32)
        joined = joined[stays]
        old = int(stays[: len(tail)].sum())
        code = joined.astype(np.uint64) + np.uint64(1)
        gram = code
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                gram = gram[:-1] * np.uint64(0x200003) + code[n - 1 :]
            if n in ORDERS:
                new = gram[max(0, old - n + 1) :]  # those that end in this piece
                total += np.bincount((mixed(new) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        tail = joined[-(max(ORDERS) - 1) :]
    if not letters:
        return None
    cells = np.flatnonzero(total)
    return cells, total[cells]


def vector(grams: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of unit length: cells and values."""
    cells, n = grams
    x = (1 + np.log(n)) * idf[cells]
    return cells, x / max(float(np.sqrt((x * x).sum())), 1e-12)


def document_frequencies(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each cell comes, over all rows of df, and how many have any.

    Each task sends a row for each cell, and one sum for each cell goes to the driver.
    """
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if grams := ngram_counts(text):
                    total[grams[0]] += 1
                    total[-1] += 1
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = df.select(F.col(text_col).cast("binary")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out[:-1], int(out[-1])


class Model:
    """Weights of each language, smoothed inverse document frequencies, temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf, self.temperature = langs, idf, 1.0
        self.weights = np.zeros((BUCKETS, len(langs)))
        self.bias = np.zeros(len(langs))

    def scores(self, cells: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[cells] + self.bias

    def probabilities(self, text: bytes | None) -> np.ndarray | None:
        grams = ngram_counts(text)
        if grams is None or not self.langs:
            return None
        return softmax(self.scores(*vector(grams, self.idf)) / self.temperature)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(model: Model, rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], seed: int = 4) -> None:
    """FTRL-proximal with elastic net over rows of (vector, language); every fifth row calibrates."""
    rng = np.random.default_rng(seed)
    kinds = len(model.langs)
    order = rng.permutation(len(rows))
    aside, seen = order[: len(rows) // 5], order[len(rows) // 5 :]
    z, n = np.zeros((BUCKETS + 1, kinds)), np.zeros((BUCKETS + 1, kinds))

    def weight(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in rng.permutation(seen):
            (cells, x), lang = rows[i]
            at, x = np.append(cells, BUCKETS), np.append(x, 1.0)
            w = weight(at)
            g = softmax(x @ w)
            g[lang] -= 1
            grad = x[:, None] * g[None, :]
            more = n[at] + grad * grad
            z[at] += grad - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    every = weight(slice(None))
    model.weights, model.bias = every[:-1], every[-1]
    if len(aside):
        s = np.stack([model.scores(*rows[i][0]) for i in aside])
        y = np.array([rows[i][1] for i in aside])
        loss = lambda t: -np.log(softmax(s / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG, max_rows: int = MAX_ROWS, max_cells: int = MAX_CELLS) -> Model:
    """Model of the rows of df that have a language and a text with a letter.

    Document frequencies cover all rows. The regression learns from about rows_per_lang
    ids of each language, those of least hashes, max_rows ids and max_cells cells in all, one row of each id
    and language. Rows without an id don't take part in it.
    Without any row there are no languages and everything is `und`.
    """
    rows = df.select(exact(id_col).alias("_id"), exact(text_col).alias("_t"), exact(lang_col).alias("_lang")).filter(F.col("_lang").isNotNull())
    frequencies, texts = document_frequencies(rows, "_t")
    idf = np.log((1 + texts) / (1 + frequencies)) + 1
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(max_rows).collect()
    if not sizes:
        return Model([], idf)
    # A row is taken if its hash is in its language's share of the hashes.
    share = df.sparkSession.createDataFrame([(r["_lang"], min(1.0, rows_per_lang / r["n"])) for r in sizes], "_lang string, _share double")
    with passing(df.sparkSession):
        sample = _sample(rows, share, max_rows, max_cells)
    model = Model(sorted({r["_lang"] for r in sample}), idf)
    place = {x: i for i, x in enumerate(model.langs)}
    learn(model, [(vector((np.frombuffer(r["_cells"], "<i4"), np.frombuffer(r["_counts"], "<i4")), idf), place[r["_lang"]]) for r in sample])
    return model


def _sample(rows: DataFrame, share: DataFrame, max_rows: int, max_cells: int) -> list:
    """Rows (_id, _lang, _cells, _counts) to learn from, in a set order."""
    u = F.pmod(F.xxhash64(F.lit("lang_id"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    # Ids first, at most max_rows; their texts stay where they are and only their cells go to the driver.
    ids = rows.select("_id", "_lang").filter(F.col("_id").isNotNull()).join(F.broadcast(share), "_lang").filter(u < F.col("_share"))  # max_rows languages at most
    ids = saved(ids.select("_id").distinct().orderBy(F.xxhash64(F.lit("lang_id"), "_id"), "_id").limit(max_rows), "lang_ids")
    taken = rows.join(F.broadcast(ids), "_id", "left_semi")

    def pack(texts):
        grams = [ngram_counts(t) for t in texts]
        return [[None if g is None else g[0].astype("<i4").tobytes() for g in grams], [None if g is None else g[1].astype("<i4").tobytes() for g in grams]]

    packed = with_columns_from_text(taken, "_t", [T.StructField("_cells", T.BinaryType()), T.StructField("_counts", T.BinaryType())], pack, keep_text=False)
    packed = saved(packed.filter(F.col("_cells").isNotNull()).select("_id", "_lang", "_cells", "_counts"), "lang_rows")
    # Ids in the order of their hashes, as many as max_cells allow; the window sees max_rows ids and no cells.
    sizes = packed.groupBy("_id").agg((F.sum(F.octet_length("_cells")) / 4).alias("_n"))
    order = Window.orderBy(F.xxhash64(F.lit("lang_id"), "_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    within = sizes.withColumn("_sum", F.sum("_n").over(order)).filter(F.col("_sum") <= max_cells).select("_id")
    sample = packed.join(F.broadcast(within), "_id", "left_semi").collect()
    return list({(r["_id"], r["_lang"]): r for r in sorted(sample, key=lambda r: (str(r["_id"]), r["_lang"], bytes(r["_cells"])))}.values())


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with `lang_pred` and `score`, from the whole text alone.

    Null texts and texts without a letter are `und` with score 0. Columns of the two
    names are replaced, others stay.
    """
    held = ready(df.sparkSession).sparkContext.broadcast(model)  # BUCKETS weights a language

    def compute(texts):
        lang, score = [], []
        for t in texts:
            p = held.value.probabilities(t)
            lang.append(UNKNOWN if p is None else held.value.langs[int(p.argmax())])
            score.append(0.0 if p is None else float(p.max()))
        return [lang, score]

    return with_columns_from_text(df, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], compute)


def op4_lang_id(spark, sf_dir: str) -> DataFrame:
    """All documents by a model of those whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    model = fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
