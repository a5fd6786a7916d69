"""Importance resampling: how much likelier a text is under target text than under raw text.

Words and word pairs are hashed to cells; the cells' counts over all raw texts, and over
texts known to be good, make two generative models. The log ratio of the models weighs
each document, and Gumbel noise on it turns taking the top k into sampling k documents
without replacement, with chances in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exact, others, packed, passing, ranked, ready, saved, unpacked
from .words import SPACED, grouped, mixed, windows, with_columns_from_text, words

BUCKETS = 1 << 18
#: Labelled rows that the target is made of and the sample's share is taken from.
MAX_LABELLED = 40_000
#: Standard deviations off the raw model at which a cell's log ratio counts half.
HALF_SURE = 10.0


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words and neighbouring pairs of some texts, and whose each is."""
    w = words(texts, SPACED, fold=True)
    text_of = np.repeat(np.arange(len(texts)), np.diff(w.first))
    pair = windows(w.hashes, 2)
    whole = text_of[1:] == text_of[:-1]
    keys = np.concatenate([mixed(w.hashes), pair[whole]])
    return (keys & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([text_of, text_of[:-1][whole]])


def log_ratios(raw: np.ndarray, good: np.ndarray, half_sure: float = HALF_SURE) -> np.ndarray:
    """Log ratio of target and raw model for cells with these counts.

    Both models add one to each count. The target model is then drawn towards the raw one, the
    less the target's count is off the expected one: z standard deviations count as
    z^2 / (z^2 + half_sure^2) of the log ratio. No cell is left out.
    """
    if not good.sum():
        return np.zeros(len(raw))
    expected = (raw + 1) / (raw.sum() + len(raw)) * good.sum()
    z2 = (good - expected) ** 2 / (expected + 1)
    return np.log((good + 1) / (expected + 1)) * z2 / (z2 + half_sure**2)


def fit(df: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of target and raw model for each cell.

    All rows of df make the raw model, those with an id in target_ids (a column, of
    MAX_LABELLED rows at most) the target. Each task sends a row for each cell it met.
    """
    ready(df.sparkSession)
    marked = target_ids.toDF("_id").distinct().withColumn("_target", F.lit(True))
    rows = df.select(exact(id_col).alias("_id"), exact(text_col).cast("binary").alias("_t")).join(F.broadcast(marked), "_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            target = np.array([bool(x) for x in batch.column(1).to_pylist()], bool)
            for at, group in grouped([t or b"" for t in batch.column(0).to_pylist()]):
                cell, owner = cells(group)
                total[0] += np.bincount(cell, minlength=BUCKETS)
                total[1] += np.bincount(cell[target[at + owner]], minlength=BUCKETS)
        met = np.flatnonzero(total[0])
        for k in range(0, len(met), 1 << 16):
            c = met[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(total[0][c]), pa.array(total[1][c])], names=["cell", "raw", "good"])

    sums = rows.select("_t", "_target").mapInArrow(run, "cell long, raw long, good long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    got = sums.toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["cell"]], good[got["cell"]] = got["raw"], got["good"]
    return log_ratios(raw, good)


def score(df: DataFrame, ratios: np.ndarray, text_col: str = "text") -> DataFrame:
    """df with `log_weight`: the sum of its cells' log ratios. Texts without words, and null, weigh 0."""
    held = ready(df.sparkSession).sparkContext.broadcast(ratios)  # BUCKETS numbers

    def compute(texts):
        out = np.zeros(len(texts))
        for at, group in grouped([t or b"" for t in texts]):
            cell, owner = cells(group)
            out[at : at + len(group)] = np.bincount(owner, held.value[cell], len(group))
        return [out]

    return with_columns_from_text(df, text_col, [T.StructField("log_weight", T.DoubleType())], compute)


def resample(df: DataFrame, k: int, id_col: str = "doc_id", seed: str = "resample") -> DataFrame:
    """df with `gumbel_key` and `kept`: the k rows of the greatest log_weight plus Gumbel noise.

    The noise is a function of the id and the seed, so runs repeat; rows of one id have
    the same. Ties go by a hash of the id. k beyond the rows keeps all.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), exact(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keep = others(df, ["gumbel_key", "kept"])
    rows = df.select(packed(keep), (F.col("log_weight") - F.log(-F.log(u))).alias("_key"), exact(id_col).alias("_id"))
    rows = ranked(rows, [-F.col("_key"), F.xxhash64("_id"), F.col("_id")])
    return rows.select("_row._row", F.col("_row._key").alias("gumbel_key"), (F.col("_rank") < k).alias("kept")).select(*unpacked(keep), "gumbel_key", "kept")


def labelled(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """At most max_labelled labelled ids, those of least hashes, and whether each is good: quality and not toxic."""
    known = labels.dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg((F.max("quality") > 0).alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_x"))
    known = known.select("doc_id", (F.col("_q") & (F.col("_x") == 0)).alias("good"))
    return known.orderBy(F.xxhash64(F.lit("target"), "doc_id"), "doc_id").limit(max_labelled)


def op1_importance(spark, sf_dir: str) -> DataFrame:
    """All documents, weighed towards labelled good ones; as large a share is kept as of the labelled rows is good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = saved(labelled(spark.read.parquet(f"{sf_dir}/labels.parquet")), "target")
    n, good = known.agg(F.count(F.lit(1)), F.sum(F.col("good").cast("long"))).first()
    ratios = fit(docs, known.filter("good").select("doc_id"))
    with passing(spark):  # written once: range partitioning reads its input twice
        weighed = saved(score(docs, ratios).select("doc_id", "log_weight"), "weighed")
        total = weighed.count()
        return resample(weighed, round(total * (good or 0) / n) if n else total).select("doc_id", "log_weight", "gumbel_key", "kept")
