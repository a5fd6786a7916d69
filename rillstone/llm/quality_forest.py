"""Quality rules and an isolation forest over what they measure.

Every text gets counts (words, symbols, repeated lines and windows). A forest of random
splits over a bounded sample of good rows says how few splits set a document apart from
those; how few is too few is calibrated on labelled rows of both kinds that the forest has
not seen. Splits are drawn from the whole box that labelled rows span, so that a region
without any good row is left in few steps: bad rows come in bulk, and a forest over all
rows, or one that splits the range of a node's rows, takes such bulk for normal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exact, ready
from .words import SPACED, byte_class, grouped, mixed, sums_by_text, windows, with_columns_from_text, words

WINDOW = 5
#: Bounds of what is learnt from: labelled rows, trees, rows of a tree.
MAX_LABELLED, TREES, TREE_ROWS = 20_000, 128, 256
#: Labelled rows from which on those that calibrate are others than those that grow the forest.
MIN_APART = 100
#: Share of good labelled rows that the threshold may reject.
MAX_GOOD_LOST = 0.005

_SYMBOLS = byte_class(b"#*$%&|<>")
_UPPER = byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = byte_class(b"0123456789")
_MARKS = byte_class(b"!?;:\"'()[]{}=+/\\^~_`@-")
_HEADS = ~byte_class(bytes(range(0x80, 0xC0)))  # bytes that begin a character
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_lines")


def counts(texts: list[bytes | None]) -> list[np.ndarray]:
    """The columns of _COUNTS for some texts. Null counts as empty."""
    out = np.zeros((len(_COUNTS), len(texts)), np.int64)
    texts = [t or b"" for t in texts]
    for at, group in grouped(texts):
        w = words(group, SPACED, fold=False)
        here = slice(at, at + len(group))
        n = np.diff(w.first)
        out[0, here] = n
        out[1, here] = sums_by_text(SPACED[w.data] & _HEADS[w.data], w.begins)
        for row, kind in ((2, _SYMBOLS), (5, _UPPER), (6, _DIGITS), (7, _MARKS)):
            out[row, here] = sums_by_text(kind[w.data], w.begins)
        for i, t in enumerate(group):
            lines = [x for x in t.split(b"\n") if x.strip()]
            out[3, at + i] = len(lines) - len(set(lines))
            out[8, at + i] = len(lines)
        # Windows of all the group's texts at once; a text's own salt keeps texts apart.
        text_of = np.repeat(np.arange(len(group)), n)
        whole = np.flatnonzero(np.arange(len(text_of)) + WINDOW <= w.first[1:][text_of])
        keys = windows(w.hashes, WINDOW)[whole] ^ mixed(text_of[whole].astype(np.uint64) + np.uint64(1))
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            starts = whole[twice[place] == keys]
            change = np.zeros(len(text_of) + 1, np.int64)
            change[starts] += 1
            np.add.at(change, starts + WINDOW, -1)
            out[4, here] = sums_by_text(np.cumsum(change)[:-1] > 0, w.first)
    return list(out)


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts of its texts as long columns, and without the texts."""
    return with_columns_from_text(df, text_col, [T.StructField(c, T.LongType()) for c in _COUNTS], counts, keep_text=False)


def features(c: list[np.ndarray]) -> np.ndarray:
    """Rule statistics that don't depend on a text's length, a row for each text."""
    n, chars, symbols, dup, repeat, upper, digits, marks, lines = (np.asarray(x, float) for x in c)
    some, glyphs = np.maximum(n, 1), np.maximum(chars, 1)
    shares = [symbols / glyphs, dup / np.maximum(lines, 1), repeat / some, upper / glyphs, digits / glyphs, marks / glyphs]
    return np.stack([np.log1p(chars / some), *[np.log1p(1000 * x) for x in shares]], axis=1)


def _mean_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of a random search tree over n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees in arrays: the feature and threshold of each node, and where its children are."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.deepest = 2 * max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], low, high, rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        feature, threshold, left, value = [], [], [], []
        todo = [(rows, low, high, 0)]  # breadth first: children are neighbours
        while todo:
            here, lo, hi, depth = todo.pop(0)
            wide = np.flatnonzero(hi > lo) if len(here) > 1 else []
            if depth >= self.deepest or not len(wide):
                feature.append(-1), threshold.append(0.0), left.append(0)
                value.append(depth + float(_mean_depth(len(here))))
                continue
            f = int(rng.choice(wide))
            t = rng.uniform(lo[f], hi[f])
            feature.append(f), threshold.append(t), value.append(0.0)
            left.append(len(feature) + len(todo))
            below, above = hi.copy(), lo.copy()
            below[f] = above[f] = t
            todo += [(here[here[:, f] <= t], lo, below, depth + 1), (here[here[:, f] > t], above, hi, depth + 1)]
        return np.array(feature), np.array(threshold), np.array(left), np.array(value)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1: the shorter the mean path, the higher."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.deepest):
                f = feature[at]
                down = left[at] + (rows[every, f] > threshold[at])
                at = np.where(f >= 0, down, at)
            total += value[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_mean_depth(self.size)), 1e-9))


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def threshold_of(scores: np.ndarray, good: np.ndarray, max_good_lost: float = MAX_GOOD_LOST) -> float:
    """The score above which documents go.

    Of the scores of labelled rows, the one that separates good and bad rows best (most
    bad rows above it, less good ones) among those that lose at most the given share
    of good rows. Without rows of both kinds nothing goes.
    """
    if not good.any() or good.all():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    ranked, lost, caught = scores[order], np.cumsum(good[order]) / good.sum(), np.cumsum(~good[order]) / (~good).sum()
    last = np.append(ranked[1:] != ranked[:-1], True)  # rows of one score go together
    gain = np.where(last & (lost <= max_good_lost), caught - lost, -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return float("inf")
    below = ranked[best + 1] if best + 1 < len(ranked) else 0.0
    return float((ranked[best] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[Forest | None, float]:
    """Forest and threshold from at most max_labelled labelled rows, those of the least hashes of their ids.

    Half of them, by their hashes, grow the forest; the other half sets the threshold. With
    fewer than MIN_APART rows both use all. Rows without a label or an id, or that fail the base rules,
    teach nothing. Without a good one there is no forest. An id labelled more than once counts as
    good if any of its labels is.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("_good"))
    known = known.withColumn("_u", F.xxhash64("doc_id")).orderBy("_u", "doc_id").limit(max_labelled)
    rows = docs.select(exact(id_col).alias("_id"), exact(text_col).alias("_t")).join(F.broadcast(known), F.col("_id") == F.col("doc_id"))  # max_labelled ids
    rows = measure(rows.select("_id", "_good", "_u", "_t"), "_t").toPandas().drop_duplicates("_id").sort_values("_id")
    rows = rows[~base_failed(rows["n_words"], rows["n_repeat_words"])]
    good = rows["_good"].to_numpy(bool)
    if not good.any():
        return None, float("inf")
    x = features([rows[c].to_numpy() for c in _COUNTS])
    grows = (rows["_u"].to_numpy() >> 20) % 2 == 0 if len(rows) >= MIN_APART else np.ones(len(rows), bool)
    if not (good & grows).any():
        grows[:] = True
    forest = Forest(x[good & grows], x[grows].min(axis=0), x[grows].max(axis=0))
    judges = ~grows if not grows.all() else grows
    return forest, threshold_of(forest.score(x[judges]), good[judges])


def judge(df: DataFrame, forest: Forest | None, threshold: float, text_col: str = "text") -> DataFrame:
    """df with the counts, `base_failed`, `anomaly` (0 to 1) and `kept`.

    Texts of fewer than 10 words, or with over a fifth of their words in repeated
    windows, fail the base rules and go; others go if the forest finds them too odd.
    Null counts as empty. Columns of the new names are replaced, others stay.
    """
    held = ready(df.sparkSession).sparkContext.broadcast(forest)  # TREES trees of 2 * TREE_ROWS nodes, about

    def compute(texts):
        c = counts(texts)
        failed = base_failed(c[0], c[4])
        odd = held.value.score(features(c)) if held.value else np.zeros(len(texts))
        return [*c, failed, odd, ~failed & (odd <= threshold)]

    fields = [*[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return with_columns_from_text(df, text_col, fields, compute)


def op8_quality_forest(spark, sf_dir: str) -> DataFrame:
    """Rules and verdict for all documents; the forest learns from `labels`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest, threshold = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = judge(docs, forest, threshold)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
