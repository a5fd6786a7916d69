"""Benchmark decontamination by an FM-index for each training shard.

A shard's words become a string over the test vocabulary. Its suffix array gives the
Burrows-Wheeler transform, kept as a wavelet matrix with rank counts; test phrases are
searched backwards, all at once, their places are found by stepping back to sampled
suffix positions, and the places of all phrases merge into spans to remove.

Words that no test phrase has can't be in an occurrence. A shard is therefore indexed
over its runs of test words that are as long as the shortest phrase; all else is
separators. This leaves out nothing that could match.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exact, others, packed, ready, saved, unpacked
from .words import ALNUM, byte_class, grouped, with_columns_from_text, words

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 4 << 20
#: Test words that are broadcast and searched at once; a larger benchmark takes more passes.
BLOCK_WORDS = 1_000_000
_HEADS = ~byte_class(bytes(range(0x80, 0xC0)))


class Phrases(NamedTuple):
    vocabulary: np.ndarray  # hashes of the words, sorted; a word's symbol is its place plus 1
    symbols: np.ndarray  # a row for each phrase, its words aligned right, 0 before
    lengths: np.ndarray
    item_first: np.ndarray  # where each phrase's items begin in item_of
    item_of: np.ndarray  # places in names
    names: list[str]


def phrases(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Phrases:
    """The distinct windows of some test items; an item of fewer words is one window, one of none has none.

    Windows of an item without a name are searched like others and name no item.
    """
    w = words([t for _, t in items], ALNUM, fold=True) if items else None
    vocabulary, symbol = np.unique(w.hashes, return_inverse=True) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    names = sorted({n for n, _ in items if n is not None})
    place = {n: i for i, n in enumerate(names)} | {None: -1}
    rows, owner = [], []
    for i, (name, _) in enumerate(items):
        own = symbol[w.first[i] : w.first[i + 1]].astype(np.int64) + 1
        if len(own) >= window:
            rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
        elif len(own):
            rows.append(np.concatenate([np.zeros(window - len(own), np.int64), own])[None, :])
        else:
            continue
        owner.append(np.full(len(rows[-1]), place[name]))
    if not rows:
        return Phrases(vocabulary, np.zeros((0, window), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), names)
    distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)], axis=1), axis=0)
    pairs = pairs[pairs[:, 1] >= 0]
    return Phrases(vocabulary, distinct, (distinct > 0).sum(axis=1), np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1], names)


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; only runs of suffixes still tied are sorted again."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = heads
    step = 1
    while True:
        group = rank[order]
        tied = np.zeros(n, bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        at = order[slots]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1)
        by = np.lexsort((after, group[slots]))
        at, after, own = at[by], after[by], group[slots][by]
        order[slots] = at
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        step *= 2


class WaveletMatrix:
    """Ranks and symbols of a string, a bit of the symbol for each level, highest first."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for b in range(self.bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((bit, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` comes to on the way down with symbol; the difference of two such is a rank."""
        for (_, ones, zeros), b in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            before = ones[at]
            at = np.where((symbol >> b) & 1, zeros + before, at - before)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and where these come to."""
        symbol = np.zeros(len(at), np.int64)
        for bit, ones, zeros in self.levels:
            b, before = bit[at], ones[at]
            symbol = symbol * 2 + b
            at = np.where(b == 1, zeros + before, at - before)
        return symbol, at


class FMIndex:
    """Search of phrases in a string over 1..top, 0 separating its runs."""

    def __init__(self, string: np.ndarray, top: int, sample: int = SAMPLE):
        gaps = string == 0
        # Separators differ from each other, so that no comparison runs past one.
        keys = np.where(gaps, np.cumsum(gaps), string + int(gaps.sum()))
        self.order = suffix_array(keys)
        before = np.concatenate([[0], string[:-1]])
        self.bwt = WaveletMatrix(before[self.order], top)
        self.smaller = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(string, minlength=top + 1), out=self.smaller[1:])
        every = np.arange(top + 1)
        self.base = self.bwt.place(every, np.zeros(top + 1, np.int64))
        # Sampled: each run's first word, and every few words. All else is found by stepping back to one.
        since = np.arange(len(string)) - np.maximum.accumulate(np.where(gaps, np.arange(len(string)), -1)) - 1
        self.sampled = ((since % sample == 0) | gaps)[self.order]
        self.known = self.order[self.sampled]
        self.nth = np.cumsum(self.sampled) - 1
        self.size = len(string)
        del self.order

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.bwt.place(symbol, at) - self.base[symbol]

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases found, and their intervals of suffixes."""
        alive = np.arange(len(symbols))
        lo, hi = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.size)
        for k in range(symbols.shape[1]):
            c = symbols[alive, symbols.shape[1] - 1 - k]
            on = lengths[alive] > k
            lo, hi = np.where(on, self.back(c, lo), lo), np.where(on, self.back(c, hi), hi)
            here = lo < hi
            alive, lo, hi = alive[here], lo[here], hi[here]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Positions of the suffixes of all intervals, one interval after another."""
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        out = np.zeros(len(at), np.int64)
        left, steps = np.arange(len(at)), 0
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.known[self.nth[at[done]]] + steps
            left, at = left[~done], at[~done]
            if len(left):
                symbol, down = self.bwt.read(at)
                at = self.smaller[symbol] + down - self.base[symbol]
            steps += 1
        return out


def scan(texts: list[bytes], p: Phrases) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of a shard of texts: words, merged spans (first and last word, as characters and as words) and items."""
    w = words(texts, ALNUM, fold=True)
    n_words = np.diff(w.first)
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not len(p.lengths) or not len(w.hashes):
        return n_words, spans, items
    place = np.minimum(np.searchsorted(p.vocabulary, w.hashes), len(p.vocabulary) - 1)
    symbol = np.where(p.vocabulary[place] == w.hashes, place + 1, 0)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    # Runs of test words within a text.
    opens = (symbol > 0) & np.concatenate([[True], (symbol[:-1] == 0) | (text_of[1:] != text_of[:-1])])
    run = np.cumsum(opens) - 1
    size = np.bincount(run[symbol > 0], minlength=int(opens.sum())) if opens.any() else np.zeros(0, int)
    keep = np.flatnonzero((symbol > 0) & (size[np.maximum(run, 0)] >= p.lengths.min())) if len(size) else np.zeros(0, int)
    if not len(keep):
        return n_words, spans, items
    slot = np.arange(len(keep)) + np.cumsum(opens[keep])  # a separator before each run
    string = np.zeros(len(keep) + int(opens[keep].sum()) + 1, np.int64)
    string[slot] = symbol[keep]
    origin = np.zeros(len(string), np.int64)
    origin[slot] = keep
    index = FMIndex(string, len(p.vocabulary))
    found, lo, hi = index.search(p.symbols, p.lengths)
    if not len(found):
        return n_words, spans, items
    at = origin[index.locate(lo, hi)]
    which = np.repeat(found, hi - lo)
    change = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + p.lengths[which], -1)
    hit = np.cumsum(change)[:-1] > 0
    begins = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (text_of[1:] != text_of[:-1])]))
    lasts = np.flatnonzero(hit & np.concatenate([~hit[1:] | (text_of[1:] != text_of[:-1]), [True]]))
    heads = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_HEADS[w.data], out=heads[1:])
    for b, e in zip(begins, lasts, strict=True):
        t = text_of[b]
        zero = heads[w.begins[t]]
        spans[t].append((int(heads[w.starts[b]] - zero), int(heads[w.ends[e]] - zero), int(b - w.first[t]), int(e - w.first[t] + 1)))
    for t, q in np.unique(np.stack([text_of[at], which], axis=1), axis=0):
        items[t].extend(p.names[i] for i in p.item_of[p.item_first[q] : p.item_first[q + 1]])
    return n_words, spans, [sorted(set(x)) for x in items]


_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "word", "word_end")])


def merged(packed_spans: list[bytes | None]) -> list:
    """Spans of several blocks as one list each, those that meet as one, and the words in them."""
    out, hit = [], []
    for p in packed_spans:
        every = np.frombuffer(p or b"", "<i8").reshape(-1, 4)
        every = every[np.argsort(every[:, 2], kind="stable")]
        ends = np.maximum.accumulate(every[:, 1]) if len(every) else every[:, 1]
        word_ends = np.maximum.accumulate(every[:, 3]) if len(every) else every[:, 3]
        opens = np.flatnonzero(np.concatenate([[True], every[1:, 2] > word_ends[:-1]])) if len(every) else np.zeros(0, np.int64)
        lasts = np.append(opens[1:], len(every)) - 1 if len(every) else opens
        own = np.stack([every[opens, 0], ends[lasts], every[opens, 2], word_ends[lasts]], axis=1)
        out.append([dict(zip(_SPAN.names, map(int, x), strict=True)) for x in own])
        hit.append(int((own[:, 3] - own[:, 2]).sum()))
    return [out, hit]


def find(df: DataFrame, held, text_col: str, fields: list[T.StructField], finish=None, keep_text: bool = False) -> DataFrame:
    """df with the number of words, packed spans (four whole numbers each) and items for the phrases of one block.

    finish makes further columns of the packed spans.
    """

    def compute(texts):
        n_words, spans, items = [], [], []
        for _, shard in grouped([t or b"" for t in texts], SHARD_BYTES):
            n, s, i = scan(shard, held.value)
            n_words.append(n)
            spans += [np.array(own, "<i8").tobytes() for own in s]
            items += i
        return [np.concatenate(n_words) if n_words else [], items, *(finish(spans) if finish else [spans])]

    return with_columns_from_text(df, text_col, fields, compute, keep_text)


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """Test items in runs of about block_words words at most. Items without a text are left out."""
    rows = benchmark.select(exact(item_col).cast("string").alias("i"), exact(text_col).cast("binary").alias("t")).filter(F.col("t").isNotNull())
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r["t"]) // 2 + 1  # a word and its gap take two bytes
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r["i"], bytes(r["t"])))
        size += n
    yield block


def contaminated(n_hit, n_words):
    """At least a twentieth of the words are in test phrases."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """df with `n_words`, `spans`, `items`, `n_hit` and `contaminated`.

    spans: what to remove, as (start, end) in characters and (word, word_end) in words,
    merged and in order. items: ids of items with an occurring window, sorted as strings;
    items without an id are searched and hit words, but aren't listed. A null text has no
    words. An empty benchmark finds nothing. Each row is judged by itself; rows may repeat.
    Columns of the new names are replaced, others stay. A benchmark over block_words words
    takes a pass for each block; what a pass found goes along with its rows into the next.
    """
    keep = others(df, ["n_words", "spans", "items", "n_hit", "contaminated"])
    rows = df.select(packed(keep), exact(text_col).alias("_text"))
    context = ready(df.sparkSession).sparkContext
    every = blocks(benchmark, item_col, item_text_col, block_words)
    block, n = next(every), 0
    words_of, items_of = T.StructField("n_words", T.LongType()), lambda c: T.StructField(c, T.ArrayType(T.StringType()))
    last = [T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("n_hit", T.LongType())]
    while True:
        following = next(every, None)
        held = context.broadcast(phrases(block))  # block_words words at most
        if following is None and not n:
            out = find(rows, held, "_text", [words_of, items_of("items"), *last], merged)
            break
        rows = find(rows, held, "_text", [words_of, items_of(f"items{n}"), T.StructField(f"spans{n}", T.BinaryType())], keep_text=following is not None)
        n += 1
        if following is None:
            items = F.array_sort(F.array_distinct(F.concat(*[f"items{i}" for i in range(n)])))
            rows = rows.select("_row", "n_words", items.alias("items"), F.concat(*[f"spans{i}" for i in range(n)]).alias("_packed"))
            out = with_columns_from_text(rows, "_packed", last, merged, keep_text=False)
            break
        rows, block = saved(rows, "pass"), following
        held.unpersist()  # its pass is written
    return out.select(*unpacked(keep), "n_words", "spans", "items", "n_hit", contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def cleaned(text, spans):
    """Text without its spans, as an expression."""
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    return F.array_join(F.transform(F.arrays_zip(edges.alias("a"), stops.alias("b")), lambda x: F.substr(text, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))), "")


def op10_fm_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all of `benchmark`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item AS (SELECT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + 12], ' ') AS s FROM bw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM item),
doc AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM dw, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
found AS (SELECT DISTINCT doc_id, i, doc.k, item_id FROM doc JOIN item ON doc.s = item.s AND doc.k = item.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(named.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN named ON named.doc_id = dw.doc_id
"""
