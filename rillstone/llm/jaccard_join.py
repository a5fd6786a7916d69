"""Exact Jaccard metric-space join of word shingles: pivots, their regions, and windows.

Jaccard distance is a metric, but unrelated texts are all at distance 1 from each
other, where the triangle inequality excludes nothing. So the space is first cut along
shingles: linked sets share one of the rarest quarter of either's shingles, and sets
tied together by such shingles make a cell, which holds all links of its members.

Inside cells the join is one by pivots. A cell that is too large for a task gets pivots;
each member belongs to the Voronoi region of its nearest, or to the region of those far
from all, and is also copied to every region in whose window the triangle inequality lets it
have a link (`split`). Regions are cells of their own and join recursively; one that fits a
task is joined there (`joined`): its members are sorted by their distance to a pivot, and
each is looked up only among those that the window of this distance leaves, before any
overlap is counted. Regions that windows can't make smaller, since all members are about
equally far from each other, are joined in blocks of some members against all.

Equal sets are one class throughout. Before cells are made, classes that share too few
of their least shingles with any other class are set aside; they can't link. Rows grow with
members, their copies and pivots, never with pairs of members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_labels, exact, give_back, others, packed, passing, ready, saved, unpacked
from .words import SPACED, grouped, mixed, windows, with_columns_from_text, words

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
RADIUS = (100 - PERCENT) / 100
#: Packed shingles of a bucket of the filter, about.
BUCKET_ROWS = 2_000_000
#: Rows of ids and the like that are broadcast; more of them are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Shingles of a region that is joined in one task, and of all regions of a task, about.
REGION_SHINGLES, TASK_SHINGLES = 1 << 16, 1 << 20
#: Least number of buckets, so that few rows still spread.
MIN_BUCKETS = 16
#: Pivots of a region that is split, about.
PIVOTS = 16
#: A region of more than this share of the region it came from is one that windows don't cut; all regions
#: too large for a task that come from one hold at most so many times its members. Copies then grow with
#: the square root of a cell's size over a task's at most.
SHRUNK, COPIES = 0.25, 2
#: Blocks of members, and members of a block, that are compared with all of a region that windows don't cut.
BLOCKS, BLOCK_MEMBERS = 8, 512
#: Matches of shingles that are held at once.
MATCHES = 4_000_000
_NEAR = 1e-9  # slack for windows of rounded distances; links are tested on whole numbers
_U = np.uint64


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than k words but one has its whole sequence as its only shingle.
    """
    for _, group in grouped([t or b"" for t in texts]):
        w = words(group, SPACED, fold=True)
        every = windows(w.hashes, k)
        for i in range(len(group)):
            a, b = w.first[i], w.first[i + 1]
            own = every[a : b - k + 1] if b - a >= k else windows(w.hashes[a:b], int(b - a))[: int(b > a)]
            own = np.sort(own)
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def tag_of(shingles: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed number."""
    total = (mixed(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(shingles))).reshape(1)
    return int(mixed(total).view(np.int64)[0])


def allowed(n):
    """How many of n shingles a link's other set can lack."""
    return (n * (100 - PERCENT)) // 100


def asked(n):
    """How many of a set's least shingles must be in other sets, if it links: a tenth of the least partner's."""
    return -(-n * PERCENT // 100) // 10 + 1


def taken(n):
    """How many of a set's least shingles the filter looks at, so that asked() of any partner are among both's."""
    return np.minimum(n, allowed(n) + n // 10 + 1)


def sketches(df: DataFrame, text_col: str, k: int = SHINGLE, keep_text: bool = True) -> DataFrame:
    """df with `n_shingles` and `_tag` of each text's set."""

    def compute(texts):
        n, tags = [], []
        for s in shingle_sets(texts, k):
            n.append(len(s))
            tags.append(tag_of(s))
        return [n, tags]

    return with_columns_from_text(df, text_col, [T.StructField("n_shingles", T.LongType()), T.StructField("_tag", T.LongType())], compute, keep_text)


def _distinct_pairs(keys: np.ndarray, tags: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, tag), whether each was told of before, and whether its key has two tags or more."""
    order = np.lexsort((told, tags, keys))
    keys, tags, told = keys[order], tags[order], told[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1])
    keys, tags, told = keys[fresh], tags[fresh], told[fresh]
    same = keys[1:] == keys[:-1]
    shared = np.zeros(len(keys), bool)
    shared[1:] |= same
    shared[:-1] |= same
    return keys, tags, told, shared


def survivors(rows: DataFrame, classes: DataFrame, text_col: str, k: int, bucket_rows: int) -> DataFrame:
    """Classes that may have a link: (_tag, n_shingles, _rep).

    The least shingles of each set meet in buckets by hash. A shingle that several
    classes of one batch hold is counted there, and only two holders go on, so a common
    shingle takes two rows a batch and not one for each document.
    """
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = int(max(MIN_BUCKETS, total * 0.35 // bucket_rows + 1))
    labels = np.array(bucket_labels(rows.sparkSession, buckets), np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, group in grouped([t or b"" for t in texts]):
                keys, tags = [], []
                for s in shingle_sets(group, k):
                    if len(s):
                        keys.append(s[: int(taken(len(s)))])
                        tags.append(np.full(len(keys[-1]), tag_of(s)))
                if not keys:
                    continue
                key, tag, _, shared = _distinct_pairs(np.concatenate(keys), np.concatenate(tags), np.zeros(sum(map(len, keys)), bool))
                counted, n = np.unique(tag[shared], return_counts=True)
                # Of a shared key its first two holders go on, told of already.
                first = np.concatenate([[True], key[1:] != key[:-1]])
                second = np.concatenate([[False], first[:-1]]) & ~first
                on = ~shared | first | second
                key, tag, told = key[on], tag[on], shared[on]
                bucket = ((key & _U(0xFFFFFFFF)) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, tag, told, bucket = key[order], tag[order], told[order], bucket[order]
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                blobs = [[x[cuts[b] : cuts[b + 1]].tobytes() for b in full] for x in (key, tag, told)]
                # Local counts go along in a bucket that the texts' tags choose, without a flag.
                local = (n.astype(np.int64).tobytes(), counted.tobytes(), b"")
                anywhere = int(mixed(np.bitwise_xor.reduce(tag.view(_U)).reshape(1))[0] % _U(buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*labels[full], labels[anywhere]], pa.int64()), *[pa.array([*x, y], pa.binary()) for x, y in zip(blobs, local, strict=True)]],
                    names=["bucket", "keys", "tags", "told"],
                )

    def meet(table: pa.Table) -> pa.Table:
        rows = list(zip(*[table.column(c).to_pylist() for c in ("keys", "tags", "told")], strict=True))
        keys, tags, told = (np.frombuffer(b"".join(r[i] for r in rows if r[2]), kind) for i, kind in enumerate((_U, np.int64, bool)))
        _, tag, known, shared = _distinct_pairs(keys, tags, told)
        counted, n = np.unique(tag[shared & ~known], return_counts=True)
        more, local = (np.frombuffer(b"".join(r[i] for r in rows if not r[2]), np.int64) for i in (0, 1))
        every, place = np.unique(np.concatenate([counted, local]), return_inverse=True)
        total = np.bincount(place, np.concatenate([n, more]), len(every)).astype(np.int64)
        return pa.table({"_tag": pa.array(every, pa.int64()), "n": pa.array(total, pa.int64())})

    sent = rows.select(exact(text_col).cast("binary").alias("_text")).mapInArrow(emit, "bucket long, keys binary, tags binary, told binary")
    met = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "_tag long, n long")
    shared = met.groupBy("_tag").agg(F.sum("n").alias("n"))
    least = F.floor((F.ceil(F.col("n_shingles") * PERCENT / 100)) / 10) + 1
    return classes.join(shared, "_tag").filter(F.col("n") >= least).drop("n")


def sets_of(df: DataFrame, chosen: DataFrame, id_col: str, text_col: str, k: int, max_broadcast: int) -> DataFrame:
    """(_tag, n, set) of the chosen classes, from the text of one document of each."""
    few = chosen.count() <= max_broadcast
    wanted = chosen.select(F.col("_rep").alias("_id"), F.col("_tag").alias("_wanted"))
    rows = df.select(exact(id_col).alias("_id"), exact(text_col).alias("_t")).join(F.broadcast(wanted) if few else wanted, "_id")

    def compute(texts):
        found = list(shingle_sets(texts, k))
        return [[tag_of(s) for s in found], [s.view(np.int64) for s in found]]

    got = with_columns_from_text(rows, "_t", [T.StructField("_tag", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))], compute, keep_text=False)
    got = got.filter(F.col("_tag") == F.col("_wanted")).select("_tag", F.size("set").cast("long").alias("n"), "set")
    return got.dropDuplicates(["_tag"])


def regions_of(sets: DataFrame) -> DataFrame:
    """(s, _tag, n): each class in the region of each of its rarest quarter of shingles that another class has."""
    each = sets.select("_tag", "n", F.explode("set").alias("s"))
    # Tables of groups are written before joins, here and below: Spark splits a hot key's rows only if the other side is no aggregate.
    common = saved(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common")
    held = each.join(common, "s").groupBy("_tag", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("held"))
    # Shingles of its own come first in a class's order, as they are rarest.
    room = F.floor(F.col("n") * (100 - PERCENT) / 100) + 1 - (F.col("n") - F.size("held"))
    return held.filter(room > 0).select(F.explode(F.slice("held", F.lit(1), room.cast("int"))).alias("h"), "_tag", "n").select("h.s", "_tag", "n")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): the least node reachable, for nodes that have a lesser one.

    Every node points to the least of its neighbourhood, in turns from above and from
    below, until nothing moves. The number of turns follows the logarithm of the longest path.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = saved(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _renamed(rows: DataFrame, col: str, found: DataFrame) -> DataFrame:
    """rows with a component's name replaced by that of the component it went into."""
    return rows.join(found, rows[col] == found["node"], "left").withColumn(col, F.coalesce("component", col)).drop("node", "component")


def cells_of(sets: DataFrame) -> DataFrame:
    """(_tag, n, cell): classes tied together by rare shingles, in cells of two or more."""
    regions = saved(regions_of(sets), "regions")
    heads = saved(regions.groupBy("s").agg(F.min("_tag").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size"), "heads")
    tied = saved(regions.join(heads, "s").select("_tag", "n", "head").distinct(), "tied")
    found = saved(components(tied.select(F.col("_tag").alias("a"), F.col("head").alias("b"))), "cells")
    return _renamed(tied.select("_tag", "n", F.col("_tag").alias("cell")).distinct(), "cell", found)


class Held:
    """Which members of some groups hold which shingle, for all groups of a task at once."""

    def __init__(self, group: np.ndarray, size: np.ndarray, values: np.ndarray):
        """group: a number for each member, equal in a group; size and values: their sets, one after another."""
        self.size = size
        owner = np.repeat(np.arange(len(size)), size)
        keys = values ^ mixed(group.astype(np.int64).view(_U) + _U(0x632BE59BD9B4E019))[owner]  # groups don't meet
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        ids = np.empty(len(keys), np.int64)
        ids[order] = np.cumsum(new) - 1
        self.kinds = int(new.sum())
        shared = np.bincount(ids, minlength=self.kinds)[ids] > 1  # what one member has alone counts nowhere
        self.owner, self.ids = owner[shared], ids[shared]
        self.first = np.searchsorted(self.owner, np.arange(len(size) + 1))

    def distance(self, head: np.ndarray) -> np.ndarray:
        """Each member's distance to the member that head names, one of its group."""
        marked = np.zeros(self.kinds, bool)
        marked[self.ids[np.isin(self.owner, head)]] = True
        both = np.bincount(self.owner, marked[self.ids], len(self.size))
        out = 1 - both / (self.size + self.size[head] - both)
        out[head] = 0.0
        return out

    def ordered(self, rank: np.ndarray) -> None:
        """From now on windows are of ranks."""
        self.at = np.argsort(rank)
        self.post = np.sort(self.ids * len(rank) + rank[self.owner])

    def overlaps(self, asking: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(asking member, other member, shingles of both), of others with ranks from low to below high.

        What has no shingle in common isn't in. In parts of MATCHES matches, about.
        """
        n = len(self.size)
        count = self.first[asking + 1] - self.first[asking]
        entry = np.repeat(self.first[asking] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        who = np.repeat(np.arange(len(asking)), count)
        lo = np.searchsorted(self.post, self.ids[entry] * n + low[who])
        found = np.searchsorted(self.post, self.ids[entry] * n + high[who]) - lo
        total = np.concatenate([[0], np.cumsum(np.bincount(who, found, len(asking)).astype(np.int64))])
        ends = np.searchsorted(who, np.arange(len(asking) + 1))
        a = 0
        while a < len(asking):
            b = max(a + 1, int(np.searchsorted(total, total[a] + MATCHES, "right")) - 1)
            part = slice(ends[a], ends[b])
            hits, start = found[part], lo[part]
            # In place: all copies of a large group match each other, and two workers share what an executor has beside its heap.
            place = np.arange(int(hits.sum()))
            place += np.repeat(start - np.concatenate([[0], np.cumsum(hits)])[:-1], hits)
            pair = self.post[place]
            del place
            pair %= n
            pair += np.repeat(who[part] * n, hits)
            pair.sort()
            first = np.flatnonzero(np.concatenate([[len(pair) > 0], pair[1:] != pair[:-1]])[: len(pair)])
            pair, both = pair[first], np.diff(first, append=len(pair))
            yield asking[pair // n], self.at[pair % n], both
            a = b

    def linked(self, a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
        return 100 * both >= PERCENT * (self.size[a] + self.size[b] - both)


def joined(group: np.ndarray, size: np.ndarray, values: np.ndarray, asks: np.ndarray, whole: np.ndarray, radius: float = RADIUS) -> tuple[list[tuple[int, int]], int]:
    """Links (places of members) that tie together whatever links of asking members with members of their groups do, and how many overlaps it took.

    A group's first asking member is its pivot. An asking member is looked up among the
    members whose distance to the pivot is within the radius of its own. In a group that is a whole
    cell, where all ask, the largest connected part needn't: any link that is left has an end outside it.
    """
    n = len(size)
    kinds, place = np.unique(group, return_inverse=True)
    asking = np.flatnonzero(asks)
    if not len(asking):
        return [], 0
    head = np.full(len(kinds), -1)
    head[place[asking[::-1]]] = asking[::-1]
    served = head[place] >= 0
    head = np.where(served, head[place], np.arange(n))
    held = Held(group, size, values)
    far = place * 4 + held.distance(head)  # groups lie apart, each in the order of distances
    rank = np.empty(n, np.int64)
    rank[np.argsort(far, kind="stable")] = np.arange(n)
    held.ordered(rank)
    along = np.sort(far)
    label, left, links, counted, turn = np.arange(n), asks.copy(), [], 0, 1
    while left.any():
        ask = np.flatnonzero(left)
        ask = ask[np.argsort(place[ask], kind="stable")]
        nth = np.arange(len(ask)) - np.searchsorted(place[ask], place[ask])
        ask = ask[nth < turn]  # some of each group, ever more of them
        left[ask] = False
        low = np.searchsorted(along, far[ask] - radius - _NEAR)
        high = np.searchsorted(along, far[ask] + radius + _NEAR, "right")
        for a, b, both in held.overlaps(ask, low, high):
            counted += len(a)
            good = held.linked(a, b, both) & (label[a] != label[b])
            a, b = a[good], b[good]
            _, one = np.unique(np.minimum(label[a], label[b]) * n + np.maximum(label[a], label[b]), return_index=True)
            parent: dict[int, int] = {}

            def root(x: int, parent=parent) -> int:
                while x in parent:
                    x = parent[x]
                return x

            for i in one:
                x, y = root(int(label[a[i]])), root(int(label[b[i]]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((int(a[i]), int(b[i])))
            new = np.arange(n)
            for x in parent:
                new[x] = root(x)
            label = new[label]
        # Who needn't ask: all of a group that is in one part, and the largest part of a whole cell.
        part, members = np.unique(place * n + label, return_counts=True)
        of = part // n
        best = np.lexsort((members, of))
        main = np.full(len(kinds), -1)
        main[of[best]] = part[best] % n  # the last of each group has the most
        alone = np.bincount(of, minlength=len(kinds)) == 1
        left &= ~(alone[place] | (whole & (label == main[place])))
        turn *= 2
    return links, counted


def distances(group: np.ndarray, size: np.ndarray, values: np.ndarray, pivot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(member, pivot, distance, linked) of members and the pivots of their groups at distances below 1."""
    held = Held(group, size, values)
    # Pivots come first in the order, so that a window holds them alone.
    rank = np.empty(len(size), np.int64)
    rank[np.argsort(~pivot, kind="stable")] = np.arange(len(size))
    held.ordered(rank)
    every = np.arange(len(size))
    for a, b, both in held.overlaps(every, np.zeros(len(size), np.int64), np.full(len(size), int(pivot.sum()))):
        yield a, b, np.where(a == b, 0.0, 1 - both / (size[a] + size[b] - both)), held.linked(a, b, both)


def _arrays(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Columns of a task's table as arrays, and its sets' sizes and values."""
    table = table.combine_chunks()
    lists = table.column("set").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    columns = {c: np.asarray(table.column(c).to_numpy(zero_copy_only=False)) for c in table.column_names if c != "set"}
    return columns, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).view(_U)


def _dealt(rows: DataFrame, sets: DataFrame, max_broadcast: int, volume: int, run, schema: str) -> DataFrame:
    """run() over rows (group, _tag, ..) with their sets, whole groups in a task and about TASK_SHINGLES shingles."""
    buckets = int(max(MIN_BUCKETS, volume // TASK_SHINGLES + 1))
    labels = F.array(*[F.lit(x) for x in bucket_labels(rows.sparkSession, buckets)])
    rows = rows.withColumn("bucket", F.get(labels, F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int")))
    few = rows.count() <= max_broadcast
    full = sets.select("_tag", "set").join(F.broadcast(rows) if few else rows, "_tag")

    def once(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return full.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(once, schema)


def links_inside(rows: DataFrame, sets: DataFrame, max_broadcast: int, volume: int) -> DataFrame:
    """(a, b): links that connect what the links of asking members do. rows: (group, _tag, asks, whole)."""

    def run(table: pa.Table) -> pa.Table:
        c, size, values = _arrays(table)
        links, _ = joined(c["group"], size, values, c["asks"].astype(bool), c["whole"].astype(bool))
        tag = c["_tag"]
        return pa.table({"a": pa.array([tag[x] for x, _ in links], pa.int64()), "b": pa.array([tag[y] for _, y in links], pa.int64())})

    return _dealt(rows, sets, max_broadcast, volume, run, "a long, b long")


_NEAR_TYPE = "array<struct<d: double, p: bigint, linked: boolean>>"


def nearest(rows: DataFrame, sets: DataFrame, max_broadcast: int, volume: int) -> DataFrame:
    """(group, _tag, near): each member's pivots at a distance below 1, the nearest first. rows: (group, _tag, is_pivot, is_member)."""

    def run(table: pa.Table) -> pa.Table:
        c, size, values = _arrays(table)
        parts = list(distances(c["group"], size, values, c["is_pivot"].astype(bool)))
        a, b, d, good = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(4))
        a, b = a.astype(np.int64), b.astype(np.int64)
        tag = c["_tag"]
        order = np.lexsort((tag[b], d, a))
        order = order[c["is_member"].astype(bool)[a[order]]]
        a, b, d, good = a[order], b[order], d[order], good[order]
        members, begins = np.unique(a, return_index=True)
        kind = pa.struct([("d", pa.float64()), ("p", pa.int64()), ("linked", pa.bool_())])
        inner = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(tag[b], pa.int64()), pa.array(good.astype(bool))], fields=list(kind))
        offsets = pa.array(np.append(begins, len(a)).astype(np.int32))
        return pa.table({"group": pa.array(c["group"][members], pa.int64()), "_tag": pa.array(tag[members], pa.int64()), "near": pa.ListArray.from_arrays(offsets, inner)})

    return _dealt(rows, sets, max_broadcast, volume, run, f"group long, _tag long, near {_NEAR_TYPE}")


def _shares(of, *by: str):
    """A number of 0 to 1 for each row."""
    return F.pmod(F.xxhash64(F.lit(of), *by), F.lit(1 << 52)) / float(1 << 52)


def _beside(df: DataFrame, name: str, max_broadcast: int) -> DataFrame:
    """A table of groups for a join with their rows: sent to all tasks if it has few rows, so that rows of a large group needn't meet."""
    rows = saved(df, name)
    return F.broadcast(rows) if rows.count() <= max_broadcast else rows


def split(large: DataFrame, near: DataFrame, named: DataFrame, mains: DataFrame, max_broadcast: int, task_shingles: int) -> DataFrame:
    """The regions that split regions fall into: (region, cell, _tag, n, asks, before).

    large: (region, cell, _tag, n, asks, is_pivot, v); near as nearest() has it; mains: the part
    of each cell that doesn't ask. A pivot has been compared with all and asks no more. Members that
    ask live in the region of their nearest pivot, or in that of the far ones. If x links with y, which lives at
    a pivot at distance d, x is there at d - RADIUS to d + RADIUS, and at most 2 * RADIUS farther than
    at its own nearest; the least and the greatest d of those who live there make the window.
    """
    reach = 1 - RADIUS  # beyond it some x may have nothing in common with the pivot
    rows = large.join(near, ["region", "_tag"], "left").join(named, "_tag").join(mains, "cell")
    best = F.coalesce(F.get("near", F.lit(0))["d"], F.lit(1.0))
    rows = rows.withColumn("best", best).withColumn("asks", F.col("asks") & ~F.col("is_pivot") & (F.col("c") != F.col("main")))
    far = F.xxhash64("region", F.lit("far"))
    rows = saved(rows.withColumn("own", F.when(F.col("best") < reach, F.xxhash64("region", F.get("near", F.lit(0))["p"])).otherwise(far)), "rows")
    lives = rows.filter("asks").groupBy("region", F.col("own").alias("home")).agg(F.min("best").alias("lo"), F.max("best").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("c").alias("c_least"), F.max("c").alias("c_most"))
    lives = _beside(lives, "lives", max_broadcast)
    places = F.concat(F.transform(F.coalesce("near", F.array().cast(_NEAR_TYPE)), lambda x: F.struct(x["d"].alias("d"), F.xxhash64("region", x["p"]).alias("home"))), F.array(F.struct(F.col("best").alias("d"), far.alias("home"))))
    copies = rows.select("region", "cell", "_tag", "n", "asks", "c", "best", "own", "v", F.explode(places).alias("x")).select("*", "x.d", "x.home").drop("x")
    copies = copies.join(lives, ["region", "home"])
    inside = (F.col("d") >= F.col("lo") - RADIUS - _NEAR) & ((F.col("home") == far) | ((F.col("d") <= F.col("hi") + RADIUS + _NEAR) & (F.col("d") <= F.col("best") + 2 * RADIUS + _NEAR)))
    sizes = (F.col("n") * 100 >= F.col("least") * PERCENT) & (F.col("n") * PERCENT <= F.col("most") * 100)
    asks = F.col("asks") & (F.col("own") == F.col("home"))
    open_ = asks | (F.col("c_least") != F.col("c_most")) | (F.col("c") != F.col("c_least"))
    copies = saved(copies.filter(inside & sizes & open_).select("region", "home", "cell", "_tag", "n", asks.alias("asks"), F.col("v").alias("before")), "copies")
    # What windows hardly make smaller isn't copied for each pivot but stays together.
    volume = saved(copies.groupBy("region", "home", "before").agg(F.sum("n").alias("now")), "volume")
    fits, small = F.col("now") <= task_shingles, F.col("now") <= SHRUNK * F.col("before")
    total = volume.filter(~fits & small).groupBy("region").agg(F.sum("now").alias("total"))
    alike = ~fits & (~small | (F.col("total") > COPIES * F.col("before")))
    copies = copies.join(_beside(volume.join(total, "region", "left").select("region", "home", alike.alias("alike")), "alike", max_broadcast), ["region", "home"])
    apart = copies.filter(~F.col("alike")).select(F.col("home").alias("region"), "cell", "_tag", "n", "asks", "before")
    rest = copies.filter("alike").groupBy(F.xxhash64("region", F.lit("alike")).alias("region"), "cell", "_tag", "n", "before").agg(F.max("asks").alias("asks"))
    return apart.unionByName(rest)


def joined_classes(sets: DataFrame, pivots: int, max_broadcast: int, task_shingles: int) -> DataFrame:
    """(_tag, c): each class of a cell and the least class that links lead to."""
    cells = saved(cells_of(sets), "members")
    named = cells.select("_tag", F.col("_tag").alias("c"))
    open_ = cells.select(F.col("cell").alias("region"), "cell", "_tag", "n", F.lit(True).alias("asks"), F.lit(True).alias("whole"), F.lit(None).cast("long").alias("before"))
    mains = None
    while True:
        v = open_.groupBy("region").agg(F.sum("n").alias("v"), F.sum(F.col("asks").cast("long")).alias("q"), F.min(F.when(F.col("asks"), _shares("pivot", "_tag"))).alias("u")).filter("q > 0")
        open_ = saved(open_.join(_beside(v, "sizes", max_broadcast), "region"), "open")
        fits, stuck = F.col("v") <= task_shingles, F.coalesce(F.col("v") > SHRUNK * F.col("before"), F.lit(False))
        volume, some_large, some_stuck = open_.agg(F.sum(F.when(fits, F.col("n"))), F.sum(F.when(~fits & ~stuck, F.col("n"))), F.sum(F.when(~fits & stuck, F.col("n")))).first()
        if volume is None and some_large is None and some_stuck is None:
            return named
        ties = []
        if volume:
            ties.append(links_inside(open_.filter(fits).select(F.col("region").alias("group"), "_tag", "asks", "whole"), sets, max_broadcast, volume))
        chunks = F.greatest(F.ceil(F.col("v") / task_shingles), F.lit(MIN_BUCKETS))
        own = F.pmod(F.xxhash64("_tag", F.lit("chunk")), chunks)
        every = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
        later = []
        if some_stuck:
            # Some blocks of asking members against all members, which are dealt in chunks.
            rows = open_.filter(~fits & stuck).withColumn("turn", F.col("asks") & ((_shares("turn", "_tag", "q") < BLOCKS * BLOCK_MEMBERS / F.col("q")) | (_shares("pivot", "_tag") == F.col("u"))))
            rows = saved(rows.withColumn("chunk", own).withColumn("block", F.pmod(F.xxhash64("_tag", F.lit("block")), F.lit(BLOCKS))), "stuck")
            group = F.xxhash64("region", "chunk", "block").alias("group")
            members = rows.select("region", "chunk", "_tag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias("block"), F.lit(False).alias("asks"))
            asking = rows.filter("turn").select("region", every.alias("chunk"), "_tag", "block", F.lit(True).alias("asks"))
            sent = members.unionByName(asking).groupBy(group, "_tag").agg(F.max("asks").alias("asks"))
            ties.append(links_inside(sent.withColumn("whole", F.lit(False)), sets, max_broadcast, BLOCKS * some_stuck))
            later.append(rows.withColumn("asks", F.col("asks") & ~F.col("turn")).select("region", "cell", "_tag", "n", "asks", "before"))
        near = None
        if some_large:
            share = F.least(F.lit(1.0), pivots / F.col("q"))
            is_pivot = F.col("asks") & ((_shares("pivot", "_tag") < share) | (_shares("pivot", "_tag") == F.col("u")))
            large = saved(open_.filter(~fits & ~stuck).withColumn("is_pivot", is_pivot).withColumn("chunk", own), "large")
            members = large.select("region", "chunk", "_tag", "is_pivot", F.lit(True).alias("is_member"))
            pivot = large.filter("is_pivot").select("region", every.alias("other"), "chunk", "_tag").filter("other <> chunk").select("region", F.col("other").alias("chunk"), "_tag", F.lit(True).alias("is_pivot"), F.lit(False).alias("is_member"))
            sent = members.unionByName(pivot).withColumn("group", F.xxhash64("region", "chunk")).drop("chunk")
            regions = _beside(large.select("region", F.xxhash64("region", "chunk").alias("group")).distinct(), "groups", max_broadcast)
            near = saved(nearest(sent.drop("region"), sets, max_broadcast, some_large).join(regions, "group").drop("group"), "near")
            found = near.select("_tag", F.explode(F.filter("near", lambda x: x["linked"])).alias("x"))
            ties.append(found.select(F.col("_tag").alias("a"), F.col("x.p").alias("b")).filter("a <> b"))
        links = saved(_union(ties), "links")
        tied = links.join(named.toDF("a", "ca"), "a").join(named.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        named = saved(_renamed(named, "c", saved(components(tied), "found")), "named")
        if near is not None:
            # The part of a cell that doesn't ask is chosen once, the largest; it only ever grows.
            fresh = large.select("cell", "_tag").join(named, "_tag").groupBy("cell", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("cell").agg(F.max_by("c", F.struct("m", "c")).alias("first"))
            mains = saved(fresh if mains is None else mains.unionByName(fresh.join(mains, "cell", "left_anti")), "mains")
        if mains is None:
            return named
        now = mains.join(named, mains["first"] == named["_tag"]).select("cell", F.col("c").alias("main"))
        now = _beside(now, "now", max_broadcast)
        later = [x.join(now, "cell").join(named, "_tag").select("region", "cell", "_tag", "n", (F.col("asks") & (F.col("c") != F.col("main"))).alias("asks"), "before") for x in later]
        if near is not None:
            later.append(split(large.select("region", "cell", "_tag", "n", "asks", "is_pivot", "v"), near, named, now, max_broadcast, task_shingles))
        if not later:
            return named
        open_ = saved(_union(later).withColumn("whole", F.lit(False)), "regions")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bucket_rows: int = BUCKET_ROWS, max_broadcast: int = MAX_BROADCAST, pivots: int = PIVOTS, task_shingles: int = REGION_SHINGLES, with_tags: bool = False) -> DataFrame:
    """df with `n_shingles` and `component_id`, the least id that links lead to.

    Words are what stands between ASCII blanks, A-Z in lower case; a set has the distinct
    sequences of k words, or the whole of a shorter text. Texts without words, and null,
    have an empty set and link with nothing. Rows with a null id link with nothing and
    have a null component. Rows that share an id share a component only if their texts
    link. An empty df gives no rows. Columns of the new names are replaced; all others stay,
    but for the text. with_tags adds `_tag`, which names a row's set, and `_c`, which names
    its component, also where components of different texts have the same least id.
    """
    ready(df.sparkSession)
    new = ["n_shingles", "component_id", *(["_tag", "_c"] if with_tags else [])]
    keep = [c for c in others(df, new) if c != text_col]
    rows = df.select(packed(keep), exact(id_col).alias("_id"), exact(text_col).alias("_t"))
    # Without the text: the sketches are read several times, the text twice.
    marked = saved(sketches(rows, "_t", k, keep_text=False), "sketches", keep=True)
    known = marked.filter(F.col("_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = saved(known.groupBy("_tag", "n_shingles").agg(F.min("_id").alias("_rep")), "classes", keep=True)
    usable = rows.select("_id", "_t").filter(F.col("_id").isNotNull())
    with passing(df.sparkSession):
        chosen = saved(survivors(usable, classes, "_t", k, bucket_rows), "survivors")
        sets = saved(sets_of(usable, chosen, "_id", "_t", k, max_broadcast), "sets")
        found = saved(joined_classes(sets, pivots, max_broadcast, task_shingles), "found", keep=True)
    named = classes.join(found, "_tag", "left").select("_tag", "n_shingles", "_rep", F.coalesce("c", "_tag").alias("_c"))
    with passing(df.sparkSession):
        least = saved(named.groupBy("_c").agg(F.min("_rep").alias("component_id")), "least")
        named = saved(named.join(least, "_c").select("_tag", "n_shingles", "_c", "component_id"), "classes", keep=True)
    out = marked.join(named, ["_tag", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") > 0, F.when(F.col("_id").isNotNull(), F.col("component_id"))).otherwise(F.col("_id"))
    return out.select(*unpacked(keep), "n_shingles", own.alias("component_id"), *new[2:])


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under links of at least 75 % of five-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH RECURSIVE
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM dw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM reach r JOIN either e ON e.x = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
