"""Sharding along a Hilbert curve (native).

Several metadata columns are quantised to a few bits each, the cell's index on the
Hilbert curve orders the rows, and runs of that order become shards. Neighbours on
the curve are neighbours in every dimension, so a shard covers a small box of the
metadata space and a manifest of boxes lets a reader skip files on any dimension.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, others, packed, passing, ranked, saved, unpacked

BITS = 5
N_SHARDS = 8


def category(col: Column, bits: int = BITS) -> Column:
    """Quantise a label of any type to one of up to 256 cells by its MD5. Null has cell 0, as has whatever hashes there."""
    first = F.conv(F.substring(F.md5(col.cast("string").cast("binary")), 1, 2), 16, 10).cast("int")
    return F.coalesce(first % (1 << bits), F.lit(0))


def magnitude(col: Column, bits: int = BITS) -> Column:
    """Quantise a whole number by its octave, fewer bits by several octaves at once; null and numbers below 1 have cell 0."""
    octave = F.length(F.bin(F.greatest(col.cast("long"), F.lit(1)))) - 1
    return F.coalesce(F.least(F.floor(octave / max(1, 32 >> bits)).cast("int"), F.lit((1 << bits) - 1)), F.lit(0))


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve, by array functions alone.

    The coordinates are turned level by level from the top (a reflection or an
    exchange of axes each), Gray-coded, and their bits interleaved.
    """
    n = len(dims)
    turns = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        own = F.element_at(x, step["i"] + 1)
        hit = own.bitwiseAND(step["q"]) != 0
        swap = F.element_at(x, 1).bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when(k == 0, F.when(hit, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(swap)))
            .when((k == step["i"]) & ~hit, v.bitwiseXOR(swap))
            .otherwise(v),
        )

    turned = F.aggregate(turns, F.array(*[d.cast("int") for d in dims]), turn) if bits > 1 else F.array(*dims)

    def coded(x: Column) -> Column:
        grays = F.transform(x, lambda _, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
        last = F.element_at(grays, -1)
        flip = F.aggregate(
            F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array(F.lit(0)),
            F.lit(0),
            lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a),
        )
        return F.transform(grays, lambda g: g.bitwiseXOR(flip))

    def woven(x: Column) -> Column:
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(
            order,
            F.lit(0).cast("long"),
            lambda a, s: a * 2 + F.when(F.element_at(x, s["i"] + 1).bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(bits)]), s["b"] + 1)) != 0, 1).otherwise(0),
        )

    # One-element arrays keep each step's value in a variable instead of repeating its expression.
    return F.element_at(F.transform(F.transform(F.array(turned), coded), woven), 1)


def shard_by_hilbert(df: DataFrame, dims: dict[str, Column], ties: list[Column], n_shards: int = N_SHARDS, bits: int = BITS) -> DataFrame:
    """df with a cell column per dimension, `hilbert`, `shard` and `slot`.

    dims: name of the cell column to quantised expression. ties orders the rows of a
    cell and should tell rows apart, since a cell may hold a third of them. Shards
    are runs whose row counts differ by at most one; slots number a shard's rows
    from 0. With fewer rows than shards the last shards are empty. Existing columns
    of these names are replaced, all others stay, whatever their names. An empty df gives no rows.
    """
    keep = others(df, [*dims, "hilbert", "shard", "slot"])
    cells, by = [f"_d{i}" for i in range(len(dims))], [f"_t{i}" for i in range(len(ties))]
    rows = df.select(packed(keep), *[e.alias(c) for e, c in zip(dims.values(), cells, strict=True)], *[t.alias(c) for t, c in zip(ties, by, strict=True)])
    # Written once: the range partitioning reads its input twice, and the index is dear.
    with passing(df.sparkSession):
        rows = saved(rows.withColumn("_h", hilbert_index([F.col(c) for c in cells], bits)), "curve")
        placed = ranked(rows, [F.col("_h"), *map(F.col, by)])
        small, larger = divmod(rows.count(), n_shards)  # the first `larger` shards have one row more
    edge = larger * (small + 1)
    rank = F.col("_rank")
    head = F.floor(rank / (small + 1)).cast("int")
    tail = F.floor((rank - edge) / max(small, 1)).cast("int") + larger
    first = F.when(rank < edge, F.col("_shard") * (small + 1)).otherwise(edge + (F.col("_shard") - larger) * small)
    out = placed.select("_row._row", *[F.col("_row")[c].alias(c) for c in [*cells, "_h"]], "_rank", F.when(rank < edge, head).otherwise(tail).alias("_shard"))
    return out.select(*unpacked(keep), *[F.col(c).alias(n) for c, n in zip(cells, dims, strict=True)], F.col("_h").alias("hilbert"), F.col("_shard").alias("shard"), (rank - first).cast("long").alias("slot"))


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """A row per shard: its rows, and least and greatest cell of each dimension."""
    boxes = [f(c).alias(f"{c}_{n}") for c in dims for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *boxes)


def prune(boxes: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Shards of a manifest that can hold rows of the wanted cells."""
    tests = [(F.col(f"{c}_min") <= v) & (F.col(f"{c}_max") >= v) for c, v in wanted.items()]
    return boxes.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def write_shards(sharded: DataFrame, dims: list[str], folder: str) -> None:
    """Each shard as a folder of files below folder/data, and the boxes of all as folder/manifest."""
    sharded.write.partitionBy("shard").parquet(f"{folder}/data")
    manifest(sharded.sparkSession.read.parquet(f"{folder}/data"), dims).coalesce(1).write.parquet(f"{folder}/manifest")


def read_cells(spark: SparkSession, folder: str, wanted: dict[str, int]) -> DataFrame:
    """Rows of the wanted cells, from the files of those shards alone whose boxes can hold them."""
    boxes = spark.read.parquet(f"{folder}/manifest")
    shards = [r["shard"] for r in prune(boxes, wanted).select("shard").collect()]  # a number for each shard
    own = reduce(lambda a, b: a & b, [exact(c) == v for c, v in wanted.items()], F.lit(True))
    every = spark.read.option("basePath", f"{folder}/data")
    if not shards:
        return every.parquet(f"{folder}/data").limit(0)
    return every.parquet(*[f"{folder}/data/shard={k}" for k in sorted(shards)]).filter(own)


def op2_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 along the curve of language, source and size (law: rows)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        "lang",
        "source",
    )
    dims = {"lang_cell": category(F.col("lang")), "source_cell": category(F.col("source")), "size_cell": magnitude(F.col("size"))}
    out = shard_by_hilbert(rows, dims, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", *dims)


def _sql_curve(source: str, bits: int = BITS) -> str:
    """CTEs `curve`, which give rows (.., x0, x1, x2) of source their `hilbert`: the same turns, Gray code and weave in SQL."""
    out, before, n = [], source, 3
    for k, (b, i) in enumerate((b, i) for b in range(bits - 1, 0, -1) for i in range(n)):
        q, low = 1 << b, (1 << b) - 1
        swap = f"xor(x0, x{i}) & {low}"
        first = f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {swap}) END AS x0"
        other = [] if i == 0 else [f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}"]
        out.append(f"h{k} AS (SELECT * REPLACE ({', '.join([first, *other])}) FROM {before})")
        before = f"h{k}"
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN g2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    woven = " + ".join(f"((xor(g{i}, f) >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits) for i in range(n))
    out.append(f"gray AS (SELECT *, x0 AS g0, xor(x0, x1) AS g1, xor(xor(x0, x1), x2) AS g2 FROM {before})")
    out.append(f"flipped AS (SELECT *, {flip} AS f FROM gray)")
    out.append(f"curve AS (SELECT *, ({woven})::BIGINT AS hilbert FROM flipped)")
    return ",\n".join(out)


# The CRC-32 goes byte by byte, over a table of the polynomial's remainders that is computed here too.
OP2_SQL = f"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
bytes AS (SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 1 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
d AS (SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
  coalesce(('0x' || md5(lang)[:2])::INT % 32, 0) AS lang_cell, coalesce(('0x' || md5(source)[:2])::INT % 32, 0) AS source_cell, least(length(bin(size)) - 1, 31)::INT AS size_cell
  FROM bytes, crc),
cells AS (SELECT *, lang_cell AS x0, source_cell AS x1, size_cell AS x2 FROM d),
{_sql_curve('cells')},
ranked AS (SELECT *, row_number() OVER (ORDER BY hilbert, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () // 8 AS small, count(*) OVER () % 8 AS larger FROM curve),
placed AS (SELECT *, CASE WHEN r < larger * (small + 1) THEN r // (small + 1) ELSE larger + (r - larger * (small + 1)) // greatest(small, 1) END AS s FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, s::INT AS shard,
       (r - CASE WHEN s < larger THEN s * (small + 1) ELSE larger * (small + 1) + (s - larger) * small END)::BIGINT AS slot,
       NULL::INT AS grown_shard, hilbert, lang_cell::INT AS lang_cell, source_cell::INT AS source_cell, size_cell
FROM placed
"""
