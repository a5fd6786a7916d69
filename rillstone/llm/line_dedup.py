"""Removal of lines that many documents share (native).

Normalised lines are exploded and hashed, distinct documents are counted per hash,
and each text is put together again, in the order of its lines, without those over
the threshold.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact, others, packed, saved, unpacked

MIN_CHARS = 40
MIN_DOCS = 5
#: Shared keys (24 bytes each) that are broadcast; more of them are joined by a shuffle.
MAX_BROADCAST = 500_000
#: Parts of a key's documents where keys are joined by a shuffle.
SALTS = 16
BLANKS = " \t\n\x0b\f\r"


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, all other characters as they are.

    lower() does just that where a string holds bytes below 0x80 only, and is far
    faster than a character map.
    """
    mapped = F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(mapped)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits that stand for a key: two 64-bit hashes with unrelated seeds."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("rillstone"), key).alias("b"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """df with `kept_text`, `n_lines` and `n_dropped`.

    A key of at least min_chars code points found in at least min_docs distinct ids
    loses its lines everywhere but in the greatest id that holds it, which keeps all
    of them. Null text counts as empty: one empty line. Rows that share an id are one
    document here, and each of them is cleaned by what that id loses. Rows with a
    null id are left whole and count for no key. Other columns stay as they are; the
    three new ones replace columns of the same names.
    """
    long = lambda x: F.length(F.btrim(x, F.lit(BLANKS))) >= min_chars
    text = F.coalesce(exact(text_col), F.lit(""))
    split = F.split(text, "\n", -1)
    # Rows of one id may have different texts; the text's hash tells their positions apart.
    placed = F.filter(F.transform(split, lambda x, i: F.when(long(x), F.struct(i.alias("pos"), key_hash(line_key(x)).alias("h")))), lambda x: x.isNotNull())
    held = df.select(exact(id_col).alias("_id"), F.xxhash64(text).alias("_v"), F.explode(placed).alias("_x")).filter(F.col("_id").isNotNull())
    held = saved(held.select("_id", "_v", "_x.pos", "_x.h.a", "_x.h.b"), "held")
    # The first grouping spreads a hot key over its documents, the second gets a row for each task and key.
    shared = held.select("_id", "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last")).filter(F.col("_n") >= min_docs)
    shared = saved(shared.select("a", "b", "_last"), "shared")
    few = shared.count() <= max_broadcast
    if not few:  # a hot key's rows in SALTS parts, each with a copy of the key
        held = held.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
        shared = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    loses = held.join(F.broadcast(shared) if few else shared, ["a", "b", *([] if few else ["_salt"])]).filter(F.col("_id") != F.col("_last"))
    loses = loses.select("_id", "_v", "pos").distinct().groupBy("_id", "_v").agg(F.sort_array(F.collect_list("pos")).alias("_gone"))

    keep = others(df, ["kept_text", "n_lines", "n_dropped"])
    rows = df.select(packed(keep), exact(id_col).alias("_key"), F.xxhash64(text).alias("_w"), split.alias("_lines"))
    # Null ids lose nothing; the text's hash spreads them over tasks.
    rows = rows.join(loses, (F.col("_key") == F.col("_id")) & (F.col("_w") == F.col("_v")), "left")
    # What stays are the runs between lost positions.
    ends = F.concat("_gone", F.array(F.size("_lines")))
    before = lambda i: F.coalesce(F.get("_gone", i - 1), F.lit(-1))
    runs = F.flatten(F.transform(ends, lambda e, i: F.slice("_lines", F.when(i > 0, before(i)).otherwise(-1) + 2, e - F.when(i > 0, before(i)).otherwise(-1) - 1)))
    rows = rows.withColumn("_kept", F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(runs))
    return rows.select(*unpacked(keep), F.array_join("_kept", "\n").alias("kept_text"), F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u),
hot AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id <> h.last AS gone FROM lines l LEFT JOIN hot h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
