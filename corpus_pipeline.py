"""From raw documents to token ids: five stages, each written as Parquet and read again.

A stage is (name, function of (spark, docs, sf_dir)). All but the last return the columns
of `documents`; a text that a stage changes has its n_chars changed with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality_forest
from rillstone.llm.common import saved

#: Ids of kept documents (8 bytes each) that are broadcast.
MAX_BROADCAST = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the forest, which learns from `labels` of these documents."""
    forest, threshold = quality_forest.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_forest.judge(docs, forest, threshold).filter("kept").select(*COLUMNS)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least five share. Emptied ones stay, and null texts stay null."""
    rows = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return rows.withColumns({"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component of near copies. Rows without an id are in none and stay."""
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"), with_tags=True).filter(F.col("doc_id").isNotNull())
    leads = F.col("component_id") == F.col("doc_id")
    first = saved(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(leads).alias("leads")).filter("leads > 0"), "first")
    once = first.filter("rows = 1").select("doc_id")
    few = once.count() <= MAX_BROADCAST  # else texts are shuffled by id
    kept = docs.join(F.broadcast(once) if few else once, "doc_id", "left_semi").select(*COLUMNS)
    again = first.filter("rows > 1").select("doc_id")
    if again.take(1):
        kept = kept.unionByName(_of_repeated_ids(docs.join(again, "doc_id", "left_semi"), found.filter(leads).join(again, "doc_id", "left_semi")))
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def _of_repeated_ids(docs: DataFrame, leading: DataFrame) -> DataFrame:
    """One row of each component that leading rows are in; of texts without words, each once an id.

    An id doesn't say which of its texts leads, so texts are told apart by their sets.
    """
    rows = jaccard_join.sketches(docs.withColumn("_t", F.col("text")), "_t")
    chosen = leading.filter("n_shingles > 0").groupBy("_c").agg(F.min(F.struct("doc_id", "_tag")).alias("l")).select("l.*")
    one = rows.filter("n_shingles > 0").join(chosen, ["doc_id", "_tag"]).groupBy("doc_id", "_tag").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return one.unionByName(rows.filter("n_shingles = 0").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in windows of `benchmark`."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed, little-endian 32 bits) of each text, with the digests of ids and of decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, with_decoded=True)
    return back.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", without_shared_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_contaminated),
    ("byte_bpe", tokenised),
]

#: SQL has no isolation forest; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
