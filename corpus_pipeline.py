"""The corpus pipeline: documents to packed sequences, in five stages that each call one operator.

Every stage takes the rows its predecessor kept (the columns of documents) and works on all of them:

1. language_id: null texts and texts without a letter go; there is no threshold for languages that were not learned.
2. line_dedup: later repeated runs of lines are cut; a document of which nothing is left goes. Copies of a document
   of one line are left to the third stage, which keeps one of them.
3. near_dedup: of each class of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.
4. source_mix: every document is taken whole, as often as the mix of its source says: not at all, once or twice.
5. packing: sequences of at most 2048 tokens; this stage returns the pieces.

Cases: an empty table passes through all stages; null texts are rejected by the first; in the third, rows whose id is
null or shared are documents of their own by id and text (null ids come first in a class), and of rows alike in both
one stays; columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, langid, lines, mixing, packing
from ledgerloom.llm.common import Renamed, checkpointed

WORDS, PERCENT = 5, 80
SEQUENCE = 2048

#: The stages need suffix automata, winnowing and a tokenizer.
ORACLE_SQL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Renamed.of(docs)
    model = langid.learn(own.df, F.lit(True), own["doc_id"], own["text"], own["lang"])
    return own.back(langid.with_language(own.df, model, own["text"]).where(F.col("lang_pred") != langid.UNDETERMINED))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Renamed.of(docs)
    left = lines.dedup_lines(own.df, id_col=own["doc_id"], text_col=own["text"], copies=False).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        left = left.withColumn(own["n_chars"], F.length(own["text"]).cast("long"))
    return own.back(left)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with a key of its own in _key: the id, or where that is null or shared a hash of id and text."""
    own = F.xxhash64(doc_id, text)
    shared = checkpointed(docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_shared")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    n = shared.count()
    if not n:
        return docs.withColumn("_key", F.coalesce(doc_id, own))
    marked = docs.join(F.broadcast(shared) if n <= 50_000 else shared, F.col(doc_id) == F.col("_shared"), "left")
    return marked.withColumn("_key", F.when(F.col("_shared").isNull(), F.col(doc_id)).otherwise(own)).withColumn("_key", F.coalesce("_key", own)).drop("_shared")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = Renamed.of(docs)
    doc_id, text = own["doc_id"], own["text"]
    named = keyed(own.df, doc_id, text)
    found = jaccard.near_duplicates(named, WORDS, PERCENT, id_col="_key", text_col=text).select(F.col("doc_id").alias("_key"), "component_id")
    least = F.min(F.struct(F.col(doc_id).alias("_id"), "_key"))
    kept = found.join(named.select("_key", doc_id), "_key").groupBy("component_id").agg(least.alias("_least")).select(F.col("_least._key").alias("_key"))
    one = Window.partitionBy("_key").orderBy(text)
    return own.back(named.join(kept, "_key", "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_whole(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE, ranks=(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
