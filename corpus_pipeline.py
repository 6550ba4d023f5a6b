"""Training-data pipeline: language ID, near-duplicates, decontamination, personal data, BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept, and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.

Defined results: documents without any letter, and those that no learned
language fits, go in the first stage; of each group of near-copies the one
with the least doc_id stays in the second (null last; documents that only share
a doc_id, or have none, are no copies, and rows equal in all columns are one);
contaminated documents go in the third; the fourth changes text and n_chars;
empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textstrata.llm import bpe, decontamination, jaccard, language, pii
from textstrata.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if its best language gets less than this.
LEAST_SCORE = 0.5
#: Near-copies share this percentage of their shingles of so many words; op4's own contract binds its query only.
NEAR_SIZE, NEAR_PERCENT = 5, 80

#: The language network and EM classifier are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best language has a mean probability of ``LEAST_SCORE`` or more over their letters; those without letters go."""
    model = language.train(language.training_rows(docs))
    told = language.identify(docs, model)
    return told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that of the least doc_id, null last."""
    keyed = docs.withColumn("_key", F.xxhash64(*COLUMNS))
    groups = jaccard.near_groups(keyed, "_key", size=NEAR_SIZE, percent=NEAR_PERCENT).select("_key", "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key"))
    heads = keyed.select("doc_id", "_key").join(groups, "_key").groupBy("component_id").agg(least.alias("head")).select(F.col("head._key").alias("_key"))
    # rows of one key are equal in all columns
    once = Window.partitionBy("_key").orderBy("doc_id")
    return keyed.join(heads, "_key", "left_semi").withColumn("_n", F.row_number().over(once)).filter("_n = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a hit of any benchmark item."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    hit = decontamination.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_key").filter("n_hit > 0").select("_key")
    return keyed.join(hit, "_key", "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by [KIND] and n_chars counted anew."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with digests of the ids and of the decoded bytes."""
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
