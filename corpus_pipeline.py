"""From raw documents to packed training sequences: five stages, each on all that the one before kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm.decontaminate import remove_leaks
from codeloom.llm.jaccard import keep_one
from codeloom.llm.languages import identify_languages
from codeloom.llm.quality import score_quality
from codeloom.llm.queries import QUALITY, packed
from codeloom.llm.storage import free_prefix, shared_folder

LEAST_SHARE = 0.5   # of a document's letters that must be in spans of its language


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents vote for. Null and empty texts get the general share and stay."""
    prefix = free_prefix(docs.columns)
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), prefix=prefix)
    return scored.where(F.col(prefix + "score") >= QUALITY).select(*docs.columns)


def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, at least half of them in one language. Null, empty and letterless texts go."""
    prefix = free_prefix(docs.columns)
    found = identify_languages(docs, prefix=prefix)
    return found.where((F.col(prefix + "lang") != "und") & (F.col(prefix + "score") >= LEAST_SHARE)).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that of the smallest id."""
    return keep_one(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 token ids."""
    return packed(docs)


STAGES = [("quality", good_quality), ("language", one_language), ("near copies", without_near_copies), ("benchmark", without_benchmark),
          ("packing", packed_sequences)]
ORACLE_SQL = None   # models and tokenizers aren't SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
