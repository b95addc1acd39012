"""The queries of the operators: each over the whole of its table, with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import wavelet
from codeloom.llm.bestfit import best_fit, token_pieces
from codeloom.llm.conversations import repair_conversations, repaired_digests
from codeloom.llm.decontaminate import find_leaks
from codeloom.llm.embeddings import near_duplicates
from codeloom.llm.jaccard import jaccard_components
from codeloom.llm.languages import identify_languages
from codeloom.llm.packing import pack_documents
from codeloom.llm.quality import score_quality
from codeloom.llm.resampling import resample
from codeloom.llm.sharding import shard_documents
from codeloom.llm.storage import held_out, materialize, shared_folder
from codeloom.llm.token_counts import count_tokens
from codeloom.llm.urls import judge_urls

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
QUALITY = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(path: str | None = None) -> str:
    """The content of a tokenizer's file, which travels to the executors."""
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        return file.read()


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_languages(docs.select("doc_id", "text"), train=docs)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own that is empty at first, so that its result and cost don't depend on what ran before."""
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer(), shared_folder(spark, "token-counts"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def packed(docs: DataFrame) -> DataFrame:
    return pack_documents(docs, tokenizer()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= QUALITY).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = wavelet.fresh_folder(spark)
    wavelet.write_ids(table(spark, sf_dir, "documents"), tokenizer(), folder)
    return wavelet.read_ids(spark, folder).select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that depend on ``conv_id:turn`` only: rows dropped, emptied, cut, repeated or said by the user. Nulls are one space."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, repaired = repair_conversations(damaged(rows))
    report, hashed = report.withColumnRenamed("conv_id", "c"), repaired_digests(repaired).withColumnRenamed("conv_id", "h")
    found = rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(hashed, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer())
    return best_fit(materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[F.col("__" + c).alias(c) for c in ("n_features", "weight", "score", "rank")])


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_ngram_jaccard, op3_language_id, op4_token_counts, op5_url_filters, op6_packing, op7_quality,
                                   op8_sharding, op9_embedding_dedup, op10_token_files, op11_conversation_repair, op12_best_fit, op13_resampling)}
