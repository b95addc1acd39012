"""Token counts through a cache of content digests."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.tokens import encoder_of, version_of


def counter(content):
    def run(batches):
        encoder = encoder_of(content)
        for batch in batches:
            counts = np.concatenate([np.zeros(0, np.int64), *(np.diff(ends) for _, _, ends in encoder.encode(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["digest", "n_tokens"])
    return run


def read_cache(spark, cache: str, version: str) -> DataFrame | None:
    """Stored counts of a tokenizer version: one row per digest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("digest binary, n_tokens bigint").parquet(f"{cache}/version={version}")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id`` under its own name, ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``tokenizer`` is the content of a tokenizer's file. A text's digest is joined to the counts stored below ``cache`` (a folder that all
    executors share) for this version of the tokenizer; of the texts that are not stored, each distinct one is encoded once, and its count
    is appended. Content is the text itself: byte-level tokenizers normalise nothing, so no other text has surely the same count. Null is the
    empty text.

    Equal texts are put together before texts are moved, so a text with very many copies moves once per task. A lost executor repeats its
    part; an append is seen whole or not at all. Two runs that append at once may both store a digest; the next run's read
    takes one of them, as counts of one version are equal. Other columns are ignored; repeated rows each get a row. Very long texts are encoded whole;
    an empty table gives no rows and appends nothing.
    """
    spark = docs.sparkSession
    version = version_of(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id), F.octet_length(content).cast("bigint").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"))
    missing = keyed.select("digest", "content").dropDuplicates(["digest"])
    stored = read_cache(spark, cache, version)
    if stored is not None:
        missing = missing.join(stored, "digest", "left_anti")
    encoded = missing.mapInArrow(counter(spark.sparkContext.broadcast(tokenizer)), "digest binary, n_tokens bigint")
    encoded.write.mode("append").parquet(f"{cache}/version={version}")
    counts = read_cache(spark, cache, version)
    if stored is not None and not counts.groupBy("digest").count().where("count > 1").isEmpty():
        counts = counts.dropDuplicates(["digest"])
    return keyed.drop("content").join(counts, "digest", "left").select(id, "n_bytes", "n_tokens")
