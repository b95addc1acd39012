"""Benchmark tables replayed as streams through file sources."""

from pyspark.sql import DataFrame

from codeloom.operators.lineage import shared_folder


def replay(spark, sf_dir: str, table: str) -> DataFrame:
    """One table as a stream; the pattern lets the file source accept a single file."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over the data available now and read its output back."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, name), shared_folder(spark, name + "-state")
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)
