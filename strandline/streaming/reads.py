"""Reads as a stream: k-mer counts that grow with each batch, and placement of each batch as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.kmers import explode_kmers
from strandline.operators.placement import align_hamming


def read_stream(spark: SparkSession, folder: str, schema: str = "read_id long, seq string") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def running_kmer_counts(stream: DataFrame, k: int) -> DataFrame:
    return explode_kmers(stream.withColumn("strand", F.lit("+")), k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def place_batches(genome: DataFrame, errors: int, q: int, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: placement needs no state, so each batch is placed alone; sink gets (placed, batch id)
    and should write under the batch id, so a batch that is run again replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(align_hamming(batch, genome, errors, q), batch_id)

    return run
