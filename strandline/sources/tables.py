"""Read collections derived from the driver's tables, whole texts throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import normalize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """A table that comes in fewer pieces than there are cores is dealt anew, once its columns are small."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _place(placed: bool) -> list[Column]:
    """place, if asked for: a row's file and its row there, which settle the order of rows with one id however they are dealt."""
    return [F.struct("_metadata.file_path", "_metadata.row_index").alias("place")] if placed else []


def reads(spark: SparkSession, sf_dir: str, unknown: str = "", placed: bool = False) -> DataFrame:
    """(read_id, seq, [place]): the bases of each document."""
    return _spread(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), normalize(F.col("text"), unknown).alias("seq"), *_place(placed)))


def quality_reads(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """(read_id, info, seq, qual, [place]): a made-up quality for each base of each document that has any."""
    qual = F.expr("array_join(transform(sequence(1, length(seq)), i -> char(33 + (read_id * 31 + i * 7) % 41)), '')")
    info = F.concat(F.lit("@d"), F.col("read_id").cast("string"), F.lit(" len=0"))
    rows = reads(spark, sf_dir, placed=placed).filter(F.length("seq") >= 1)
    return rows.select("read_id", info.alias("info"), "seq", qual.alias("qual"), *(["place"] if placed else []))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("contig_id"), normalize(F.col("text"), "").alias("seq"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g): all contigs in order as one string. The reference text is one value by nature."""
    parts = F.array_sort(F.collect_list(F.struct("contig_id", "seq")))
    return contigs(spark, sf_dir).agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("g"))


def tiled(spark: SparkSession, sf_dir: str, size: int = 80, step: int = 4) -> DataFrame:
    """(read_id, start0, truth, seq): reads that tile the genome; a third of them has one wrong base at a known place."""
    starts = F.explode(F.expr(f"sequence(0L, (length(g) - {size}) div {step})")).alias("read_id")
    rows = genome(spark, sf_dir).filter(F.length("g") >= size).select("g", starts)
    rows = rows.select("read_id", (F.col("read_id") * step).alias("start0"), F.expr(f"substring(g, cast(read_id * {step} + 1 as int), {size})").alias("truth"))
    at = f"cast((read_id * 37) % {size} as int)"
    wrong = F.expr(f"concat(substring(truth, 1, {at}), translate(substring(truth, {at} + 1, 1), 'ACGT', 'CGTA'), substring(truth, {at} + 2, {size}))")
    return rows.withColumn("seq", F.when(F.col("read_id") % 3 == 0, wrong).otherwise(F.col("truth")))


def with_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tiled with other, the true stretch without one of its bases (a third of the rows), or with one more (another)."""
    at = "cast((read_id * 13) % 70 + 5 as int)"
    less = f"concat(substring(truth, 1, {at}), substring(truth, {at} + 2))"
    more = f"concat(substring(truth, 1, {at}), substring('ACGT', cast(read_id % 4 + 1 as int), 1), substring(truth, {at} + 1))"
    return tiled(spark, sf_dir).withColumn("other", F.expr(f"CASE read_id % 3 WHEN 1 THEN {less} WHEN 2 THEN {more} ELSE truth END"))


def pairs(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """(read_id, info, seq, [place]): turns of conversations as paired reads. A missing number is left out of the header."""
    turn = F.concat_ws("", F.lit("@c"), F.col("conv_id").cast("string"), F.lit("_"), F.expr("turn div 2").cast("string"), F.lit("/"), (F.col("turn") % 2 + 1).cast("string"))
    return _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), turn.alias("info"), normalize(F.col("text"), "").alias("seq"), *_place(placed))
