"""K-mer index of a read collection as a DataFrame, and what is counted on it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import kmer_code, kmer_text, reverse_complement


def strands(reads: DataFrame) -> DataFrame:
    """Every read and its reverse complement (strand '+' and '-'), qualities reversed."""
    qual = "qual" in reads.columns
    plus = F.struct(F.lit("+").alias("strand"), F.col("seq"), *([F.col("qual")] if qual else []))
    minus = F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq"), *([F.reverse("qual").alias("qual")] if qual else []))
    return reads.select("read_id", F.explode(F.array(plus, minus)).alias("x")).select("read_id", "x.*")


def stretches(seq: Column, size: Column | int) -> Column:
    """All stretches of so many characters, each one further than the one before. A pattern finds them in one pass; to cut
    them out by their places would walk through the text from its start for each."""
    pattern = F.lit(f"(?=(.{{{size}}}))") if isinstance(size, int) else F.format_string("(?=(.{%d}))", size)
    return F.regexp_extract_all(seq, pattern, F.lit(1))


def explode_kmers(stranded: DataFrame, k: int, context: int = 0) -> DataFrame:
    """(read_id, strand, pos, kmer[, left_ctx, right_ctx]) of all k-mers; shorter reads have none. N counts as A, and a
    context beyond the read's ends is filled with A."""
    beside = F.lit("A" * context)
    padded = F.concat(beside, F.translate("seq", "N", "A"), beside)
    rows = stranded.select("read_id", "strand", F.posexplode(stretches(padded, k + 2 * context)).alias("pos", "g"))
    part = lambda at, n: F.substring("g", at + 1, n)
    out = rows.select("read_id", "strand", "pos", part(context, k).alias("kmer"), "g")
    if context:
        out = out.withColumn("left_ctx", part(0, context)).withColumn("right_ctx", part(context + k, context))
    return out.drop("g")


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n, n_reads). Repeats within a read are counted before the shuffle."""
    rows = explode_kmers(reads.withColumn("strand", F.lit("+")), k)
    return rows.groupBy("kmer", "read_id").agg(F.count(F.lit(1)).alias("c")).groupBy("kmer").agg(F.sum("c").cast("long").alias("n"), F.count(F.lit(1)).alias("n_reads"))


def slot_cap(index: DataFrame, cap: int) -> DataFrame:
    """The first `cap` entries of each k-mer in read order; Spark limits each group before the shuffle."""
    w = Window.partitionBy("kmer").orderBy("read_id", "strand", "pos")
    return index.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


class Kmers:
    """Table function: the places and k-mers of a sequence. register() makes it kmers(seq, k) in SQL."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[int, str]]:
        for i in range(len(seq or "") - k + 1):
            yield i, seq[i : i + k]


def register(spark: SparkSession) -> None:
    spark.udtf.register("kmers", F.udtf(Kmers, returnType="pos: int, kmer: string"))


def totals(reads: DataFrame, k: int) -> DataFrame:
    """Numbers that size an index over both strands: k-mers, and characters with a separator for each read."""
    n = F.length("seq")
    return reads.agg((2 * F.sum(F.greatest(n - k + 1, F.lit(0)))).cast("long").alias("num_kmers"), (1 + 2 * F.sum(n + 1)).cast("long").alias("total_size"), (2 * F.count(F.lit(1))).alias("n_reads"))


def coverage(spark: SparkSession, reads: DataFrame, k: int = 10, extension: int = 7, middle: int = 1000, floor: int = 5) -> DataFrame:
    """(n_extended, coverage): the mean count above `floor` of the longer k-mers that begin with one of the `middle` k-mers
    around the median, over all 4 ** k of them (a fixed number) ordered by count, then code."""
    both = strands(reads)
    found = explode_kmers(both, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("c")).select(kmer_code(F.col("kmer")).alias("code"), "c")
    domain = spark.range(4**k).withColumnRenamed("id", "code").join(found, "code", "left").select("code", F.coalesce("c", F.lit(0)).alias("c"))
    # only the ranks around the median are wanted: counts of counts say in which count they lie
    by_count = domain.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low = 4**k // 2 - middle // 2
    spans = by_count.withColumn("before", before).filter((F.col("before") < low + middle) & (F.col("before") + F.col("n") > low))
    near = domain.join(F.broadcast(spans.select("c", "before")), "c")
    ranked = near.withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("c").orderBy("code")) - 1)
    chosen = ranked.filter((F.col("r") >= low) & (F.col("r") < low + middle)).select("code")
    # `middle` rows; the k-mers that longer ones begin with are compared as text
    starts = F.broadcast(chosen.select(kmer_text(F.col("code"), k).alias("start")))
    longer = explode_kmers(both, k + extension).withColumn("start", F.substring("kmer", 1, k))
    counts = longer.join(starts, "start", "left_semi").groupBy("kmer").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.count(F.lit(1)).alias("n_extended"), F.round(F.avg(F.when(F.col("c") > floor, F.col("c"))), 6).alias("coverage"))
