"""Read-file operations: concatenation, sampling, pairing, conversion. A read file is (read_id, info, seq, [qual]) with
read_id the record's place in its file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import bare_id, quality_ordinals, with_length
from strandline.sources.staging import Stage


def concat_files(files: list[DataFrame]) -> DataFrame:
    """All records, with file_id the place of their file."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("file_id", F.lit(i)) for i, f in enumerate(files)])


def running_ordinal(records: DataFrame, order: list[str]) -> DataFrame:
    """Adds ordinal, the record's place over all files (nulls last), without one task that sees all rows: ranges are sorted,
    counted, and each starts where the one before it ended. Records are staged with their range and their place in it: ranges
    that are computed twice have other bounds, as those come from a sample, and are merged by their size."""
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = records.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    local = Stage(records.sparkSession).write(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33))
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # a row for each range
    place = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)  # _at counts from range * 2 ** 33
    return local.join(F.broadcast(starts), "_part").withColumn("ordinal", place).drop("_at", "_part", "_before")


def systematic_sample(records: DataFrame, per_thousand: int, ordinal: str = "ordinal") -> DataFrame:
    """Record j stays if the whole part of j * s / 1000 grows from j to j + 1; s outside 1 to 1000 means 1000."""
    s = per_thousand if 0 < per_thousand <= 1000 else 1000
    j = F.col(ordinal)
    return records.filter(F.floor(j * s / 1000) < F.floor((j * s + s) / 1000))


def one_sequence(records: DataFrame, order: list[str]) -> DataFrame:
    """All sequences in order as one record under the first header: one value by its nature."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "info", "seq")))
    return records.agg(F.get(parts, F.lit(0))["info"].alias("info"), F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """(read_id, side, info, seq): record i of a, then record i of b; the longer file goes on alone."""
    both = a.select("read_id", F.struct(F.lit(1).alias("side"), "info", "seq").alias("a")).join(b.select("read_id", F.struct(F.lit(2).alias("side"), "info", "seq").alias("b")), "read_id", "full")
    return both.select("read_id", F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("x")).select("read_id", "x.*")


def split_paired(records: DataFrame) -> DataFrame:
    """Adds part: neighbours with one id (pair suffix aside) are a pair, greedily from the left; the others fragments.
    Runs of equal ids are found inside groups of a common id, so no window spans the file."""
    named = running_ordinal(records.withColumn("_id", bare_id(F.col("info"))), ["read_id"])
    w = Window.partitionBy("_id").orderBy("ordinal")
    runs = named.withColumn("_run", F.col("ordinal") - F.row_number().over(w))
    inside = Window.partitionBy("_id", "_run")
    n, size = F.row_number().over(inside.orderBy("ordinal")), F.count(F.lit(1)).over(inside)
    return runs.withColumn("_k", n).withColumn("_size", size).withColumn("part", F.when(F.col("_k") <= F.col("_size") - F.col("_size") % 2, "pair").otherwise("frag")).drop("_id", "_run", "_k", "_size", "ordinal")


def split_pairs(records: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Even records are side 1, odd ones side 2."""
    return records.withColumn("side", (F.col(ordinal) % 2 + 1).cast("int"))


def pair_ids(records: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(pair, id_a, id_b): ids of records 2i and 2i + 1, up to the blank and without their first character."""
    name = F.expr(r"substring(split(info, '[ \t]')[0], 2)")
    rows = records.select(F.expr(f"{ordinal} div 2").alias("pair"), (F.col(ordinal) % 2).alias("k"), name.alias("name"))
    return rows.groupBy("pair").agg(F.max(F.when(F.col("k") == 0, F.col("name"))).alias("id_a"), F.max(F.when(F.col("k") == 1, F.col("name"))).alias("id_b"))


def zip_quality(fasta: DataFrame, quals: DataFrame) -> DataFrame:
    """FASTA and QUAL records (read_id, qual_text) by place; what one of them lacks is left out. A number beyond 93 is an
    error."""
    char = lambda x: F.when(x.cast("long") > 93, F.raise_error(F.concat(F.lit("no such quality: "), x)).cast("string")).otherwise(F.char(x.cast("long") + 33))
    qual = F.array_join(F.transform(F.filter(F.split("qual_text", "[^0-9]+"), lambda x: x != ""), char), "")
    return fasta.select("read_id", F.concat(F.lit("@"), F.expr("substring(info, 2)")).alias("info"), "seq").join(quals.select("read_id", qual.alias("qual")), "read_id")


def replace_headers(headers: DataFrame, records: DataFrame) -> DataFrame:
    """Records under the header of the same place, its mark theirs and its length rewritten; records beyond the last header
    keep their own (none at all without one)."""
    n = F.length("seq")
    own = F.col("info") if "info" in records.columns else F.lit(None).cast("string")
    mark = F.when(own.startswith(">"), F.concat(F.lit(">"), F.expr("substring(_info, 2)"))).otherwise(F.col("_info"))
    rows = records.join(headers.select("read_id", F.col("info").alias("_info")), "read_id", "left")
    return rows.withColumn("info", with_length(F.coalesce(mark, own), n)).drop("_info")


def merge_numbered(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, src, info, seq) of two files in the order of the number after the header's third blank; b first on ties."""
    key = F.regexp_extract("info", "^[^ ]* [^ ]* [^ ]* ([0-9]+)", 1).cast("long")
    rows = a.withColumn("src", F.lit("a")).unionByName(b.withColumn("src", F.lit("b"))).withColumn("key", key)
    return rows.orderBy("key", F.col("src").desc(), "read_id")


def restore_order(original: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """For each original record the one of a, else of b, whose header begins with the original's. Both headers are the
    same up to the first blank, so that is joined on. An original that neither holds is an error."""
    columns = [c for c in ("info", "seq", "qual_info", "qual") if c in a.columns and c in b.columns]
    short = F.split("info", "[ \t]")[0].alias("_id")
    side = lambda d, name: d.select(short, F.struct(*columns).alias(name))
    rows = original.select("read_id", F.col("info").alias("_info"), short)
    for d, name in ((a, "_a"), (b, "_b")):
        rows = rows.join(side(d, name), "_id", "left").withColumn(name, F.when(F.col(f"{name}.info").startswith(F.col("_info")), F.col(name)))
    rows = rows.groupBy("read_id", "_info").agg(F.min("_a").alias("_a"), F.min("_b").alias("_b"))
    found = F.coalesce("_a", "_b")
    known = F.when(found.isNull(), F.raise_error(F.concat(F.lit("unknown header: "), F.col("_info"))).cast("string")).otherwise(F.col("_info"))
    rows = rows.select("read_id", found.alias("x"), known.alias("_known")).filter("_known IS NOT NULL")
    return rows.select("read_id", *(F.col("x")[c].alias(c) for c in columns))


def to_fasta(records: DataFrame) -> DataFrame:
    return records.select("read_id", F.concat(F.lit(">"), F.expr("substring(info, 2)")).alias("info"), "seq")


def to_fastq(records: DataFrame) -> DataFrame:
    """A missing quality becomes a constant I."""
    qual = F.coalesce("qual", F.expr("repeat('I', length(seq))")) if "qual" in records.columns else F.expr("repeat('I', length(seq))")
    return records.select("read_id", F.concat(F.lit("@"), F.expr("substring(info, 2)")).alias("info"), "seq", F.lit("+").alias("qual_info"), qual.alias("qual"))


def quality_text(records: DataFrame) -> DataFrame:
    """QUAL records: numbers with blanks between them."""
    return records.select("read_id", F.concat(F.lit(">"), F.expr("substring(info, 2)")).alias("info"), F.array_join(quality_ordinals(F.col("qual")), " ").alias("qual_text"))


def adjust_quality(records: DataFrame) -> DataFrame:
    """A quality never begins with the mark of a header."""
    return records.withColumn("qual", F.when(F.col("qual").startswith("@"), F.concat(F.lit("A"), F.expr("substring(qual, 2)"))).otherwise(F.col("qual")))


def bare_quality_header(records: DataFrame) -> DataFrame:
    return records.withColumn("qual_info", F.lit("+"))


def statistics(records: DataFrame) -> DataFrame:
    n = F.length("seq")
    return records.agg(F.count(F.lit(1)).alias("n_reads"), F.sum(n).cast("long").alias("total"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.expr("sum(length(seq)) div count(1)").alias("mean_length"))
