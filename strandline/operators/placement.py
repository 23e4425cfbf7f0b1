"""Placement of reads on a reference: exact, by mismatches, by edits.

A read with at most e errors has one of its e + 1 parts intact (pigeonhole), so parts join with the reference's q-grams by
equality; only places that a part suggests are verified. How many errors a read may have follows from its length.

A reference is a table (g) of one row, or (at, g) of consecutive stretches, such as lines. Both of its strands are cut
into overlapping chunks that a place joins by its number, so no task holds the whole reference and nothing of it is
broadcast unless Spark finds it small.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import hamming, part_size, reverse_complement
from strandline.operators.distance import EDIT, HAMMING, placements
from strandline.operators.kmers import stretches
from strandline.sources.staging import Stage

CHUNK = 4096


def reference_chunks(genome: DataFrame, over: int = 0, size: int = CHUNK) -> DataFrame:
    """(strand, chunk, g): of each strand the bases from chunk * size on, size + over of them where there are as many."""
    if over > size:
        raise ValueError("chunks overlap by their own size at most")
    if "at" in genome.columns:
        rows = genome.select(F.col("at").cast("long").alias("at"), "g").filter("g <> ''")
    else:
        rows = genome.select(F.posexplode(F.regexp_extract_all("g", F.lit(f"(?s).{{1,{16 * size}}}"), F.lit(0))).alias("i", "g"))
        rows = rows.select((F.col("i").cast("long") * (16 * size)).alias("at"), "g")
    whole = F.broadcast(rows.agg(F.max(F.col("at") + F.length("g")).alias("whole")))  # one row
    minus = rows.crossJoin(whole).select(F.lit("-").alias("strand"), (F.col("whole") - F.col("at") - F.length("g")).alias("at"), reverse_complement(F.col("g")).alias("g"))
    both = rows.select(F.lit("+").alias("strand"), "at", "g").unionByName(minus)
    spread = both.withColumn("chunk", F.explode(F.expr(f"sequence(at div {size}, (at + length(g) - 1) div {size})"))).withColumn("first", F.greatest("at", F.col("chunk") * size))
    parts = spread.select("strand", "chunk", "first", F.expr(f"substring(g, cast(first - at + 1 as int), cast(least(at + length(g), (chunk + 1) * {size}) - first as int))").alias("g"))
    if over:
        begin = parts.filter(f"chunk > 0 AND first < chunk * {size} + {over}")
        begin = begin.select("strand", (F.col("chunk") - 1).alias("chunk"), "first", F.expr(f"substring(g, 1, cast(chunk * {size} + {over} - first as int))").alias("g"))
        parts = parts.unionByName(begin)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "g"))), lambda x: x["g"]), "")
    return parts.groupBy("strand", "chunk").agg(joined.alias("g"))


@dataclass
class Reference:
    """Chunks of a reference that overlap by `over` bases, as a table, so that they are cut once for all that joins them."""

    chunks: DataFrame
    size: int

    @classmethod
    def of(cls, genome: DataFrame, over: int) -> Reference:
        size = max(CHUNK, over)
        return cls(Stage(genome.sparkSession).write(reference_chunks(genome, over, size), "chunks"), size)

    def grams(self, sizes: Column) -> DataFrame:
        """(strand, at, gram): on both strands the stretches of all lengths of an array, none over `over` + 1."""
        rows = self.chunks.select("strand", "chunk", "g", F.explode(sizes).alias("q")).filter("q <= length(g)")
        begin = F.expr(f"substring(g, 1, cast({self.size} - 1 + q as int))")  # what begins later is the next chunk's
        rows = rows.select("strand", "chunk", F.posexplode(stretches(begin, F.col("q"))).alias("i", "gram"))
        return rows.select("strand", (F.col("chunk") * self.size + F.col("i")).alias("at"), "gram")

    def with_text(self, places: DataFrame) -> DataFrame:
        """places (strand, low, size, ...) with there, the reference's `size` bases from low on, fewer at its end; rows
        that begin beyond it are left out. No size is over `over`."""
        rows = places.withColumn("chunk", F.expr(f"low div {self.size}")).join(self.chunks.withColumnRenamed("g", "_g"), ["strand", "chunk"])
        rows = rows.withColumn("there", F.expr(f"substring(_g, cast(low - chunk * {self.size} + 1 as int), cast(size as int))"))
        return rows.drop("chunk", "_g").filter("there <> ''")


def _longest(reads: DataFrame) -> int:
    return reads.agg(F.max(F.length("seq"))).first()[0] or 0


def error_limit(length: Column, errors: int | None, q: int) -> Column:
    """Errors that a read may have: its parts are of q bases at least, so length div q - 1, none below 2 q bases; at most
    `errors` where that is given."""
    own = F.greatest((length / q).cast("int") - 1, F.lit(0))
    return own if errors is None else F.least(own, F.lit(errors))


def read_parts(reads: DataFrame, errors: int | None, q: int, policy: str = "small_ends") -> DataFrame:
    """(read_id, part_at, gram): the first q bases of each of the even parts, one more than the read's error_limit; of a
    read of under q bases all of it."""
    n = F.length("seq")
    rows = reads.filter(n > 0).select("read_id", "seq", (error_limit(n, errors, q) + 1).alias("parts"))
    sizes = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: part_size(n, F.col("parts"), i, policy))
    rows = rows.select("read_id", "seq", F.posexplode(sizes).alias("i", "size"), sizes.alias("sizes"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x)
    return rows.withColumn("part_at", before).select("read_id", "part_at", F.expr(f"substring(seq, part_at + 1, {q})").alias("gram"))


def suggested(reads: DataFrame, reference: Reference, errors: int | None, q: int) -> DataFrame:
    """(read_id, strand, start): where an intact part would put the read. Reads of under q bases are parts of their own
    length; which of those lengths occur is a short list."""
    parts = read_parts(reads, errors, q)
    lengths = [r[0] for r in reads.select(F.length("seq").alias("n")).filter(f"n BETWEEN 1 AND {q - 1}").distinct().collect()]  # q - 1 numbers at most
    hits = parts.join(reference.grams(F.array(*(F.lit(n) for n in [q, *lengths]))), "gram")
    return hits.select("read_id", "strand", (F.col("at") - F.col("part_at")).alias("start")).distinct()


def align_exact(reads: DataFrame, genome: DataFrame, q: int) -> DataFrame:
    """(read_id, strand, start) of all exact places; q only sizes the grams."""
    return align_hamming(reads, genome, 0, q).drop("edit")


def align_hamming(reads: DataFrame, genome: DataFrame, errors: int, q: int) -> DataFrame:
    """(read_id, edit, strand, start): the fewest mismatches (at most error_limit) and every place that has as few."""
    reference = Reference.of(genome, max(_longest(reads), q))
    rows = suggested(reads, reference, errors, q).filter("start >= 0").join(reads.select("read_id", "seq"), "read_id")
    rows = reference.with_text(rows.withColumn("low", F.col("start")).withColumn("size", F.length("seq"))).filter("length(there) = size")
    rows = rows.select("read_id", "strand", F.col("start").cast("int").alias("start"), hamming(F.col("seq"), F.col("there")).alias("edit"), error_limit(F.col("size"), errors, q).alias("most")).filter("edit <= most").drop("most")
    return _fewest(rows).select("read_id", "edit", "strand", "start")


def _fewest(rows: DataFrame) -> DataFrame:
    """Of each read's rows those with the fewest edits; a read has few, for they are verified."""
    return rows.withColumn("_least", F.min("edit").over(Window.partitionBy("read_id"))).filter("edit = _least").drop("_least")


def align_edit(reads: DataFrame, genome: DataFrame, errors: int | None, q: int, mode: str = EDIT) -> DataFrame:
    """(read_id, edit, maps): the fewest edits and every (strand, start, len) that has as few; reads without a place are
    left out. A read may have error_limit errors. Each suggested place is verified in a window that its errors could have
    moved it by; in the hamming mode by mismatches at the place."""
    if mode == HAMMING:
        rows = align_hamming(reads, genome, errors, q).join(reads.select("read_id", F.length("seq").alias("len")), "read_id")
        return rows.groupBy("read_id", "edit").agg(F.array_sort(F.collect_set(F.struct("strand", "start", "len"))).alias("maps"))
    longest = _longest(reads)
    most = max(0, longest // q - 1 if errors is None else min(errors, longest // q - 1))
    reference = Reference.of(genome, max(longest + 2 * most, q))
    rows = suggested(reads, reference, errors, q).join(reads.select("read_id", "seq", error_limit(F.length("seq"), errors, q).alias("most")), "read_id")
    rows = rows.withColumn("low", F.greatest(F.col("start") - F.col("most"), F.lit(0))).withColumn("size", F.col("start") + F.length("seq") + F.col("most") - F.col("low")).filter("size > 0")
    rows = reference.with_text(rows)

    @F.pandas_udf("edit int, maps array<struct<start:int,len:int>>")
    def verify(window: pd.Series, seq: pd.Series, most: pd.Series) -> pd.DataFrame:
        found = [placements(w, s, k, mode) for w, s, k in zip(window, seq, most, strict=True)]
        return pd.DataFrame({"edit": [e for e, _ in found], "maps": [[{"start": s, "len": n} for s, n in m] for _, m in found]})

    rows = rows.withColumn("v", verify("there", "seq", "most")).filter("v.edit >= 0").select("read_id", "strand", "low", F.col("v.edit").alias("edit"), F.explode("v.maps").alias("m"))
    maps = F.array_sort(F.collect_set(F.struct("strand", (F.col("low") + F.col("m.start")).cast("int").alias("start"), F.col("m.len").alias("len"))))
    return _fewest(rows).groupBy("read_id", "edit").agg(maps.alias("maps"))


def summary(reads: DataFrame, aligned: DataFrame) -> DataFrame:
    """Reads and bases in all and placed, and the mean edit."""
    one = aligned.groupBy("read_id").agg(F.min("edit").alias("edit"))
    rows = reads.select("read_id", F.length("seq").alias("n")).join(one, "read_id", "left")
    placed = F.col("edit").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("n_reads"), F.count("edit").alias("n_aligned"), F.sum("n").cast("long").alias("n_bases"), F.sum(F.when(placed, F.col("n"))).cast("long").alias("aligned_bases"), F.round(F.avg("edit"), 6).alias("mean_edit"))
