"""Substitution consensus: best ungapped overlaps vote for bases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import overlap_weight, right_probability

_SHIFTED = "greatest(0, shift)"


def shifted_overlaps(cands: DataFrame, reads: DataFrame, stranded: DataFrame) -> DataFrame:
    """(read_id, cand_id, cand_strand, shift, overlap, errors, max_overlap): each shift of each candidate."""
    a = reads.select("read_id", F.col("seq").alias("a"))
    b = stranded.select(F.col("read_id").alias("cand_id"), F.col("strand").alias("cand_strand"), F.col("seq").alias("b"))
    rows = cands.withColumn("shift", F.explode(F.sequence("shift1", "shift2"))).join(a, "read_id").join(b, ["cand_id", "cand_strand"])
    rows = rows.withColumn("overlap", F.expr(f"least(length(a), length(b) + shift) - {_SHIFTED}")).filter("overlap > 0")
    pa, pb = F.expr(f"substring(a, {_SHIFTED} + 1, overlap)"), F.expr(f"substring(b, {_SHIFTED} - shift + 1, overlap)")
    errors = F.aggregate(F.zip_with(F.split(pa, ""), F.split(pb, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return rows.select("read_id", "cand_id", "cand_strand", "shift", "overlap", errors.alias("errors"), "max_overlap", F.length("a").alias("na"))


def accept(overlaps: DataFrame, min_overlap: int, min_share: float, error_rate: float) -> DataFrame:
    """Overlaps with enough equal bases and few enough errors; adds allowed and weight."""
    least = F.greatest(F.lit(min_overlap), F.floor(F.lit(min_share) * F.col("na")))
    allowed = F.floor(F.lit(error_rate) * F.col("overlap")).cast("int")
    rows = overlaps.withColumn("allowed", allowed)
    rows = rows.filter((F.col("overlap") - F.col("errors") >= least) & (F.col("errors") <= F.col("allowed")) & (F.col("errors") <= F.floor(F.lit(error_rate) * F.col("max_overlap"))))
    return rows.drop("na")


def best_shifts(accepted: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """Of each candidate the shifts with the fewest errors, ties included, sharing the largest weight among them."""
    pair = Window.partitionBy("read_id", "cand_id", "cand_strand")
    rows = accepted.withColumn("_r", F.rank().over(pair.orderBy("errors"))).filter("_r = 1").drop("_r")
    rows = rows.withColumn("w", overlap_weight(F.col("errors"), F.col("allowed"), min_weight))
    return rows.withColumn("weight", F.max("w").over(pair) / F.count(F.lit(1)).over(pair)).drop("w")


def votes(best: DataFrame, reads: DataFrame, stranded: DataFrame) -> DataFrame:
    """(read_id, pos, base, w): the read's own bases and those of its overlaps; N never votes. Qualities scale a vote."""
    qual = "qual" in reads.columns
    p = lambda c: F.coalesce(right_probability(F.ascii(F.expr(c)) - 33), F.lit(1.0)) if qual else F.lit(1.0)
    own = reads.select("read_id", "seq", *(["qual"] if qual else []), F.posexplode(F.split("seq", "")).alias("pos", "base"))
    own = own.filter(F.col("base") != "").select("read_id", "pos", "base", p("substring(qual, pos + 1, 1)").alias("w"))
    b = stranded.select(F.col("read_id").alias("cand_id"), F.col("strand").alias("cand_strand"), F.col("seq").alias("b"), *([F.col("qual").alias("bq")] if qual else []))
    rows = best.join(b, ["cand_id", "cand_strand"]).withColumn("i", F.explode(F.expr("sequence(greatest(0, shift), greatest(0, shift) + overlap - 1)")))
    other = rows.select("read_id", F.col("i").alias("pos"), F.expr("substring(b, i - shift + 1, 1)").alias("base"), (F.col("weight") * p("substring(bq, i - shift + 1, 1)")).alias("w"))
    return own.unionByName(other).filter(F.col("base").isin("A", "C", "G", "T")).groupBy("read_id", "pos", "base").agg(F.sum("w").alias("w"))


def call_bases(voted: DataFrame, reads: DataFrame, reserve: float = 100.0, reserve_share: float = 1.0) -> DataFrame:
    """(read_id, pos, base, w): the read's own base if its weight reaches `reserve`, or `reserve_share` of the best; else
    the heaviest, ties in the order A, T, C, G. Weights count to nine places, so order of adding doesn't matter. Positions
    without votes keep their base."""
    own = reads.select("read_id", F.posexplode(F.split("seq", "")).alias("pos", "own")).filter(F.col("own") != "")
    rank = F.expr("CASE base WHEN 'A' THEN 0 WHEN 'T' THEN -1 WHEN 'C' THEN -2 WHEN 'G' THEN -3 END")
    w = F.round("w", 9)
    by_pos = voted.groupBy("read_id", "pos").agg(F.max_by("base", F.struct(w, rank)).alias("best"), F.max(w).alias("best_w"), F.collect_list(F.struct("base", w.alias("w"))).alias("each"))
    rows = own.join(by_pos, ["read_id", "pos"], "left")
    rows = rows.withColumn("own_w", F.coalesce(F.expr("get(filter(each, x -> x.base = own), 0).w"), F.lit(0.0)))
    keep = F.col("best").isNull() | ((F.col("own") != "N") & ((F.col("own_w") >= reserve) | (F.col("best_w") < 1e-4) | (F.col("own_w") / F.col("best_w") >= reserve_share)))
    return rows.select("read_id", "pos", F.when(keep, F.col("own")).otherwise(F.col("best")).alias("base"), F.when(keep, F.col("own_w")).otherwise(F.col("best_w")).alias("w"))


def assemble(called: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, seq, weights): called bases put together; reads without bases stay empty."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "base", "w")))
    rows = called.groupBy("read_id").agg(parts.alias("p")).select("read_id", F.array_join(F.transform("p", lambda x: x["base"]), "").alias("s"), F.transform("p", lambda x: x["w"]).alias("weights"))
    return reads.select("read_id").join(rows, "read_id", "left").select("read_id", F.coalesce("s", F.lit("")).alias("seq"), F.coalesce("weights", F.array().cast("array<double>")).alias("weights"))


def trim_range(weights: list[float] | None, factor: float) -> tuple[int, int]:
    """Kept range of a read: from the first weight at or under the factor everything to the nearer end goes, again and
    again, while over two bases are left; a tie takes the right side."""
    w = [] if weights is None else list(weights)
    start, end = 0, len(w)
    at = 0
    while factor > 1e-4 and at < end and end - start > 2:
        if w[at] > factor:
            at += 1
        elif at + 1 - start < end - at:
            start = at = at + 1
        else:
            end, at = at, start
    return start, end


def trim(corrected: DataFrame, factor: float) -> DataFrame:
    """(read_id, seq, weights) cut by trim_range, with start, the first place that stays, and trimmed, how many bases went."""

    @F.pandas_udf("start int, end int")
    def ranges(weights: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([trim_range(w, factor) for w in weights], columns=["start", "end"])

    rows = corrected.withColumn("_r", ranges("weights")).withColumn("_n", F.length("seq"))
    return rows.select("read_id", F.expr("substring(seq, _r.start + 1, _r.end - _r.start)").alias("seq"), F.expr("slice(weights, _r.start + 1, _r.end - _r.start)").alias("weights"), F.col("_r.start").alias("start"), F.expr("_n - (_r.end - _r.start)").alias("trimmed"))
