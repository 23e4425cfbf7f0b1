"""Evaluation of a correction against the truth: classes of reads, confusion of bases, measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.sequence import measures
from strandline.operators.distance import EDIT, HAMMING, edit_distance, placements
from strandline.operators.placement import Reference


def judge(original: str, corrected: str, edit: int, truths: list[str], mode: str = EDIT, trim: bool = False) -> tuple[int, int, int, int]:
    """(errors that are left, operations of the correction, trimmed bases, errors of the original in what wasn't trimmed).

    truths: the reference's texts at the original's places, which it has `edit` errors against (none needed at 0). With
    trim a corrected read is held against the part of the text that it fits best, and that against the original."""
    if not trim:
        if mode == HAMMING and len(original) < len(corrected):
            return len(original), len(original), 0, edit
        opers = edit_distance(original, corrected, mode)
        left = [edit_distance(t, corrected, mode) for t in truths] + [opers] * (edit == 0)
        return min(left, default=len(original) + len(corrected)), opers, 0, edit
    far = len(original) + len(corrected) + max(map(len, truths), default=0)
    fits = lambda a, b: _slides(a, b) if mode == HAMMING else placements(a, b, far, mode)
    if edit == 0:
        opers, found = fits(original, corrected)
        return opers, opers, min(len(original) - n for _, n in found), 0
    best = [(*fits(t, corrected), t) for t in truths]
    left = min((e for e, _, _ in best), default=far)
    parts = sorted({t[s : s + n] for e, found, t in best if e == left for s, n in found})
    there = [(*fits(original, part), part) for part in parts]
    after = min((e for e, _, _ in there), default=far)
    kept = sorted({(s, n) for e, found, _ in there if e == after for s, n in found})
    opers, trimmed = min(((edit_distance(original[s : s + n], corrected, mode), len(original) - n) for s, n in kept), default=(far, 0))
    return left, opers, trimmed, after


def _slides(a: str, b: str) -> tuple[int, list[tuple[int, int]]]:
    """Fewest mismatches of b within a, and its places; all of b where it is the longer."""
    if len(b) > len(a):
        return len(b), [(0, len(a))]
    off = [sum(x != y for x, y in zip(a[i:], b, strict=False)) for i in range(len(a) - len(b) + 1)]
    return min(off), [(i, len(b)) for i, e in enumerate(off) if e == min(off)]


def evaluate_placed(original: DataFrame, corrected: DataFrame, aligned: DataFrame, genome: DataFrame, mode: str = EDIT, trim: bool = False) -> DataFrame:
    """(read_id, org, fixed, e1, e1_left, e2, opers, trimmed, n, cls) of the reads that are aligned (read_id, edit, maps of
    strand, start, len; exact ones need none)."""
    longest = aligned.agg(F.max(F.expr("array_max(maps.len)"))).first()[0] or 1
    places = aligned.select("read_id", F.explode("maps").alias("m")).select("read_id", "m.strand", F.col("m.start").alias("low"), F.col("m.len").alias("size"))
    texts = Reference.of(genome, longest).with_text(places).groupBy("read_id").agg(F.array_sort(F.collect_set("there")).alias("truths"))
    rows = aligned.select("read_id", F.col("edit").alias("e1")).join(original.select("read_id", F.col("seq").alias("org")), "read_id").join(corrected.select("read_id", F.col("seq").alias("fixed")), "read_id").join(texts, "read_id", "left")

    @F.pandas_udf("e2 int, opers int, trimmed int, e1_left int")
    def judged(org: pd.Series, fixed: pd.Series, e1: pd.Series, truths: pd.Series) -> pd.DataFrame:
        given = zip(org, fixed, e1, truths, strict=True)
        return pd.DataFrame([judge(o, c, int(e), list(t) if t is not None else [], mode, trim) for o, c, e, t in given], columns=["e2", "opers", "trimmed", "e1_left"])

    rows = rows.withColumn("j", judged("org", "fixed", "e1", "truths")).select("read_id", "org", "fixed", "e1", "j.*", F.length("org").alias("n"))
    return rows.withColumn("cls", _class())


def _class() -> Column:
    return F.when((F.col("e1") == 0) & (F.col("e2") == 0), "TN").when(F.col("e2") == 0, "TP").when(F.col("e1") == 0, "FP").otherwise("FN")


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: trimmed bases, in all and of reads without errors left, and the confusions and measures of reads and of
    bases (read_ and base_)."""
    right = F.col("e2") == 0
    trimmed = evaluated.agg(F.count(F.lit(1)).alias("n_reads"), F.sum("n").alias("n_bases"), F.sum("trimmed").alias("trimmed"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("n_bases_right"), F.sum(F.when(right, F.col("trimmed")).otherwise(0)).alias("trimmed_right"))
    trimmed = trimmed.withColumn("n_bases_left", F.col("n_bases") - F.col("trimmed"))
    named = lambda part, rows: rows.select(*(F.col(c).alias(f"{part}_{c}") for c in rows.columns))
    # three tables of one row
    return trimmed.crossJoin(named("read", with_measures(read_confusion(evaluated)))).crossJoin(named("base", with_measures(base_confusion(evaluated))))


def evaluate_reads(original: DataFrame, corrected: DataFrame, truth: DataFrame) -> DataFrame:
    """(read_id, e1, e2, opers, cls): distances to the truth before and after, operations between, and the class. Reads
    that one of the three lacks are left out."""
    rows = original.select("read_id", F.col("seq").alias("o")).join(corrected.select("read_id", F.col("seq").alias("c")), "read_id").join(truth.select("read_id", F.col("seq").alias("t")), "read_id")
    rows = rows.select("read_id", F.levenshtein("o", "t").alias("e1"), F.levenshtein("c", "t").alias("e2"), F.levenshtein("o", "c").alias("opers"), F.length("o").alias("n"))
    return rows.withColumn("cls", _class())


def read_confusion(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(*(F.count_if(F.col("cls") == c).alias(c.lower()) for c in ("TP", "FP", "FN", "TN")))


def base_confusion(evaluated: DataFrame) -> DataFrame:
    """Bases: errors x before (of what wasn't trimmed), changes z, errors y after; x = TP + FN, z = TP + FP, y = FN + FP.
    Sums are doubled while they are added and halved at the end, as odd sums of a read have halves."""
    before = F.col("e1_left") if "e1_left" in evaluated.columns else F.col("e1")
    n = F.col("n") - F.col("trimmed") if "trimmed" in evaluated.columns else F.col("n")
    fn2 = before - F.col("opers") + F.col("e2")
    rows = evaluated.agg(F.sum(fn2).alias("fn2"), F.sum(2 * before - fn2).alias("tp2"), F.sum(2 * F.col("opers") - (2 * before - fn2)).alias("fp2"), F.sum(n).alias("n"))
    return rows.select((F.col("tp2") / 2).alias("tp"), (F.col("fp2") / 2).alias("fp"), (F.col("fn2") / 2).alias("fn"), (F.col("n") - (F.col("tp2") + F.col("fp2") + F.col("fn2")) / 2).alias("tn"))


def with_measures(confusion: DataFrame, digits: int = 6) -> DataFrame:
    found = measures(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return confusion.select("*", *(F.round(c, digits).alias(name) for name, c in found.items()))
