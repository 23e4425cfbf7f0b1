"""Column functions on base and quality strings. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ATCG"


def normalize(seq: Column, unknown: str = "N") -> Column:
    """Upper-case acgt; every other character becomes `unknown` ('' drops it)."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", unknown)


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def kmer_code(kmer: Column) -> Column:
    """Base-4 number with the first base lowest; A, T, C, G count 0 to 3 and N as A."""
    digits = F.translate(F.reverse(kmer), "ATCGN", "01230")
    return F.conv(digits, 4, 10).cast("long")


def kmer_text(code: Column, k: int) -> Column:
    return F.reverse(F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ATCG"))


def kmer_starts(length: Column, k: int) -> Column:
    """0-based starts of all k-mers, an empty array for shorter sequences."""
    return F.when(length >= k, F.sequence(F.lit(0), length - k)).otherwise(F.array().cast("array<int>"))


def part_size(length: Column, parts: Column, i: Column, policy: str = "small_ends") -> Column:
    """Size of part i (from 0) of a length that is cut into so many nearly equal parts. What is left over goes to the last
    parts (small_first), to the first (large_first), or to those nearest the middle (small_ends); large_ends leaves the
    smaller ones in the middle. The middle is part parts div 2, then its left neighbour, its right one, and so on."""
    base, rest = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    middle = F.floor(parts / 2).cast("int")
    rank = F.when(i < middle, 2 * (middle - i) - 1).otherwise(2 * (i - middle))
    larger = {"small_first": i >= parts - rest, "large_first": i < rest, "small_ends": rank < rest, "large_ends": rank >= parts - rest}[policy]
    return base + larger.cast("int")


def left_context(seq: Column, pos: Column, size: int) -> Column:
    """`size` bases before pos, filled with A beyond the start; N counts as A."""
    start = F.greatest(pos - size, F.lit(0))
    return F.translate(F.lpad(F.substring(seq, start + 1, pos - start), size, "A"), "N", "A")


def right_context(seq: Column, pos: Column, size: int) -> Column:
    """`size` bases from pos on, filled with A beyond the end; N counts as A."""
    return F.translate(F.rpad(F.substring(seq, pos + 1, F.lit(size)), size, "A"), "N", "A")


def quality_ordinals(qual: Column) -> Column:
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def ordinals_quality(ordinals: Column) -> Column:
    """Quality string of clamped ordinals 0 to 93."""
    return F.array_join(F.transform(ordinals, lambda q: F.char(33 + F.least(F.greatest(q, F.lit(0)), F.lit(93)).cast("long"))), "")


def right_probability(ordinal: Column) -> Column:
    """Probability that a base with this Phred quality is right; 0.1 for quality 0."""
    return F.when(ordinal <= 0, F.lit(0.1)).otherwise(1 - F.pow(F.lit(10.0), -ordinal / F.lit(10.0)))


def overlap_weight(errors: Column, allowed: Column, least: float = 0.0) -> Column:
    """1 for a faultless overlap, down to `least` for one with all errors that are allowed; with none allowed 1."""
    return F.when(allowed <= 0, F.lit(1.0)).otherwise(1 - (1 - least) * F.sqrt(errors / allowed))


def max_overlap(na: Column, nb: Column, shift1: Column, shift2: Column) -> Column:
    """Longest overlap of a and b with b starting at shift1 to shift2 of a."""
    return F.when(shift1 > 0, F.least(na - shift1, nb)).when(shift2 < 0, F.least(nb + shift2, na)).otherwise(F.least(na, nb))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches of two strings of one length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def bare_id(info: Column) -> Column:
    """A header up to its first blank or tab, without one of the pair suffixes."""
    return F.regexp_replace(F.split(info, "[ \t]")[0], "(/1|/2|_left|_right)$", "")


def with_length(info: Column, length: Column) -> Column:
    """The number after the first ' len=' (else the first ' length=') replaced by the length."""
    short = F.concat(F.regexp_extract(info, "^(.*?) len=[0-9]*", 1), F.lit(" len="), length.cast("string"), F.regexp_extract(info, "^.*? len=[0-9]*(.*)$", 1))
    long = F.concat(F.regexp_extract(info, "^(.*?) length=[0-9]*", 1), F.lit(" length="), length.cast("string"), F.regexp_extract(info, "^.*? length=[0-9]*(.*)$", 1))
    return F.when(info.contains(" len="), short).when(info.contains(" length="), long).otherwise(info)


def measures(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Recall, specificity, precision, F-score and gain; null where the denominator is 0."""
    ratio = lambda a, b: F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double"))
    recall, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return {"recall": recall, "specificity": ratio(tn, tn + fp), "precision": precision, "f_score": F.try_divide(2 * recall * precision, F.nullif(recall + precision, F.lit(0.0))), "gain": ratio(tp - fp, tp + fn)}
