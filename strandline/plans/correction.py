"""Correction of a read collection: index, seeds, candidates, consensus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import consensus, edit_graph, kmers, overlaps
from strandline.sources.staging import Stage


@dataclass(frozen=True)
class Options:
    """Defaults are those of the public tool's interface; match is 'hamming', 'edit' or 'insdel'."""

    match: str = "hamming"
    diploid: bool = False
    kmer: int = 9
    kmer_errors: int = 2
    max_kmer_slots: int = 100_000
    max_kmer_results: int = 30
    max_length_matches: int = 2_000_000_000
    min_overlap: int = 35
    min_overlap_share: float = 0.20
    min_read_weight: float = 0.0
    error_rate: float = 0.25
    reserve: float = 100.0
    reserve_share: float = 1.0
    aggressive: float = 0.42
    trim: bool = False
    trim_factor: float = 2.5
    use_quality: bool = True
    both_strands: bool = True


def derived(options: Options, mean_length: int, num_kmers: int, coverage: float | None, kmer_factor: int = 1000) -> Options:
    """Parameters that follow from the collection: the least overlap is at most 0.7 of the mean length; k grows while
    4 ** k * factor <= k-mers and k < 14; the reserve follows the coverage (at least 10)."""
    from dataclasses import replace

    k = options.kmer
    while k < 14 and 4**k * kmer_factor <= num_kmers:
        k += 1
    cover = max(coverage or 10.0, 10.0)
    reserve = min(options.reserve, cover * options.aggressive * (0.5 if options.diploid else 1.0))
    return replace(options, kmer=k, min_overlap=min(options.min_overlap, int(0.7 * mean_length)), reserve=reserve, max_kmer_results=max(options.max_kmer_results, int(1.5 * reserve)), max_length_matches=options.max_length_matches // max(1, mean_length))


def stranded(reads: DataFrame, options: Options) -> DataFrame:
    return kmers.strands(reads) if options.both_strands else reads.withColumn("strand", F.lit("+"))


def find_candidates(reads: DataFrame, both: DataFrame, options: Options) -> DataFrame:
    k = options.kmer
    index = overlaps_index(both, options)
    found = overlaps.seeds(overlaps.window_parts(reads, k), index, k, options.kmer_errors, mode=options.match, neighbours=True)
    found = overlaps.escalate(overlaps.cap_neighbours(found, options.max_kmer_results), options.kmer_errors, options.max_kmer_results)
    cands = overlaps.candidates(found, reads, both, options.min_overlap, options.min_overlap_share, 0 if options.match == "hamming" else options.kmer_errors)
    return overlaps.without_self(cands)


def overlaps_index(both: DataFrame, options: Options) -> DataFrame:
    """Contexts are longer outside Hamming: insertions may need max errors more bases."""
    context = options.kmer + (0 if options.match == "hamming" else options.kmer_errors)
    return kmers.slot_cap(kmers.explode_kmers(both, options.kmer, context), options.max_kmer_slots)


def hamming_overlaps(reads: DataFrame, both: DataFrame, options: Options) -> DataFrame:
    cands = overlaps.cap_candidates(find_candidates(reads, both, options), max(options.max_length_matches, 3 * options.max_kmer_results))
    shifted = consensus.shifted_overlaps(cands, reads, both)
    return consensus.best_shifts(consensus.accept(shifted, options.min_overlap, options.min_overlap_share, options.error_rate), options.min_read_weight)


def correct(reads: DataFrame, options: Options | None = None) -> DataFrame:
    """(read_id, seq[, qual]): corrected reads, with qualities if they have any. Reads of under two k-mers have no
    candidates and stay as they are."""
    options = options or Options()
    # a table: the reads are read again at many places of the plan
    reads = Stage(reads.sparkSession).write(reads, "reads")
    both = stranded(reads, options)
    plain = [c for c in both.columns if c != "qual"]
    if options.match == "hamming":
        best = hamming_overlaps(reads, both, options)
        voted = consensus.votes(best, *((reads, both) if options.use_quality else (reads.select("read_id", "seq"), both.select(*plain))))
        done = consensus.assemble(consensus.call_bases(voted, reads, options.reserve, options.reserve_share), reads)
        if options.trim:
            done = consensus.trim(done, options.trim_factor)
        elif "qual" in reads.columns:
            done = done.withColumn("start", F.lit(0))
        if "qual" not in reads.columns:
            return done.select("read_id", "seq")
        # bases change, places don't
        return done.join(reads.select("read_id", "qual"), "read_id").select("read_id", "seq", F.expr("substring(qual, start + 1, length(seq))").alias("qual"))
    cands = overlaps.cap_candidates(find_candidates(reads, both, options), max(options.max_length_matches, 3 * options.max_kmer_results))
    how = edit_graph.EditOptions(options.kmer, options.error_rate, options.min_overlap, options.min_overlap_share, options.min_read_weight, options.match, options.reserve, options.reserve_share, options.trim_factor if options.trim else 0.0, options.use_quality)
    return edit_graph.correct_edit(cands, reads, both, how)
