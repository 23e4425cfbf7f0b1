"""Overlaps between reads by k-mer seeds: query windows, exact and fuzzy seeds, candidates.

Positions are 0-based. A seed says that a place of the query lies on a place of a stranded candidate read; a candidate
gathers the range of shifts of its seeds. Everything is equi-joins on k-mers and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import kmer_code, max_overlap
from strandline.operators.distance import EDIT, HAMMING


def _windows(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, seq, win, start, parts)."""
    n = F.length("seq")
    rows = reads.select("read_id", "seq", n.alias("n"), F.when(n >= 3 * k, 3).when(n >= 2 * k, 2).alias("parts")).filter("parts IS NOT NULL")
    rows = rows.withColumn("size", F.col("parts") * k).withColumn("m", F.expr(f"cast(ceil((n - {k}) / (size - {k})) as int)")).withColumn("extra", F.expr("m * size - n"))
    # the i-th gap takes (extra + i) div (m - 1) off a whole step
    starts = F.expr("transform(sequence(0, m - 1), w -> struct(w AS win, cast(w * size - aggregate(CASE WHEN w > 0 THEN sequence(0, w - 1) ELSE array() END, 0L, (a, i) -> a + (extra + i) div (m - 1)) AS int) AS start))")
    return rows.select("read_id", "seq", F.explode(starts).alias("x"), "parts").select("read_id", "seq", "x.win", "x.start", "parts")


def query_windows(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, win, start, parts): windows of three k-mers (two for reads of under three, none under two) that overlap
    by k at least and cover the read evenly."""
    return _windows(reads, k).drop("seq")


def window_parts(reads: DataFrame, k: int) -> DataFrame:
    """query_windows with p1, p2, p3, the window's k-mers (p3 null in windows of two); N counts as A."""
    part = lambda j: F.translate(F.expr(f"substring(seq, start + 1 + {j * k}, {k})"), "N", "A")
    return _windows(reads, k).select("read_id", "win", "start", "parts", part(0).alias("p1"), part(1).alias("p2"), F.when(F.col("parts") == 3, part(2)).alias("p3"))


def context_errors(part: str, context: str, k: int, max_errors: int, mode: str) -> Column:
    """Errors of a k-mer against the context beside an equal k-mer (left ones end at it). Mismatches: of their numbers, as
    k-mers have up to 14 bases. Edits: the fewest over all lengths of context that max_errors insertions or deletions
    could leave."""
    if mode == HAMMING:
        # both are numbers here, two bits a base: a base differs where one of its bits does
        other = F.col(part).bitwiseXOR(F.col(context))
        return F.bit_count(other.bitwiseOR(F.shiftright(other, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    cut = "right" if context == "left_ctx" else "left"
    if mode == EDIT:
        # with a bound the distance stops early (-1); equal stretches, the usual case, need none
        each = f"transform(sequence({max(0, k - max_errors)}, {k + max_errors}), n -> levenshtein({part}, {cut}({context}, n), {max_errors}))"
        return F.expr(f"CASE WHEN {part} = {cut}({context}, {k}) THEN 0 WHEN {part} IS NOT NULL THEN coalesce(array_min(filter({each}, d -> d >= 0)), {max_errors + 1}) END")
    # without substitutions the distance follows from the longest common subsequence, whose rows a fold carries
    flip = "reverse" if cut == "right" else ""
    row = f"""transform(sequence(0, {k + max_errors}), x -> x)"""
    step = f"""aggregate(sequence(1, {k + max_errors}), array(r[0] + 1), (a, j) -> array_append(a, least(r[j] + 1, a[j - 1] + 1,
        r[j - 1] + CASE WHEN substr({flip}({part}), i, 1) = substr({flip}({context}), j, 1) THEN 0 ELSE 2 END)))"""
    return F.expr(f"CASE WHEN {part} IS NOT NULL THEN array_min(aggregate(sequence(1, {k}), {row}, (r, i) -> {step})) END")


def by_hot_keys(parts: DataFrame, entries: DataFrame, per_task: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on kmer with a salt to join on as well: rows of parts of a k-mer that has more than per_task
    of them are dealt to several salts, and the k-mer's entries are there for each. Other k-mers have salt 0 alone."""
    hot = parts.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_task).select("kmer", F.ceil(F.col("n") / per_task).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = parts.join(hot, "kmer", "left").withColumn("salt", F.pmod(F.xxhash64("read_id", "win"), salts).cast("int")).drop("salts")
    right = entries.join(hot, "kmer", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left, right


def seeds(windows: DataFrame, index: DataFrame, k: int, max_errors: int, outer: bool = True, mode: str = HAMMING, neighbours: bool = False, per_task: int = 100_000) -> DataFrame:
    """(read_id, win, cand_id, cand_strand, side, ref_pos, query_pos, errors) of all seeds with up to max_errors errors;
    with neighbours also neighbour, what the candidate has beside the equal k-mer (its number in the hamming mode), and
    both: at the left seed of a middle k-mer that has a right one too, the errors of the worse of the two.

    index: explode_kmers with a context of k, and of k + max_errors in a mode other than hamming, where a k-mer is
    compared with the best beginning of the context. In windows of three the middle k-mer is equal and the k-mer to its right
    (side 'R') or left ('L') may differ; in windows of two one of them is equal and the other may differ. With outer, an
    outer k-mer of a window of three may be the equal one too and the middle one differ (without errors it is a seed of
    the middle k-mer already). No two seeds are the same, as a side and a place in the query tell which k-mer is equal."""
    none = F.lit(None).cast("string")

    def part(parts: int, kmer: str, left: str | None, right: str | None, at: int, least: int = 0) -> Column:
        columns = [F.col(kmer).alias("kmer"), (F.col(left) if left else none).alias("left"), (F.col(right) if right else none).alias("right"), F.lit(at).alias("at"), F.lit(least).alias("least")]
        return F.when(F.col("parts") == parts, F.struct(*columns))

    wanted = [part(3, "p2", "p1", "p3", k), part(2, "p1", None, "p2", 0), part(2, "p2", "p1", None, k)]
    if outer and max_errors:
        wanted += [part(3, "p1", None, "p2", 0, 1), part(3, "p3", "p2", None, 2 * k, 1)]
    parts = windows.select("read_id", "win", "start", F.explode(F.filter(F.array(*wanted), lambda x: x.isNotNull())).alias("x")).select("read_id", "win", "start", "x.*")
    entries = index.select("kmer", F.col("read_id").alias("cand_id"), F.col("strand").alias("cand_strand"), "pos", "left_ctx", "right_ctx")
    if mode == HAMMING:
        coded = lambda rows, *names: rows.withColumns({c: kmer_code(F.col(c)) for c in names})
        parts, entries = coded(parts, "left", "right"), coded(entries, "left_ctx", "right_ctx")
        near = [F.col("right_ctx"), F.col("left_ctx")]
    else:
        near = [F.left("right_ctx", F.lit(k)), F.right("left_ctx", F.lit(k))]
    left, right = by_hot_keys(parts, entries, per_task)
    # errors as columns of their own, so that what they cost is paid once
    hits = left.join(right, ["kmer", "salt"]).withColumn("to_right", context_errors("right", "right_ctx", k, max_errors, mode)).withColumn("to_left", context_errors("left", "left_ctx", k, max_errors, mode))

    def side(name: str, errors: Column, pos: Column, at: Column, neighbour: Column) -> Column:
        beside = [neighbour.alias("neighbour"), (whole if name == "L" else F.lit(None).cast("int")).alias("both")] if neighbours else []
        return F.when((errors <= max_errors) & (errors >= F.col("least")), F.struct(F.lit(name).alias("side"), pos.alias("ref_pos"), at.alias("query_pos"), errors.alias("errors"), *beside))

    to_right, to_left = F.col("to_right"), F.col("to_left")
    worse = F.greatest(to_left, to_right)  # of a k-mer with both neighbours: the middle one of three
    whole = F.when(F.col("left").isNotNull() & F.col("right").isNotNull() & (worse <= max_errors), worse).cast("int")
    r = side("R", to_right, F.col("pos"), F.col("start") + F.col("at"), near[0])
    f = side("L", to_left, F.col("pos") - k, F.col("start") + F.col("at") - k, near[1])
    found = hits.select("read_id", "win", "cand_id", "cand_strand", F.explode(F.filter(F.array(r, f), lambda x: x.isNotNull())).alias("x"))
    return found.select("read_id", "win", "cand_id", "cand_strand", "x.*").filter("ref_pos >= 0")


def cap_neighbours(found: DataFrame, cap: int) -> DataFrame:
    """Of the seeds (with neighbours) of one k-mer of a window the first `cap` of each different neighbour k-mer, in the
    order of candidates: the operator's own limit on what a repeat can give."""
    w = Window.partitionBy("read_id", "win", "side", "query_pos", "neighbour").orderBy("cand_id", "cand_strand", "ref_pos")
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r", "neighbour")


def escalate(found: DataFrame, max_errors: int, enough: int) -> DataFrame:
    """Of each window the seeds up to the least number of errors that gives `enough` of them (else all). If as many middle
    k-mers have both neighbours within those errors (both, if seeds tell), only their left seeds."""
    w = Window.partitionBy("read_id", "win")
    n = lambda c, j: F.sum((F.col(c) <= j).cast("int")).over(w)
    level = F.lit(max_errors)
    for j in reversed(range(max_errors)):
        level = F.when(n("errors", j) >= enough, j).otherwise(level)
    rows = found.withColumn("level", level)
    if "both" not in found.columns:
        return rows.filter("errors <= level")
    rows = rows.withColumn("_whole", F.sum((F.col("both") <= F.col("level")).cast("int")).over(w))
    return rows.filter(F.when(F.col("_whole") >= enough, F.col("both") <= F.col("level")).otherwise(F.col("errors") <= F.col("level"))).drop("both", "_whole")


def candidates(found: DataFrame, reads: DataFrame, stranded: DataFrame, min_overlap: int, min_share: float, slack: int = 0) -> DataFrame:
    """(read_id, cand_id, cand_strand, shift1, shift2, max_overlap): seeds with enough left of the candidate behind them
    (`slack` bases less, for deletions), gathered; b starts at a[shift]."""
    na = reads.select("read_id", F.length("seq").alias("na"))
    nb = stranded.select(F.col("read_id").alias("cand_id"), F.col("strand").alias("cand_strand"), F.length("seq").alias("nb"))
    rows = found.join(na, "read_id").join(nb, ["cand_id", "cand_strand"])
    least = F.greatest(F.lit(min_overlap), F.floor(F.lit(min_share) * F.col("na"))) - slack
    shift = F.col("query_pos") - F.col("ref_pos")
    out = rows.filter(F.col("nb") - F.col("ref_pos") >= least).groupBy("read_id", "cand_id", "cand_strand").agg(F.min(shift).alias("shift1"), F.max(shift).alias("shift2"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return out.withColumn("max_overlap", max_overlap(F.col("na"), F.col("nb"), F.col("shift1"), F.col("shift2"))).drop("na", "nb")


def cap_candidates(cands: DataFrame, cap: int) -> DataFrame:
    """The `cap` candidates of each read with the longest overlaps (the operator's own limit, off where cap is huge)."""
    w = Window.partitionBy("read_id").orderBy(F.col("max_overlap").desc(), "cand_id", "cand_strand")
    return cands.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def without_self(cands: DataFrame) -> DataFrame:
    return cands.filter(~((F.col("cand_id") == F.col("read_id")) & (F.col("cand_strand") == "+")))
