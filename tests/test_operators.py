from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import sequence as sq
from strandline.operators import etl, evaluation, kmers, overlaps, placement
from strandline.plans.correction import Options, correct, derived


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, sq.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert one(spark, sq.kmer_code(F.lit("ACGT"))) == 120
    assert one(spark, sq.kmer_code(F.lit("NCGT"))) == 120
    assert one(spark, sq.kmer_text(F.lit(120), 4)) == "ACGT"
    assert one(spark, sq.normalize(F.lit("acgTx-"))) == "ACGTNN"
    assert one(spark, sq.right_probability(F.lit(0))) == 0.1
    assert one(spark, sq.with_length(F.lit("@r len=36 x"), F.lit(30))) == "@r len=30 x"
    assert one(spark, sq.with_length(F.lit("@r length=36"), F.lit(5))) == "@r length=5"
    assert one(spark, sq.with_length(F.lit("@r"), F.lit(5))) == "@r"
    assert one(spark, sq.bare_id(F.lit("@c1/2 rest"))) == "@c1"
    assert one(spark, sq.ordinals_quality(F.array(F.lit(-3), F.lit(0), F.lit(200)))) == "!!~"
    assert one(spark, sq.overlap_weight(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, sq.max_overlap(F.lit(10), F.lit(8), F.lit(5), F.lit(6))) == 5


def test_short_reads_have_no_kmers(spark):
    reads = spark.createDataFrame([(1, "ACG"), (2, ""), (3, "ACGTA")], "read_id long, seq string")
    rows = kmers.explode_kmers(kmers.strands(reads), 4, 2).collect()
    assert {r.read_id for r in rows} == {3} and len(rows) == 4
    first = next(r for r in rows if r.strand == "+" and r.pos == 0)
    assert (first.kmer, first.left_ctx, first.right_ctx) == ("ACGT", "AA", "AA")


def test_sample(spark):
    rows = spark.range(8).withColumnRenamed("id", "ordinal")
    assert [r.ordinal for r in etl.systematic_sample(rows, 250).orderBy("ordinal").collect()] == [3, 7]
    assert etl.systematic_sample(rows, 0).count() == 8


def test_runs_of_equal_ids(spark):
    rows = spark.createDataFrame([(i, f"@{c}/1", "A") for i, c in enumerate("aaabba")], "read_id long, info string, seq string")
    assert [r.part for r in etl.split_paired(rows).orderBy("read_id").collect()] == ["pair", "pair", "frag", "pair", "pair", "frag"]


def test_numbered_merge_takes_b_first(spark):
    a = spark.createDataFrame([(0, "@r x y 1", "A"), (1, "@r x y 3", "C")], "read_id long, info string, seq string")
    b = spark.createDataFrame([(0, "@r x y 1", "G")], "read_id long, info string, seq string")
    assert [r.seq for r in etl.merge_numbered(a, b).collect()] == ["G", "A", "C"]


def test_interleave_goes_on_alone(spark):
    a = spark.createDataFrame([(0, "@a", "A"), (1, "@b", "C")], "read_id long, info string, seq string")
    b = spark.createDataFrame([(0, "@x", "G")], "read_id long, info string, seq string")
    assert [r.seq for r in etl.interleave(a, b).orderBy("read_id", "side").collect()] == ["A", "G", "C"]


def test_windows_cover_the_read(spark):
    reads = spark.createDataFrame([(n, "A" * n) for n in (17, 18, 26, 27, 80, 101)], "read_id long, seq string")
    rows = overlaps.query_windows(reads, 9).orderBy("read_id", "win").collect()
    by = {}
    for r in rows:
        by.setdefault(r.read_id, []).append((r.start, r.parts))
    assert 17 not in by and by[18] == [(0, 2)] and by[27] == [(0, 3)]
    for n in (26, 80, 101):
        starts, size = [s for s, _ in by[n]], 9 * by[n][0][1]
        assert starts[0] == 0 and starts[-1] + size == n and all(9 <= size - (b - a) for a, b in zip(starts, starts[1:], strict=False))


def test_undefined_measures_are_null(spark):
    row = evaluation.with_measures(spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")).first()
    assert row.recall is None and row.gain is None and row.specificity == 1.0


def test_base_confusion(spark):
    rows = spark.createDataFrame([(1, 0, 1, 10), (2, 1, 1, 10), (0, 1, 1, 10)], "e1 int, e2 int, opers int, n int")
    r = evaluation.base_confusion(rows).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2.0, 1.0, 1.0, 26.0)


def test_reads_without_candidates_stay(spark):
    reads = spark.createDataFrame([(1, "ACGTACGTACGTACGTA"), (2, "")], "read_id long, seq string")
    for match in ("hamming", "edit"):
        got = {r.read_id: r.seq for r in correct(reads, Options(match=match)).collect()}
        assert got == {1: "ACGTACGTACGTACGTA", 2: ""}


def test_derived_options():
    o = derived(Options(), 40, 10**9, None)
    assert o.min_overlap == 28 and o.kmer == 10 and round(o.reserve, 6) == 4.2


def test_placement_on_both_strands(spark):
    genome = spark.createDataFrame([("ACGTTGCAAGCTTAGGCATCGATTACGGATCC",)], "g string")
    reads = spark.createDataFrame([(1, "GCAAGCTTAGGC"), (2, "GGATCCGTAATC"), (3, "GCAAGATTAGGC"), (4, "TTTTTTTTTTTT")], "read_id long, seq string")
    got = {(r.read_id, r.edit, r.strand, r.start) for r in placement.align_hamming(reads, genome, 1, 6).collect()}
    assert got == {(1, 0, "+", 5), (2, 0, "-", 0), (3, 1, "+", 5)}
    edit = {r.read_id: r.edit for r in placement.align_edit(reads, genome, 2, 4).collect()}
    assert edit == {1: 0, 2: 0, 3: 1}


def test_error_in_the_middle_kmer_is_seeded(spark):
    from strandline.plans.correction import find_candidates, stranded

    a = "ACGTTGCAAGCTTAGGCATCGATTACG"
    reads = spark.createDataFrame([(1, a), (2, a[:13] + "C" + a[14:])], "read_id long, seq string")
    options = Options(kmer=9, min_overlap=20)
    assert {(r.read_id, r.cand_id, r.shift1, r.shift2) for r in find_candidates(reads, stranded(reads, options), options).collect()} >= {(1, 2, 0, 0), (2, 1, 0, 0)}
    index = kmers.explode_kmers(reads.withColumn("strand", F.lit("+")), 9, 9)
    rows = overlaps.seeds(overlaps.window_parts(reads.filter("read_id = 1"), 9), index, 9, 2).filter("cand_id = 2").collect()
    assert {(r.side, r.ref_pos, r.query_pos, r.errors) for r in rows} == {("R", 0, 0, 1), ("L", 9, 9, 1)}


def test_contexts_are_compared_by_the_mode_of_the_correction(spark):
    from strandline.operators import distance as d

    pairs = [("ACGTACGTA", "ACGGTACGTAC"), ("ACGTACGTA", "ACTACGTACCC"), ("ACGTACGTA", "ACGTACGTAGG"), ("ACGTACGTA", "ACCTACGTAGG"), ("TTTTTTTTT", "ACCTACGTAGG")]
    for mode in (d.EDIT, d.INSDEL):
        for context, turn in (("right_ctx", lambda x: x), ("left_ctx", lambda x: x[::-1])):
            rows = spark.createDataFrame([(i, turn(a), turn(b)) for i, (a, b) in enumerate(pairs)], f"i int, part string, {context} string")
            got = {r.i: r.e for r in rows.select("i", overlaps.context_errors("part", context, 9, 2, mode).alias("e")).collect()}
            want = {i: d.flexible_end(b, a, 99, mode) for i, (a, b) in enumerate(pairs)}
            assert {i: e for i, e in got.items() if e <= 2} == {i: e for i, e in want.items() if e <= 2} and set(got) == set(want)


def test_insertions_beside_a_seed_and_the_insdel_mode(spark):
    from strandline.operators import distance as d
    from strandline.operators import edit_graph
    from strandline.plans.correction import find_candidates, stranded

    a = "ACGTTGCAAGCTTAGGCATCGATTACG"
    b = a[:3] + "A" + a[3:22] + "G" + a[22:]  # one base inserted beside the middle k-mer on either side
    reads = spark.createDataFrame([(1, a), (2, b)], "read_id long, seq string")
    for match in ("edit", "insdel"):
        options = Options(match=match, min_overlap=20)
        assert {(r.read_id, r.cand_id) for r in find_candidates(reads, stranded(reads, options), options).collect()} >= {(1, 2)}
    assert [op for _, op, _ in d.edit_script("ACGTA", "ACCTA", d.INSDEL)].count("S") == 0 and len(d.edit_script("ACGTA", "ACCTA", d.INSDEL)) == 2
    assert edit_graph.overlap_path(a, a[:20] + "T" + a[21:], 9, 0.25, 10, d.INSDEL)[3] == 2


def test_error_limits_follow_the_reads_length(spark):
    genome = spark.createDataFrame([("ACGTTGCAAGCTTAGGCATCGATTACGGATCC",)], "g string")
    g = genome.first().g
    reads = spark.createDataFrame([(1, g[5:17]), (2, g[5:8] + "T" + g[9:17]), (3, g[20:25]), (4, ""), (5, g[2:10] + g[11:22]), (6, "TTTTTTTTTTTTTTTTTTT")], "read_id long, seq string")
    edit = {r.read_id: (r.edit, {(m.strand, m.start, m.len) for m in r.maps}) for r in placement.align_edit(reads, genome, 3, 6).collect()}
    assert edit[1] == (0, {("+", 5, 12)}) and edit[2][0] == 1 and edit[3] == (0, {("+", 20, 5)}) and edit[5][0] == 1
    assert ("+", 2, 20) in edit[5][1] and set(edit) == {1, 2, 3, 5}
    many = spark.createDataFrame([(1, "".join("CATG"["ACGT".index(c)] if i % 5 == 4 else c for i, c in enumerate(g)))], "read_id long, seq string")
    assert placement.align_edit(many, genome, None, 4).first().edit == 6
    rows = placement.align_edit(reads.filter("read_id IN (2, 5)"), genome, None, 6, "hamming").collect()
    assert [(r.read_id, r.edit, [tuple(m) for m in r.maps]) for r in rows] == [(2, 1, [("+", 5, 12)])]


def test_long_qualities_stay_whole(spark):
    rows = spark.range(1).select(F.col("id").alias("read_id"), F.lit("@a/1 x").alias("info"), F.expr("repeat('A', 1100000)").alias("seq"), F.expr("concat('@', repeat('I', 1099999))").alias("qual"))
    assert etl.adjust_quality(rows).select(F.length("qual").alias("n"), F.substring("qual", 1, 2).alias("b")).first() == (1_100_000, "AI")
    assert etl.to_fasta(rows).first().info == ">a/1 x" and etl.pair_ids(rows.withColumn("ordinal", F.col("read_id"))).first().id_a == "a/1"


def seeds_by_hand(reads, k, most, mode, results):
    """Candidates (read, candidate, strand) -> (least shift, greatest shift, longest overlap), by plain loops."""
    from collections import Counter, defaultdict

    from strandline.operators import distance as d

    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    both = {(i, strand): s if strand == "+" else turn(s) for i, s in reads.items() for strand in "+-"}
    context = k + (0 if mode == d.HAMMING else most)
    out = {}
    for i, s in reads.items():
        n = len(s)
        parts = 3 if n >= 3 * k else 2 if n >= 2 * k else 0
        if not parts:
            continue
        size = parts * k
        m = -(-(n - k) // (size - k))
        extra, starts = m * size - n, [0]
        for w in range(1, m):
            starts.append(starts[-1] + size - (extra + w - 1) // (m - 1))
        found = []
        for w, start in enumerate(starts):
            p = [s[start + j * k : start + (j + 1) * k] for j in range(parts)]
            # an equal k-mer, the one beside it, on which side, where the seed lies in the query, the fewest errors
            wanted = [(p[0], p[1], "R", start, 0), (p[1], p[0], "L", start, 0)] if parts == 2 else [(p[1], p[2], "R", start + k, 0), (p[1], p[0], "L", start, 0), (p[0], p[1], "R", start, 1), (p[2], p[1], "L", start + k, 1)]
            per, hits, sides = Counter(), [], defaultdict(dict)
            for (c, strand), t in sorted(both.items()):
                for at in range(len(t) - k + 1):
                    for kmer, beside, side, query, least in wanted:
                        if t[at : at + k] != kmer:
                            continue
                        there = t[at + k : at + k + context].ljust(context, "A") if side == "R" else t[max(0, at - context) : at].rjust(context, "A")[::-1]
                        own = beside if side == "R" else beside[::-1]
                        e = sum(x != y for x, y in zip(own, there, strict=True)) if mode == d.HAMMING else d.flexible_end(there, own, most, mode)
                        ref = at if side == "R" else at - k
                        if parts == 3 and kmer == p[1] and not least and e <= most:
                            sides[c, strand, at][side] = e
                        if least <= e <= most and ref >= 0:
                            key = (side, query, there[:k])
                            per[key] += 1
                            if per[key] <= results:
                                hits.append((e, c, strand, ref, query, at if side == "L" and not least else None))
            level = next((j for j in range(most) if sum(h[0] <= j for h in hits) >= results), most)
            hits = [h for h in hits if h[0] <= level]
            # k-mers of the middle with both neighbours near enough: if there are many, only those
            whole = [h for h in hits if h[5] is not None and len(x := sides[h[1], h[2], h[5]]) == 2 and max(x.values()) <= level]
            found += [h[:5] for h in (whole if len(whole) >= results else hits)]
        shifts = defaultdict(list)
        for _, c, strand, ref, query in found:
            least = max(20, int(0.2 * n)) - (0 if mode == d.HAMMING else most)
            if len(both[c, strand]) - ref >= least and (c, strand) != (i, "+"):
                shifts[c, strand].append(query - ref)
        for (c, strand), x in shifts.items():
            nb = len(both[c, strand])
            longest = min(n - min(x), nb) if min(x) > 0 else min(nb + max(x), n) if max(x) < 0 else min(n, nb)
            out[i, c, strand] = (min(x), max(x), longest)
    return out, both


def test_corrections_by_hand(spark):
    """Candidates and corrected reads of all modes against plain loops."""
    import random

    from strandline.operators import edit_graph
    from strandline.plans.correction import find_candidates, stranded

    rng = random.Random(5)
    genome = "".join(rng.choice("ACGT") for _ in range(160))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = {}
    for i in range(36):
        at = rng.randrange(100)
        s = list(genome[at : at + rng.choice((20, 45, 60))])
        for _ in range(i % 3):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice(([], [rng.choice("ACGT")], [s[p], rng.choice("ACGT")]))
        reads[i] = "".join(s) if i % 4 else turn("".join(s))
    df = spark.createDataFrame(list(reads.items()), "read_id long, seq string")
    for mode in ("hamming", "edit", "insdel"):
        options = Options(match=mode, min_overlap=20, max_kmer_results=12)
        want, both = seeds_by_hand(reads, 9, 2, mode, 12)
        rows = find_candidates(df, stranded(df, options), options).collect()
        assert {(r.read_id, r.cand_id, r.cand_strand): (r.shift1, r.shift2, r.max_overlap) for r in rows} == want
        if mode == "hamming":
            continue
        how = edit_graph.EditOptions(9, 0.25, 20, 0.2, 0.0, mode, 100.0, 1.0)
        fixed = {}
        for i, s in reads.items():
            mine = sorted((-x[2], c, strand) for (j, c, strand), x in want.items() if j == i)
            fixed[i] = edit_graph.correct_read(s, [(both[c, strand], None) for _, c, strand in mine], how)[0]
        got = {r.read_id: r.seq for r in correct(df, options).collect()}
        assert got == fixed and sum(got[i] != s for i, s in reads.items()) > 3


def test_reads_with_and_without_quality(spark):
    truth = "ACGTTGCAAGCTTAGGCATCGATTACGGATCCATGCAAGTCCATTGAC"
    wrong = truth[:20] + "G" + truth[21:]
    rows = [(i, truth, "I" * 48 if i % 2 else None) for i in range(5)] + [(9, wrong, "I" * 20 + "#" + "I" * 27)]
    reads = spark.createDataFrame(rows, "read_id long, seq string, qual string")
    for match in ("hamming", "edit"):
        got = {r.read_id: (r.seq, r.qual) for r in correct(reads, Options(match=match, min_overlap=20)).collect()}
        assert got[9][0] == truth and len(got[9][1]) == 48 and got[1] == (truth, "I" * 48) and got[0] == (truth, None)
        short = {r.read_id: (r.seq, r.qual) for r in correct(reads, Options(match=match, min_overlap=20, trim=True, trim_factor=0.5)).collect()}
        assert all(q is None or len(q) == len(s) for s, q in short.values())


def test_hot_kmers_are_dealt(spark):
    """Seeds don't depend on how many rows of a k-mer go to a task."""
    reads = spark.createDataFrame([(i, "ACGTTGCAAGCTTAGGCATCGATTACG"[i % 3 :] + "ACGT" * (i % 4)) for i in range(12)], "read_id long, seq string")
    index = kmers.explode_kmers(kmers.strands(reads), 9, 9)
    rows = [sorted(map(tuple, overlaps.seeds(overlaps.window_parts(reads, 9), index, 9, 2, per_task=n).collect())) for n in (1, 2, 100_000)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == len(set(rows[0])) > 20


def test_records_beyond_the_headers_and_unknown_ones(spark):
    import pytest

    rows = lambda *x: spark.createDataFrame(x, "read_id long, info string, seq string")
    got = etl.replace_headers(rows((0, "@a len=9", "A")), rows((0, ">x", "ACG"), (1, ">y len=1", "AC"))).orderBy("read_id").collect()
    assert [(r.info, r.seq) for r in got] == [(">a len=3", "ACG"), (">y len=2", "AC")]
    original = rows((0, "@a", "A"), (1, "@b", "C"))
    found = etl.restore_order(original, rows((0, "@b len=1 x", "G")), rows((0, "@a more", "T"))).orderBy("read_id").collect()
    assert [(r.info, r.seq) for r in found] == [("@a more", "T"), ("@b len=1 x", "G")]
    with pytest.raises(Exception, match="unknown header"):
        etl.restore_order(original, rows((0, "@b", "G")), rows((0, "@c", "T"))).collect()
    with pytest.raises(Exception, match="no such quality"):
        etl.zip_quality(rows((0, ">a", "A")), spark.createDataFrame([(0, "94")], "read_id long, qual_text string")).collect()


def test_judged_corrections():
    from strandline.operators import distance as d

    truth, wrong = "ACGTTGCAAGCTTAGG", "ACGTTGCATGCTTAGG"
    assert evaluation.judge(truth, truth, 0, []) == (0, 0, 0, 0)
    assert evaluation.judge(wrong, truth, 1, [truth]) == (0, 1, 0, 1)
    assert evaluation.judge(truth, wrong, 0, []) == (1, 1, 0, 0)
    assert evaluation.judge(wrong, truth + "A", 1, [truth], d.HAMMING) == (16, 16, 0, 1)
    assert evaluation.judge(wrong, truth[:12], 1, [truth], trim=True) == (0, 1, 4, 1)
    assert evaluation.judge(truth, truth[3:], 0, [], trim=True) == (0, 0, 3, 0)
    # the error of the original is in what was trimmed
    assert evaluation.judge(wrong, truth[:8], 1, [truth], trim=True) == (0, 0, 8, 0)
