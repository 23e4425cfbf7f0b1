from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline import cli
from strandline.operators.kmers import kmer_counts
from strandline.streaming.reads import place_batches, read_stream, running_kmer_counts


def test_options_are_checked():
    assert cli.parse("merge", ["-inputfile=a", "-inputfile=b", "-outfile=o", "-paired"])["inputfile"] == ["a", "b"]
    for verb, args in (("nothing", []), ("merge", ["-bad=1"]), ("correct", ["-inputfile=a"])):
        with pytest.raises(SystemExit):
            cli.parse(verb, args)


def test_verbs(spark, tmp_path):
    genome = "ACGTTGCAAGCTTAGGCATCGATTACGGATCCATGCAAGTCCATTGACCGTAGGATACCAGTTGACATTGCCAGATTACAGGCTAACGTTAGCCATGGACTTACGA"
    reads = [genome[i : i + 60] for i in range(0, len(genome) - 60, 3)]
    wrong = reads[5][:30] + ("A" if reads[5][30] != "A" else "C") + reads[5][31:]
    reads[5] = wrong
    (tmp_path / "g.fa").write_text(f">g\n{genome}\n")
    (tmp_path / "r.fa").write_text("".join(f">r{i} len=60\n{s}\n" for i, s in enumerate(reads)))
    run = lambda verb, *args: cli.VERBS[verb](spark, cli.parse(verb, list(args)))
    run("correct", f"-inputfile={tmp_path}/r.fa", "-celltype=haploid", "-matchtype=hamming", f"-resultdir={tmp_path}", "-estcov=no")
    lines = [x for r in spark.read.text(f"{tmp_path}/corrected_r.fa").collect() for x in r.value.split("\n")]
    assert genome[15:75] in lines and wrong not in lines
    run("align", f"-inputfile={tmp_path}/r.fa", f"-refgenomefile={tmp_path}/g.fa", f"-alignfile={tmp_path}/al", "-matchtype=edit", "-accuracy=2")
    assert spark.read.text(f"{tmp_path}/al").count() == len(reads)
    run("merge", f"-inputfile={tmp_path}/r.fa", f"-outfile={tmp_path}/fq", "-outfastq", "-sample=500")
    assert "I" * 60 in [r.value for r in spark.read.text(f"{tmp_path}/fq").collect()]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ACGTAC"), (2, "CGTACG"), (3, "TTTTTT")], "read_id long, seq string")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = running_kmer_counts(read_stream(spark, str(tmp_path / "in")), 3).writeStream.outputMode("complete").format("memory").queryName("kmers").start()
    q.processAllAvailable()
    q.stop()
    want = {r.kmer: r.n for r in kmer_counts(rows, 3).collect()}
    assert {r.kmer: r.n for r in spark.sql("SELECT * FROM kmers").collect()} == want

    genome = spark.createDataFrame([("GGACGTACGG",)], "g string")
    seen = []
    q = read_stream(spark, str(tmp_path / "in")).writeStream.foreachBatch(place_batches(genome, 0, 6, lambda df, _: seen.extend(df.collect()))).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.read_id, r.strand, r.start) for r in seen} >= {(1, "+", 2), (2, "+", 3)}


def test_stages_and_circular_references(spark, tmp_path, monkeypatch):
    genome = "ACGTTGCAAGCTTAGGCATCGATTACGGATCCATGCAAGTCCATTGACCGTAGGATACC"
    across = genome[-15:] + genome[:15]
    (tmp_path / "g.fa").write_text(f">g\n{genome}\n")
    (tmp_path / "r.fa").write_text(f">r0\n{across}\n")
    run = lambda verb, *args: cli.VERBS[verb](spark, cli.parse(verb, list(args)))
    run("align", f"-inputfile={tmp_path}/r.fa", f"-refgenomefile={tmp_path}/g.fa", f"-alignfile={tmp_path}/al", "-matchtype=hamming", "-accuracy=0", "-circular=20")
    assert [r.value for r in spark.read.text(f"{tmp_path}/al").collect()] == [f"{across} 0 0"]
    rates = []
    monkeypatch.setattr(cli, "correct", lambda reads, options: rates.append(options.error_rate) or reads.select("read_id", F.concat("seq", F.lit("A")).alias("seq")))
    common = ("correct", f"-inputfile={tmp_path}/r.fa", "-celltype=haploid", "-matchtype=hamming", f"-resultdir={tmp_path}", "-estcov=no")
    run(*common, "-numstages=2", "-errorrate=0.3", "-errorratesec=0.1")
    assert rates == [0.3, 0.1]
    assert across + "AA" in [x for r in spark.read.text(f"{tmp_path}/corrected_r.fa").collect() for x in r.value.split("\n")]
    with pytest.raises(SystemExit):
        run(*common, "-errorratesec=0.1")


def test_files_correct_each_other_and_are_evaluated(spark, tmp_path):
    """Two files that hold half of the reads each: reads of both correct each other; eval takes the alignment files."""
    genome = "ACGTTGCAAGCTTAGGCATCGATTACGGATCCATGCAAGTCCATTGACCGTAGGATACCAGTTGACATTGCCAGATTACAGGCTAACGTTAGCCATGGACTTACGA"
    reads = [genome[i : i + 60] for i in range(0, len(genome) - 60, 3)]
    wrong = dict(enumerate(reads)) | {4: reads[4][:30] + ("A" if reads[4][30] != "A" else "C") + reads[4][31:]}
    (tmp_path / "g.fa").write_text(f">g\n{genome}\n")
    for half in (0, 1):
        (tmp_path / f"r{half}.fq").write_text("".join(f"@r{i} len=60\n{wrong[i]}\n+\n{'I' * 60}\n" for i in range(half, len(reads), 2)))
    run = lambda verb, *args: cli.VERBS[verb](spark, cli.parse(verb, list(args)))
    lines = lambda p: [x for r in spark.read.text(str(tmp_path / p)).collect() for x in r.value.split("\n")]
    files = [f"-inputfile=r{half}.fq" for half in (0, 1)]
    for match in ("edit", "hamming"):
        run("correct", *files, f"-inputdir={tmp_path}", "-celltype=haploid", f"-matchtype={match}", f"-resultdir={tmp_path}", f"-resultprefix={match}_", "-estcov=no")
        got = {half: lines(f"{match}_r{half}.fq") for half in (0, 1)}
        for half in (0, 1):
            assert got[half] == [x for i in range(half, len(reads), 2) for x in (f"@r{i} len=60", reads[i], "+", "I" * 60)]
    run("align", *files, f"-inputdir={tmp_path}", "-refgenomefile=g.fa", f"-alignfile={tmp_path}/al0", f"-alignfile={tmp_path}/al1", "-matchtype=edit", "-accuracy=2")
    results = [f"-resultfile=edit_r{half}.fq" for half in (0, 1)]
    aligned = [f"-alignfile=al{half}" for half in (0, 1)]
    out = [f"-evalfile={tmp_path}/ev{half}" for half in (0, 1)]
    for more in ([], ["-trim=yes"]):
        run("eval", *files, *results, *aligned, *out, f"-inputdir={tmp_path}", f"-resultdir={tmp_path}", "-refgenomefile=g.fa", "-matchtype=edit", *more)
        assert lines("ev0") == [f"{k}) {wrong[i]}[{int(i == 4)}] {reads[i]}[0] {{{'TP' if i == 4 else 'TN'},{int(i == 4)},0}}" for k, i in enumerate(range(0, len(reads), 2))]
        summary = lines("ev0.summary")
        assert "reads TP 1 of 8 12.5 %" in summary and "bases recall 100.0 %" in summary and "trimmed bases 0 of 480 0.0 %" in summary
    assert cli.named("a/b.fq", "_frag") == "a/b_frag.fq" and cli.named("b", "_1") == "b_1"
    with pytest.raises(SystemExit):
        run("eval", files[0], *results, out[0], f"-inputdir={tmp_path}", f"-resultdir={tmp_path}", "-refgenomefile=g.fa")


def test_table_function(spark):
    from strandline.operators import kmers

    kmers.register(spark)
    rows = spark.sql("SELECT t.id, x.* FROM VALUES (1, 'ACGTA'), (2, 'AC'), (3, NULL) AS t(id, s), LATERAL kmers(s, 3) AS x").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "ACG"), (1, 1, "CGT"), (1, 2, "GTA")]
