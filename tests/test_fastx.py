from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.sources import fastx


def records(text):
    return list(fastx.parse(text.split("\n")))


def test_fasta_over_lines_and_blank_lines():
    assert records(">a x\nAC\n\nGT\n>b\nTT\n") == [(">a x", "ACGT", None, None), (">b", "TT", None, None)]


def test_empty_record_before_the_end():
    assert records(">a\n>b\nACGT") == [(">a", "A", None, None), (">b", "ACGT", None, None)]


def test_quality_may_begin_with_the_mark():
    assert records("@a\nACGT\n+\n@III\n@b\nAC\n+b\nI\nI\n") == [("@a", "ACGT", "+", "@III"), ("@b", "AC", "+b", "II")]


@pytest.mark.parametrize("text", ["@a\nACGT\n+\nII\n", "ACGT\n"])
def test_errors(text):
    with pytest.raises(fastx.FormatError):
        records(text)


def test_nothing():
    assert records("") == []


def test_source_round_trip(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a len=4\nACGT\n+\nIIII\n@b\nGG\n+\n@I\n")
    (tmp_path / "b.fa").write_text(">c\nAC\nGT\n")
    spark.dataSource.register(fastx.FastxSource)
    rows = spark.read.format("fastx").load(str(tmp_path / "*.f*"))
    assert rows.count() == 3
    other = fastx.read_fastx(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fa"))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, other.collect()), key=str)
    rows.filter("file_id = 0").coalesce(1).write.format("fastx").mode("append").save(str(tmp_path / "out"))
    again = spark.read.format("fastx").load(str(tmp_path / "out" / "*.fastx"))
    assert sorted(r.seq for r in again.collect()) == ["ACGT", "GG"]
    text = [r.value for r in fastx.record_text(rows).collect()]
    assert "@b\nGG\n+\n@I" in text and ">c\nACGT" in text
    assert fastx.read_genome(spark, str(tmp_path / "b.fa")).first().g == "ACGT"


def test_alignment_text(spark):
    reads = spark.createDataFrame([(1, "ACGT"), (2, "TT")], "read_id long, seq string")
    maps = "array<struct<strand:string,start:int,len:int>>"
    aligned = spark.createDataFrame([(1, 0, [("+", 3, 4)]), (2, 1, [("+", 5, 2), ("-", 7, 2)])], f"read_id long, edit int, maps {maps}")
    text = fastx.alignment_text(reads, aligned, 10)
    assert sorted(r.value for r in text.collect()) == ["ACGT 0 0", "TT 1 2 6:2 19:2"]
    back = {r.seq: (r.edit, [tuple(m) for m in r.maps]) for r in fastx.parse_alignment(text, 10).collect()}
    assert back == {"ACGT": (0, []), "TT": (1, [("+", 5, 2), ("-", 7, 2)])}


def test_evaluation_text(spark):
    rows = spark.createDataFrame([(1, "ACG", 1, "ACT", 0, 1, 2, "TP")], "read_id long, org string, e1 int, fixed string, e2 int, opers int, trimmed int, cls string")
    assert fastx.evaluation_text(rows).first().value == "1) ACG[1] ACT[0] {TP,1,2}"
    assert fastx.sniff(">x") == "fasta"


def in_splits(spark, tmp_path, name, text, size):
    """Records of a file that Spark reads in splits of so many bytes."""
    (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = fastx.read_fastx(spark, str(tmp_path / name))
        return [tuple(r)[2:] for r in rows.orderBy("read_id").collect()], [r.read_id for r in rows.orderBy("read_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_files_in_splits(spark, tmp_path, size):
    seqs = ["ACGT" * (i % 9) + "G" * (i % 4) for i in range(60)]
    wrapped = lambda s: "\n".join(s[i : i + 10] for i in range(0, len(s), 10))
    fasta = "".join(f">r{i} x\n{wrapped(s)}\n\n" for i, s in enumerate(seqs))
    fastq = "".join(f"@r{i}\n{s}A\n+\n{'@' * (len(s) + 1)}\n" for i, s in enumerate(seqs))
    odd = "".join(f"@r{i}\n{wrapped(s + 'A')}\n+r\n{wrapped('+' * (len(s) + 1))}\n" for i, s in enumerate(seqs))
    for name, text in (("a.fa", fasta), ("b.fq", fastq), ("c.fq", odd), ("d.fa", ">x\nAC\n>y"), ("e.fa", ">x\n>y\nA")):
        got, ids = in_splits(spark, tmp_path, name, text, size)
        assert got == records(text) and ids == list(range(len(got)))


def test_files_that_are_neither(spark, tmp_path):
    (tmp_path / "x.txt").write_text("ACGT\n")
    (tmp_path / "y.fq").write_text("@a\nACGT\n+\nII\n")
    (tmp_path / "z.fa").write_text("\n\n")
    with pytest.raises(fastx.FormatError):
        fastx.read_fastx(spark, str(tmp_path / "x.txt"))
    with pytest.raises(Exception, match="differ in length"):
        fastx.read_fastx(spark, str(tmp_path / "y.fq")).collect()
    assert fastx.read_fastx(spark, str(tmp_path / "z.fa")).count() == 0


@pytest.mark.parametrize("size", [9, 100_000])
def test_references_in_splits(spark, tmp_path, size):
    lines = ["ACGTACG"[: i % 8] for i in range(40)]
    (tmp_path / "g.fa").write_text(">c1\n" + "\n".join(lines[:20]) + "\n>c2\n" + "\n".join(lines[20:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    rows = sorted(fastx.read_genome(spark, str(tmp_path / "g.fa")).collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "".join(r.g for r in rows) == "".join(lines) and [r.at for r in rows] == [sum(len(x.g) for x in rows[:i]) for i in range(len(rows))]


def test_chunks_of_a_reference(spark):
    from strandline.operators.placement import reference_chunks

    g = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(157))
    minus = g[::-1].translate(str.maketrans("ACGT", "TGCA"))
    whole = spark.createDataFrame([(g,)], "g string")
    parts = spark.createDataFrame([(i, g[i : i + 13]) for i in range(0, 157, 13)], "at long, g string")
    for genome in (whole, parts):
        for over in (0, 5, 20):
            got = {(r.strand, r.chunk): r.g for r in reference_chunks(genome, over, 20).collect()}
            assert got == {(s, c): text[20 * c : 20 * c + 20 + over] for s, text in (("+", g), ("-", minus)) for c in range(8)}
