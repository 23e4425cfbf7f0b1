"""Command line: correct, align, eval, merge. `python -m strandline.cli correct -inputfile=a.fq -celltype=haploid ...`"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import normalize, with_length
from strandline.operators import etl, evaluation, kmers, placement
from strandline.plans.correction import Options, correct, derived
from strandline.sources import fastx

# The options of each verb.
OPTIONS = {
    "correct": "inputfile celltype matchtype inputdir resultdir resultprefix tempdir threads memory aggressive numstages minoverlap minoverlapper minreadweigth errorrate errorratesec reserveval reserveper estcov usequal higherror trim trimfact kmer kmererrors kmerfactor maxkmerslots maxkmerres maxlenmatches readsperstep fbs cbs nocomp",
    "align": "inputfile refgenomefile alignfile matchtype inputdir threads readsperstep accuracy circular",
    "eval": "inputfile resultfile refgenomefile alignfile evalfile matchtype inputdir resultdir threads readsperstep circular trim",
    "merge": "inputfile outfile hshrec quake fastaqual replaceinfo paired splitpaired splitpairs outpairids oneseq sample outfasta outfastq outqual adjustqual noqualinfo unknownchar",
}
#: Options that say how the other tool uses one machine; Spark decides that, so they have no effect and are warned of.
WITHOUT_EFFECT = ("tempdir", "threads", "memory", "readsperstep", "fbs", "cbs")
NEEDED = {"correct": ("inputfile", "celltype", "matchtype"), "align": ("inputfile", "refgenomefile", "alignfile", "matchtype"), "eval": ("inputfile", "resultfile", "refgenomefile", "evalfile"), "merge": ("inputfile", "outfile")}


def parse(verb: str, args: list[str]) -> dict[str, list[str]]:
    """Options as lists of values; an unknown or missing one is an error."""
    if verb not in OPTIONS:
        raise SystemExit(f"unknown verb {verb}: one of {', '.join(OPTIONS)}")
    out: dict[str, list[str]] = {}
    for a in args:
        name, _, value = a.lstrip("-").partition("=")
        if name not in OPTIONS[verb].split():
            raise SystemExit(f"unknown option {a}")
        out.setdefault(name, []).append(value or "yes")
    for name in NEEDED[verb]:
        if name not in out:
            raise SystemExit(f"{verb} needs -{name}")
    for name in out:
        if name in WITHOUT_EFFECT:
            print(f"-{name} has no effect", file=sys.stderr)
    folders = {"inputfile": "inputdir", "refgenomefile": "inputdir", "alignfile": "inputdir", "resultfile": "resultdir"} if verb == "eval" else {"inputfile": "inputdir", "refgenomefile": "inputdir"}
    for name, folder in folders.items():
        if name in out and folder in out:
            out[name] = [x if "://" in x or x.startswith("/") else f"{out[folder][0].rstrip('/')}/{x}" for x in out[name]]
    return out


def named(path: str, suffix: str) -> str:
    """The path with a suffix before its last dot."""
    stem, dot, end = path.rpartition(".")
    return f"{stem}{suffix}{dot}{end}" if stem else path + suffix


def _reads(spark: SparkSession, *paths: str, unknown: str = "N") -> DataFrame:
    return fastx.read_fastx(spark, *paths).withColumn("seq", normalize(F.col("seq"), unknown))


def _save(records: DataFrame, path: str) -> None:
    order = [c for c in ("file_id", "ordinal", "read_id", "side") if c in records.columns]
    fastx.record_text(records.orderBy(*order)).write.mode("overwrite").text(path)


def _genome(spark: SparkSession, o: dict[str, list[str]]) -> DataFrame:
    """The reference (at, g); of a circular one the first bases again at its end."""
    circular = max(0, int(o.get("circular", ["0"])[0]))
    genome = fastx.read_genome(spark, o["refgenomefile"][0])
    if not circular:
        return genome
    whole = F.broadcast(genome.agg(F.max(F.col("at") + F.length("g")).alias("whole")))  # one row
    begin = genome.filter(F.col("at") < circular).crossJoin(whole)
    return genome.unionByName(begin.select((F.col("whole") + F.col("at")).alias("at"), F.expr(f"substring(g, 1, cast({circular} - at as int))").alias("g")))


def run_correct(spark: SparkSession, o: dict[str, list[str]]) -> None:
    get = lambda name, default: type(default)(o[name][0]) if name in o else default
    rate = 0.5 if "higherror" in o else get("errorrate", 0.25)
    stages = get("numstages", 1)
    if stages not in (1, 2):
        raise SystemExit("-numstages is 1 or 2")
    if stages == 1 and "errorratesec" in o:
        raise SystemExit("-errorratesec needs -numstages=2")
    second = 0.5 if "higherror" in o and "errorratesec" not in o else get("errorratesec", 0.25)
    base = Options(match=o["matchtype"][0], diploid=o["celltype"][0] == "diploid", kmer=get("kmer", 9), kmer_errors=get("kmererrors", 2), max_kmer_slots=get("maxkmerslots", 100_000), max_kmer_results=get("maxkmerres", 30), max_length_matches=get("maxlenmatches", 2000) * 1_000_000, min_overlap=get("minoverlap", 35), min_overlap_share=get("minoverlapper", 0.20), min_read_weight=get("minreadweigth", 0.0), error_rate=rate, reserve=get("reserveval", 100.0), reserve_share=get("reserveper", 1.0), aggressive=get("aggressive", 0.42), trim=get("trim", "no") == "yes", trim_factor=get("trimfact", 2.5), use_quality=get("usequal", "yes") == "yes", both_strands="nocomp" not in o)
    folder, prefix = get("resultdir", "."), get("resultprefix", "corrected_")
    # reads of all files correct each other; a number made of file and place tells them apart
    paths = o["inputfile"]
    records = _reads(spark, *paths).withColumn("place", F.col("read_id")).withColumn("read_id", F.shiftleft(F.col("file_id").cast("long"), 40) + F.col("read_id")).persist()
    has_quality = records.filter("qual IS NOT NULL").limit(1).count() > 0
    now = records.select("read_id", "seq", *(["qual"] if has_quality else []))
    # the second stage corrects what the first one gave, and derives its parameters anew
    for stage in range(stages):
        options = base if stage == 0 else replace(base, error_rate=second)
        mean = now.agg(F.expr("coalesce(sum(length(seq)) div count(1), 0)")).first()[0]
        total = kmers.totals(now, base.kmer).first()
        cover = kmers.coverage(spark, now).first()["coverage"] if get("estcov", "yes") == "yes" else None
        now = correct(now, derived(options, mean, total["num_kmers"] or 0, cover, get("kmerfactor", 1000))).persist()
    out = records.drop("seq", "qual").join(now, "read_id").withColumn("info", with_length(F.col("info"), F.length("seq"))).withColumn("read_id", F.col("place")).drop("place")
    for i, path in enumerate(paths):
        _save(out.filter(F.col("file_id") == i), f"{folder}/{prefix}{path.rsplit('/', 1)[-1]}")
    records.unpersist()


def genome_size(genome: DataFrame) -> int:
    return genome.agg(F.sum(F.length("g"))).first()[0] or 0


def part_size(whole: int, accuracy: int) -> int:
    """Least part of a read that is aligned: the steps of 4 up to the size of both strands' text, less the accuracy."""
    size, steps = 2 * whole + 4, 0
    while 4**steps < size:
        steps += 1
    return max(1, steps - accuracy)


def run_align(spark: SparkSession, o: dict[str, list[str]]) -> None:
    genome = _genome(spark, o)
    whole = genome_size(genome)
    q = part_size(whole, int(o.get("accuracy", ["5"])[0]))
    for path, out in zip(o["inputfile"], o["alignfile"], strict=True):
        reads = _reads(spark, path)
        aligned = placement.align_edit(reads, genome, None, q, o["matchtype"][0])
        fastx.alignment_text(reads, aligned, whole).write.mode("overwrite").text(out)


def run_eval(spark: SparkSession, o: dict[str, list[str]]) -> None:
    """All inputs, results and alignments in their order; without alignment files the reads are aligned here."""
    genome = _genome(spark, o)
    whole = genome_size(genome)
    mode, trim = o.get("matchtype", ["edit"])[0], o.get("trim", ["no"])[0] == "yes"
    if not len(o["inputfile"]) == len(o["resultfile"]) == len(o["evalfile"]) == len(o.get("alignfile", o["inputfile"])):
        raise SystemExit("eval needs as many result, alignment and evaluation files as inputs")
    for i, (path, fixed, out) in enumerate(zip(o["inputfile"], o["resultfile"], o["evalfile"], strict=True)):
        reads = _reads(spark, path)
        if "alignfile" in o:
            # equal reads have equal places, so a read's line is any with its sequence
            lines = fastx.parse_alignment(spark.read.text(o["alignfile"][i]), whole).groupBy("seq").agg(F.min(F.struct("edit", "maps")).alias("x")).select("seq", "x.*")
            aligned = reads.select("read_id", "seq").join(lines, "seq").select("read_id", "edit", "maps")
        else:
            aligned = placement.align_edit(reads, genome, None, part_size(whole, 5), mode)
        done = evaluation.evaluate_placed(reads, _reads(spark, fixed), aligned, genome, mode, trim).persist()
        fastx.evaluation_text(done.orderBy("read_id")).write.mode("overwrite").text(out)
        fastx.evaluation_summary(evaluation.summary(done)).coalesce(1).write.mode("overwrite").text(out + ".summary")
        done.unpersist()


def run_merge(spark: SparkSession, o: dict[str, list[str]]) -> None:
    files, out = o["inputfile"], o["outfile"][0]
    load = lambda p: _reads(spark, p, unknown=o["unknownchar"][0]) if "unknownchar" in o else fastx.read_fastx(spark, p)
    a = load(files[0])
    b = load(files[1]) if len(files) > 1 and "fastaqual" not in o else None
    if "hshrec" in o:
        done = etl.merge_numbered(a.select("read_id", "info", "seq"), b.select("read_id", "info", "seq"))
        return fastx.record_text(done).write.mode("overwrite").text(out)
    if "quake" in o:
        done = etl.restore_order(a, b, load(files[2]))
    elif "fastaqual" in o:
        done = etl.zip_quality(a, fastx.read_quality(spark, files[1]))
    elif "replaceinfo" in o:
        done = etl.replace_headers(a, b)
    elif "paired" in o:
        done = etl.interleave(a, b)
    elif "splitpaired" in o:
        done = etl.split_paired(a)
        for part in ("pair", "frag"):
            _save(done.filter(F.col("part") == part), named(out, f"_{part}"))
        return None
    elif "splitpairs" in o:
        done = etl.split_pairs(etl.running_ordinal(a, ["read_id"]))
        for side in (1, 2):
            _save(done.filter(F.col("side") == side), named(out, f"_{side}"))
        return None
    elif "outpairids" in o:
        ids = etl.pair_ids(etl.running_ordinal(a, ["read_id"])).orderBy("pair")
        return ids.select(F.concat_ws(" ", "id_a", "id_b").alias("value")).write.mode("overwrite").text(named(out, "_pids"))
    else:
        done = etl.concat_files([load(p).drop("file_id") for p in files])
        if "oneseq" in o:
            done = etl.one_sequence(done, ["file_id", "read_id"]).withColumn("read_id", F.lit(0))
        elif "sample" in o:
            done = etl.systematic_sample(etl.running_ordinal(done, ["file_id", "read_id"]), int(o["sample"][0]))
    if "adjustqual" in o and "qual" in done.columns:
        done = etl.adjust_quality(done)
    if "noqualinfo" in o:
        done = etl.bare_quality_header(done)
    if "outfasta" in o:
        done = etl.to_fasta(done)
    elif "outfastq" in o:
        done = etl.to_fastq(done)
    elif "outqual" in o:
        etl.quality_text(done).select(F.concat_ws("\n", "info", "qual_text").alias("value")).write.mode("overwrite").text((out.rpartition(".")[0] or out) + ".qual")
    return _save(done, out)


VERBS: dict[str, Callable[[SparkSession, dict[str, list[str]]], None]] = {"correct": run_correct, "align": run_align, "eval": run_eval, "merge": run_merge}


def main(argv: list[str]) -> None:
    if not argv:
        raise SystemExit(f"verbs: {', '.join(OPTIONS)}")
    options = parse(argv[0], argv[1:])
    VERBS[argv[0]](SparkSession.builder.appName("strandline").getOrCreate(), options)


if __name__ == "__main__":
    main(sys.argv[1:])
