"""FASTA, FASTQ, QUAL, alignment and evaluation files.

Files are read in splits, as Spark deals them: a first pass counts the lines and headers of each split, so each task
knows which record its first line belongs to, and only records on a split's border are put together after a shuffle. FASTQ
with four lines a record is read so; where sequences or qualities span lines, a quality line may begin with a header's
mark, and only a reader that began at the file's start can tell: such a file is read by one task. Registering FastxSource
gives spark.read.format("fastx"), a file a task, and a writer.
"""

from __future__ import annotations

import glob
import itertools
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file_id int, read_id long, info string, seq string, qual_info string, qual string"


class FormatError(ValueError):
    """A file that isn't FASTA or FASTQ, or a quality of another length than its sequence."""


def sniff(first_line: str) -> str:
    if first_line[:1] == ">":
        return "fasta"
    if first_line[:1] == "@":
        return "fastq"
    raise FormatError("neither FASTA nor FASTQ")


def parse(lines: Iterable[str]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(info, seq, qual_info, qual). Blank lines don't count. An empty sequence before the file's end is a read A of
    quality I; a quality of another length than the sequence is an error."""
    rows = (x.strip("\r\n") for x in lines)
    rows = (x.lstrip() for x in rows if x.strip())
    first = next(rows, None)
    if first is None:
        return
    kind, info = sniff(first), first
    mark = ">" if kind == "fasta" else "@"
    while info is not None:
        seq: list[str] = []
        qual: list[str] = []
        plus, nxt = None, None
        for x in rows:
            if plus is None:
                if kind == "fasta" and x[0] == mark:
                    nxt = x
                    break
                if kind == "fastq" and x[0] == "+":
                    plus = x
                    need = sum(map(len, seq))
                else:
                    seq.append(x)
            elif x[0] == mark and sum(map(len, qual)) >= need:
                nxt = x
                break
            else:
                qual.append(x)
        s, q = "".join(seq), "".join(qual)
        if not s and nxt is not None:
            s, q = "A", "I"
        if kind == "fastq" and len(q) != len(s):
            raise FormatError(f"quality and sequence differ in length: {info}")
        yield (info, s, plus, q) if kind == "fastq" else (info, s, None, None)
        info = nxt


def format_record(info: str, seq: str, qual_info: str | None, qual: str | None) -> str:
    return f"{info}\n{seq}\n" if qual is None else f"{info}\n{seq}\n{qual_info or '+'}\n{qual}\n"


@dataclass
class _File(InputPartition):
    file_id: int
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        paths = [p for x in options["path"].split(",") for p in (sorted(glob.glob(x)) or [x])]
        self.files = [_File(i, p) for i, p in enumerate(paths)]

    def partitions(self) -> list[_File]:
        return self.files

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding="latin-1") as lines:
            for i, record in enumerate(parse(lines)):
                yield (partition.file_id, i, *record)


@dataclass
class _Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """A part file for each task, renamed when it is whole, so a task that is run again leaves no half of one."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{context.partitionId():05d}")
        with open(f"{name}.{context.taskAttemptId()}.tmp", "w", encoding="latin-1") as out:
            for r in rows:
                out.write(format_record(r["info"], r["seq"], r["qual_info"] if "qual_info" in r else None, r["qual"] if "qual" in r else None))
        os.replace(out.name, f"{name}.fastx")
        return _Written(f"{name}.fastx")

    def commit(self, messages: list) -> None:
        kept = {m.path for m in messages if m is not None}
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "part-*")):
                if old not in kept:
                    os.remove(old)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class FastxSource(DataSource):
    """Paths on a file system that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options, overwrite)


def _lines(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """(path, block, i, x): lines that aren't blank, without blanks before them; i orders the lines of a split (block)."""
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", r"^\s+", "").alias("x"))
    return rows.filter("x <> ''")


def _splits(lines: DataFrame) -> DataFrame:
    """(path, block, kind, first_line, first_record, first_base, n_records): of each split that has lines the file's first
    character, how many lines, headers and bases of other lines come before it, and the file's headers: a row a split."""
    header = F.col("x").startswith(">")
    found = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.count_if(header).alias("h"), F.sum(F.when(header, 0).otherwise(F.length("x"))).alias("b"), F.min_by(F.left("x", F.lit(1)), "i").alias("mark"))
    w = Window.partitionBy("path").orderBy("block")
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.select("path", "block", F.first("mark").over(w).alias("kind"), before("n").alias("first_line"), before("h").alias("first_record"), before("b").alias("first_base"), F.sum("h").over(Window.partitionBy("path")).alias("n_records"))


_PARTS = "path string, block long, read_id long, whole boolean, n_records long, info string, seq string, qual_info string, qual string"


def _split_records(kind: str, sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of splits' lines in order: whole ones, and the parts of those that may begin or end in another split."""

    def split(path: str, block: int, line: int, record: int, total: int, rows: Iterable[str]) -> Iterator[tuple]:
        if kind == "@":
            held: list[str | None] = [None] * 4
            for x in rows:
                held[line % 4] = x
                line += 1
                if line % 4 == 0:
                    yield (path, block, line // 4 - 1, None not in held, total, *held)
                    held = [None] * 4
            if line % 4 and any(x is not None for x in held):
                yield (path, block, line // 4, False, total, *held)
            return
        info, seq, record = None, [], record - 1
        for x in rows:
            if x[0] != ">":
                seq.append(x)
                continue
            if info is not None or seq:
                yield (path, block, record, info is not None, total, info, sep.join(seq), None, None)
            info, seq, record = x, [], record + 1
        if info is not None or seq:
            yield (path, block, record, False, total, info, sep.join(seq), None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for key, group in itertools.groupby(lines, key=lambda r: r[:5]):
            for r in split(*key, (x[5].rstrip("\r\n") for x in group)):
                out.append(r)
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PARTS.split(", ")])


def _records(spark: SparkSession, paths: tuple[str, ...], kind: str, sep: str = "") -> DataFrame:
    """(path, read_id, info, seq, qual_info, qual) of files of one kind, read in splits."""
    lines = _lines(spark, paths)
    # a row for each split of the input; joined by broadcast, the lines stay in order
    splits = F.broadcast(_splits(lines).select("path", "block", "first_line", "first_record", "n_records"))
    given = lines.join(splits, ["path", "block"]).select("path", "block", "first_line", "first_record", "n_records", "x")
    parts = given.mapInArrow(_split_records(kind, sep), _PARTS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") != "", F.struct("block", "seq")))), lambda x: x["seq"]), sep)
    one = parts.filter("NOT whole").groupBy("path", "read_id").agg(F.max("n_records").alias("n_records"), F.max("info").alias("info"), joined.alias("seq"), F.max("qual_info").alias("qual_info"), F.max("qual").alias("qual"))
    columns = ["path", "read_id", "n_records", "info", "seq", "qual_info", "qual"]
    rows = parts.filter("whole").select(*columns).unionByName(one.select(*columns))
    if kind == ">" and not sep:  # an empty sequence before the file's last record is a read A
        rows = rows.withColumn("seq", F.when((F.col("seq") == "") & (F.col("read_id") < F.col("n_records") - 1), "A").otherwise(F.col("seq")))
    return rows.drop("n_records")


def _whole_files(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """The same of files that are read by one task each."""
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    @F.pandas_udf("array<struct<read_id:bigint,info:string,seq:string,qual_info:string,qual:string>>")
    def records(value: pd.Series) -> pd.Series:
        names = ("read_id", "info", "seq", "qual_info", "qual")
        return pd.Series([[dict(zip(names, (i, *r), strict=True)) for i, r in enumerate(parse(v.split("\n")))] for v in value])

    return files.select("path", F.explode(records("value")).alias("r")).select("path", "r.*")


def read_fastx(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of files in any store that Spark reads: (file_id, read_id, info, seq, qual_info, qual), file_id the place
    of their path among those given, read_id theirs in their file."""
    kinds = {r["path"]: r["kind"] for r in _splits(_lines(spark, paths)).select("path", "kind").distinct().collect()}  # a row for each file
    for mark in kinds.values():
        sniff(mark)
    chosen = {k: tuple(sorted(p for p, mark in kinds.items() if mark == k)) for k in "@>"}
    tables = []
    if chosen["@"]:
        rows = _records(spark, chosen["@"], "@")
        well = F.col("info").startswith("@") & F.col("qual_info").startswith("+") & (F.length("seq") == F.length("qual"))
        odd = {r["path"] for r in rows.filter(~F.coalesce(well, F.lit(False))).select("path").distinct().collect()}
        if odd:
            tables.append(_whole_files(spark, tuple(sorted(odd))))
        if odd != set(chosen["@"]):
            tables.append(rows if not odd else _records(spark, tuple(p for p in chosen["@"] if p not in odd), "@"))
    if chosen[">"]:
        tables.append(_records(spark, chosen[">"], ">"))
    if not tables:
        return spark.createDataFrame([], SCHEMA)
    place = F.lit(len(paths))
    for p, i in sorted(((p, i) for i, p in enumerate(paths)), key=lambda x: -x[1]):
        place = F.when(F.col("path").endswith(p.split("://")[-1]), i).otherwise(place)
    rows = reduce(DataFrame.unionByName, tables)
    return rows.select(place.cast("int").alias("file_id"), "read_id", "info", "seq", "qual_info", "qual")


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, info, qual_text) of a QUAL file: the numbers of a record's lines, with blanks between them."""
    return _records(spark, (path,), ">", " ").select("read_id", "info", F.col("seq").alias("qual_text"))


def record_text(records: DataFrame) -> DataFrame:
    """(value): a record as text, for df.write.text; FASTQ where there is a quality."""
    has = "qual" in records.columns
    fasta = F.concat_ws("\n", "info", "seq")
    if not has:
        return records.select(fasta.alias("value"))
    return records.select(F.when(F.col("qual").isNull(), fasta).otherwise(F.concat_ws("\n", "info", "seq", F.coalesce("qual_info", F.lit("+")) if "qual_info" in records.columns else F.lit("+"), "qual")).alias("value"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """(at, g): all lines that aren't headers, in file order, put together to stretches; at is a stretch's first base."""
    lines = _lines(spark, (path,))
    splits = F.broadcast(_splits(lines).select("path", "block", "first_base"))
    given = lines.join(splits, ["path", "block"]).select("block", "first_base", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, at), group in itertools.groupby(lines, key=lambda r: r[:2]):
            held: list[str] = []
            size = 0
            for _, _, x in group:
                if x[0] != ">":
                    held.append(x.rstrip("\r\n"))
                    size += len(held[-1])
                if size >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array([at], type=pa.int64()), pa.array(["".join(held)])], names=["at", "g"])
                    at, held, size = at + size, [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([at], type=pa.int64()), pa.array(["".join(held)])], names=["at", "g"])

    return given.mapInArrow(run, "at long, g string")


def alignment_text(reads: DataFrame, aligned: DataFrame, whole: int) -> DataFrame:
    """(value): 'seq edit n start:len ...' of placed reads; exact ones have no places listed. A start counts in the text of
    a mark, the reference of `whole` bases, a mark and its reverse complement."""
    start = lambda m: m["start"] + F.when(m["strand"] == "+", 1).otherwise(whole + 2)
    maps = F.array_join(F.transform("maps", lambda m: F.concat(start(m).cast("string"), F.lit(":"), m["len"].cast("string"))), " ")
    rest = F.when(F.col("edit") == 0, F.lit("0")).otherwise(F.concat_ws(" ", F.size("maps").cast("string"), maps))
    return aligned.join(reads.select("read_id", "seq"), "read_id").select(F.concat_ws(" ", "seq", F.col("edit").cast("string"), rest).alias("value"))


def parse_alignment(lines: DataFrame, whole: int) -> DataFrame:
    """(seq, edit, maps) of alignment text on a reference of `whole` bases."""
    t = F.split(F.trim("value"), r"\s+")
    at = lambda x: F.split(x, ":")[0].cast("long")
    place = lambda x: F.struct(F.when(at(x) > whole, "-").otherwise("+").alias("strand"), (at(x) - F.when(at(x) > whole, whole + 2).otherwise(1)).cast("int").alias("start"), F.split(x, ":")[1].cast("int").alias("len"))
    maps = F.transform(F.filter(t, lambda x: x.contains(":")), place)
    return lines.filter(F.trim("value") != "").select(t[0].alias("seq"), t[1].cast("int").alias("edit"), maps.alias("maps"))


def evaluation_text(evaluated: DataFrame) -> DataFrame:
    """(value): 'n) original[e1] corrected[e2] {class,operations,trimmed}' of evaluated reads, in their order n."""
    return evaluated.select(F.format_string("%d) %s[%d] %s[%d] {%s,%d,%d}", "read_id", "org", "e1", "fixed", "e2", "cls", "opers", "trimmed").alias("value"))


def evaluation_summary(summary: DataFrame) -> DataFrame:
    """(value): the lines below the reads, of evaluation.summary's one row."""
    share = lambda n, of: F.round(100 * F.try_divide(F.col(n).cast("double"), F.nullif(F.col(of), F.lit(0))), 4)
    line = lambda name, n, of: F.concat_ws(" ", F.lit(name), F.col(n).cast("string"), F.lit("of"), F.col(of).cast("string"), F.coalesce(share(n, of).cast("string"), F.lit("-")), F.lit("%"))
    rows = [line("trimmed bases", "trimmed", "n_bases"), line("trimmed bases of right reads", "trimmed_right", "n_bases_right")]
    for part, of in (("read", "n_reads"), ("base", "n_bases_left")):
        rows += [line(f"{part}s {c.upper()}", f"{part}_{c}", of) for c in ("tn", "tp", "fp", "fn")]
        rows += [F.concat_ws(" ", F.lit(f"{part}s {m}"), F.coalesce(F.round(100 * F.col(f"{part}_{m}"), 4).cast("string"), F.lit("-")), F.lit("%")) for m in ("recall", "precision", "f_score", "gain")]
    return summary.select(F.posexplode(F.array(*rows)).alias("i", "value")).orderBy("i").select("value")
