"""What the corpus operators share: tables, samples, components of a link graph, what workers remember."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandline.sources.staging import Stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_rest(doc_id: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n: the fixed split of learning rows from held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def sampled(df: DataFrame, by: str, at_most: int, key: str) -> DataFrame:
    """About `at_most` rows of each value of `by` (all where there are fewer), those with the smallest hashes of `key`:
    the counts of the values say below which hash that many are to be expected. With different keys the number is off by
    six standard errors, 6 * sqrt(at_most), less than once in a billion samples. No row is shuffled. The counts, a row
    for each value, are broadcast: a caller's model has a row for each value anyway."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    lot = F.xxhash64(F.col(key).cast("string")).cast("double") / 2.0**64 + 0.5
    return df.join(F.broadcast(counts), by).filter(lot * F.col("_n") < at_most).drop("_n")


def in_one_task(rows: DataFrame, order: list[Column], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> list:
    """What run makes of a bounded number of rows, read in a fixed order by one task: where a model is fitted, so that
    the driver holds nothing but the model."""
    return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, schema).collect()


def components(spark: SparkSession, stage: Stage, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges(a, b): node, root. Each round hooks a node to its neighbour of least hash (if less
    than its own), which joins a constant share of the remaining nodes, then contracts the graph; the rounds grow with
    the logarithm of the number of nodes. Everything stays in tables; a star's hub is one row of a partial aggregate."""
    e = stage.write(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges0")
    roots = None
    k = 0
    while not e.isEmpty():
        h = lambda c: F.xxhash64(F.col(c), F.lit(k))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(h("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(h("a").alias("h"), F.col("a").alias("n"))
        up = stage.write(least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["n"].alias("up")), f"{name}-up{k}")
        if roots is None:
            new = up.withColumnRenamed("up", "root")
        else:
            new = roots.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        roots = stage.write(new, f"{name}-roots{k + 1}")
        ua, ub = up.select(F.col("node").alias("a"), F.col("up").alias("a2")), up.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        low, high = F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")
        e = stage.write(e.join(ua, "a").join(ub, "b").filter("a2 <> b2").select(low, high).distinct(), f"{name}-edges{k + 1}")
        for old in (f"{name}-edges{k}", f"{name}-up{k}", *([f"{name}-roots{k}"] if k else [])):
            stage.drop(old)
        k += 1
    if roots is None:
        return spark.createDataFrame([], "node long, root long")
    return roots


def map_texts(docs: DataFrame, keep: list[str], added: str, make: Callable[[], Callable[[list[str | None]], list[list]]]) -> DataFrame:
    """Rows (*keep, *added): the kept columns as they are, and what a Python function says of each whole text. make() is
    called once in each task and gives the function, from a batch's texts to one list for each added column. A kept
    column that is called like an added one is left out."""
    keep = [c for c in keep if c.lower() not in {f.name.lower() for f in T.StructType.fromDDL(added)}]
    given = docs.select(*(docs[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)), docs["text"].cast("string").alias("t"))
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*given.schema.fields[:-1], *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields))])
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = make()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):  # a part at a time, for what it becomes may be larger than the texts
                batch = whole.slice(at, 1000)
                found = say(batch.column(n).to_pylist())
                arrays = [batch.column(i) for i in range(n)] + [pa.array(x, type=kind) for x, kind in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f"k{i}" for i in range(n)] + [f"n{i}" for i in range(len(kinds))])

    return given.mapInArrow(run, schema).toDF(*keep, *new.fieldNames())


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, forget: Callable[[], None]) -> None:
    """Says that this worker process now remembers something for the operator `name`, and how to forget it. What it holds
    for others is forgotten: Spark keeps workers between stages, so their memories would add up."""
    others = [k for k in _HELD if k != name]
    for k in others:
        _HELD.pop(k)()
    _HELD[name] = forget
    if others:
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class WordTable:
    """Numbers of each distinct word, kept between texts within a bound; one array row for each word of a text."""

    def __init__(self, say: Callable[[str], list[int]], width: int, most: int = 250_000):
        self.say, self.most, self.width = say, most, width
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((self.most, self.width), dtype=np.uint64)

    def __call__(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        try:
            return self.table[np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))]
        except KeyError:
            new = {w for w in words if w not in rows}
        if len(rows) + len(new) > self.most:
            rows.clear()
            new = set(words)
            if len(new) > self.most:  # one text with more words than are ever kept
                return np.asarray([self.say(w) for w in words], dtype=np.uint64)
        at = len(rows)
        self.table[at : at + len(new)] = [self.say(w) for w in new]
        rows.update(zip(new, range(at, at + len(new)), strict=True))
        return self.table[np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))]
