"""Toxicity: logistic regression fitted by FTRL-proximal over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate and an L1 threshold, so that only n-grams seen in several labelled texts get
a weight; the model that is sent to the executors is the list of those. Fitting uses a bounded sample of labelled texts
(about `at_most` of each label, by the smallest hash of doc_id, and `most_ids` features in all), scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import WordTable, crc_rest, give_back, hold, in_one_task, map_texts, sampled, table

BITS = 20
#: Labelled texts of each label that the model is fitted on, about at most (the error is that of a random sample).
AT_MOST = {1: 3000, 0: 6000}
#: Distinct features of all texts of the sample together, at most; texts past that, in the order of the hash, aren't learnt.
MOST_IDS = 40_000_000

_WORDS = re.compile(r"\w+")
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Lengths of word beginnings that count as crude stems, beside the word itself.
STEMS = (4, 5)


def _hash(word: str) -> list[int]:
    return [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), seed=n) for n, w in ((0, word), *((n, word[:n]) for n in STEMS))]


_TABLE = WordTable(_hash, 1 + len(STEMS))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed ids of words and their stems, of pairs of neighbours, and of pairs with one word between; with repetitions."""
    every = _TABLE(_WORDS.findall((text or "").lower()))
    h = every[:, 0]
    down = np.uint64(64 - bits)
    parts = [(every.ravel() * _MULTIPLIERS[0]) >> down]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(((h[:-gap] * _MULTIPLIERS[0] + h[gap:] + np.uint64(gap)) * _MULTIPLIERS[1]) >> down)
    return np.concatenate(parts).astype(np.int32)


@dataclass
class Ftrl:
    """FTRL-proximal with binary features and a bias that L1 doesn't touch."""

    bits: int = BITS
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.5
    epochs: int = 5

    def fit(self, rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids with a weight, the weights, the bias, of rows of different ids, which are shortened in place. Ids in under three texts can't pass L1 in any useful way and are left out."""
        size = (1 << self.bits) + 1
        bias = size - 1
        n_docs = np.zeros(size, dtype=np.int32)
        for r in rows:
            n_docs[r] += 1
        for k, r in enumerate(rows):  # in place: what is left out needn't be held twice
            rows[k] = np.append(r[n_docs[r] >= 3], bias)
        z, n = np.zeros(size), np.zeros(size)
        l1 = np.full(size, self.l1)
        l1[bias] = 0.0

        def weights(i: np.ndarray) -> np.ndarray:
            zi, over = z[i], l1[i]
            w = -(zi - np.sign(zi) * over) / ((self.beta + np.sqrt(n[i])) / self.alpha + self.l2)
            return np.where(np.abs(zi) <= over, 0.0, w)

        order = np.random.default_rng(7)
        for _ in range(self.epochs):
            for k in order.permutation(len(rows)):
                i = rows[k]
                w = weights(i)
                p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
                g = p - labels[k]
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / self.alpha
                z[i] += g - sigma * w
                n[i] += g * g
        every = weights(np.arange(size))
        ids = np.flatnonzero(every[:-1])
        return ids.astype(np.int32), every[ids].astype(np.float32), float(every[bias])


def fit(docs: DataFrame, labels: DataFrame, at_most: dict[int, int] | None = None, model: Ftrl | None = None, most_ids: int = MOST_IDS) -> tuple[np.ndarray, np.ndarray, float]:
    """A model of docs (doc_id, text) and labels (doc_id, toxic: 0 or 1).

    Labels that are null, without an id or neither 0 nor 1 are left out; a document with both labels counts as toxic. Of
    rows with one doc_id and different texts the one with the least list of features is learnt, repeated rows once. A
    null text counts as empty. No labels at all give a model that scores everything 0.5 (a bias of 0).

    The labels to learn from are settled before any text is read; the choice, sum(at_most.values()) rows, is broadcast.
    One task fits the model; the driver gets its non-zero weights."""
    model = model or Ftrl()
    at_most = at_most or AT_MOST
    bits = model.bits
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = reduce(DataFrame.unionByName, [sampled(known.filter(F.col("toxic") == label), "toxic", most, "doc_id") for label, most in at_most.items()])
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make() -> Callable[[list[str | None]], list[list]]:
        hold("toxicity", _TABLE.forget)
        return lambda texts: [[np.unique(features(t, bits)).tobytes() for t in texts]]

    rows = map_texts(some, ["doc_id", "toxic"], "ids binary", make).groupBy("doc_id").agg(F.min(F.struct("ids", "toxic")).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity fit", give_back)
        ids: list[np.ndarray] = []
        toxic: list[int] = []
        held = 0
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                one = np.frombuffer(x.as_buffer(), dtype=np.int32)
                held += len(one)
                if held <= most_ids:
                    ids.append(one.copy())
                    toxic.append(y)
        found, weights, bias = model.fit(ids, np.asarray(toxic, dtype=float))
        ids.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), type=pa.int32()), pa.array(np.append(weights, bias), type=pa.float64())], names=["id", "w"])

    got = in_one_task(rows.select("doc_id", "row.ids", "row.toxic").select("ids", "toxic", "doc_id"), [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")], run, "id int, w double")
    weights = {r["id"]: r["w"] for r in got}
    bias = weights.pop(-1, 0.0)
    return np.fromiter(weights, dtype=np.int32, count=len(weights)), np.fromiter(weights.values(), dtype=np.float32, count=len(weights)), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """Rows (*keep, score): the probability that the text is toxic. Null and empty texts get the bias alone. Repeated
    rows get the same score; a null doc_id doesn't matter; columns that aren't kept aren't read, and those that are may
    have any name but that of the score. Empty table: no rows."""
    ids, weights, bias = model

    def make() -> Callable[[list[str | None]], list[list]]:
        hold("toxicity", _TABLE.forget)
        dense = np.zeros(1 << bits, dtype=np.float32)
        dense[ids] = weights

        def one(text: str | None) -> float:
            f = features(text, bits)
            hit = np.unique(f[dense[f] != 0])
            return float(1.0 / (1.0 + np.exp(-np.clip(bias + float(dense[hit].sum(dtype=np.float64)), -35, 35))))

        return lambda texts: [[one(t) for t in texts]]

    return map_texts(docs, keep or ["doc_id"], "score double", make)


def fit_tables(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, np.ndarray, float]:
    """The model for the tables documents and labels, without the labels that are held out."""
    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(crc_rest("doc_id", 5) != 0))


def op9_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_tables(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    return score(docs, model).select("doc_id", F.coalesce(crc_rest("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
