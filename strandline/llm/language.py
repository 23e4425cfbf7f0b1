"""Hierarchical language identification with linear support vector machines.

Texts become relative frequencies of hashed letter n-grams (one to three letters, words framed by blanks) and of words.
One machine for each language family (one against the rest) decides the family, then one-versus-one machines inside that
family vote on the language. Training uses a bounded sample of labelled texts; predictions read whole texts, and see
nothing but the text.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import crc_rest, in_one_task, map_texts, sampled, table

BITS = 16
#: Labelled texts of each language that the machines are fitted on, about at most (the error is that of a random sample).
AT_MOST = 1500
#: Features of all texts of the sample together, at most; texts past that, in the order of the hash, aren't learnt.
MOST_IDS = 20_000_000
#: Families of languages; a language named nowhere is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "am", "mt"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
}
UNDETERMINED = "und"

_RUNS = re.compile(r"[^\W\d_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def letters(text: str) -> list[str]:
    """Runs of letters in lower case. Superscripts, fractions, circled and Roman number signs aren't letters."""
    words = _RUNS.findall(text.lower())
    return words if "".join(words).isalpha() else "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def ngrams(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed ids of all n-grams of one to three letters and of all words (by their own hash), case folded."""
    words = letters(text)
    if not words:
        return np.zeros(0, dtype=np.int32)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    down = np.uint64(64 - bits)
    two = c[:-1] * _A + c[1:]
    three = two[:-1] * _A + c[2:]
    parts = [(c[c != 32] * _B) >> down, (two * _B) >> down, (three * _B + three) * _A >> down]
    # a word's hash is a sum over its letters, each weighted by its place, so all words are hashed at once
    gaps = np.flatnonzero(c == 32)
    place = np.arange(len(c), dtype=np.uint64) - np.repeat(gaps, np.diff(np.append(gaps, len(c)))).astype(np.uint64)
    mixed = (c + np.uint64(7)) * (place * _A + _B)
    mixed ^= mixed >> np.uint64(29)
    parts.append((np.add.reduceat(mixed * _A, gaps[:-1]) * _B) >> down)
    return np.concatenate(parts).astype(np.int32)


def vector(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and square roots of relative frequencies: a vector of length 1."""
    ids, n = np.unique(ngrams(text, bits), return_counts=True)
    return ids, np.sqrt(n / n.sum()).astype(np.float32) if len(n) else n.astype(np.float32)


class Machine:
    """A linear support vector machine by stochastic subgradients (hinge loss, L2), with averaged weights."""

    def __init__(self, bits: int = BITS):
        self.w = np.zeros(1 << bits)
        self.b = 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 8, rate: float = 1.0, decay: float = 1e-4) -> Machine:
        """y: 1 or -1. Both sides count alike, whatever their numbers."""
        w, total, b, total_b, step = self.w, np.zeros_like(self.w), 0.0, 0.0, 0
        share = {s: len(y) / 2 / max(1, int((y == s).sum())) for s in (1, -1)}
        order = np.random.default_rng(11)
        last, scale = 0, 1.0
        for _ in range(rounds):
            for k in order.permutation(len(rows)):
                ids, x = rows[k]
                step += 1
                eta = rate / (1 + step * decay * 10)
                scale *= 1 - eta * decay
                if y[k] * (scale * float(w[ids] @ x) + b) < 1:
                    gain = eta * y[k] * min(share[y[k]], 10.0)
                    w[ids] += gain * x / scale
                    b += 0.1 * gain
            total += scale * w
            total_b += b
            last += 1
        self.w, self.b = total / max(1, last), total_b / max(1, last)
        return self


def families_of(langs: list[str], families: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    known = {lang: name for name, members in (families or FAMILIES).items() for lang in members}
    return {lang: known.get(lang, f"alone-{lang}") for lang in langs}


class Hierarchy:
    """What is broadcast: one weight column for each machine. Sides of a machine are named for reading the votes."""

    def __init__(self, family: dict[str, str], names: list[tuple[str, str | None, str | None]], weights: np.ndarray, biases: np.ndarray, bits: int):
        self.family, self.names, self.weights, self.biases, self.bits = family, names, weights, biases, bits

    def predict(self, text: str | None) -> tuple[str, float]:
        ids, x = vector(text or "", self.bits)
        if not len(ids) or not self.family:
            return UNDETERMINED, 0.0
        margins = dict(zip(self.names, (x @ self.weights[ids] + self.biases).tolist(), strict=True))
        groups = sorted(set(self.family.values()))
        if len(groups) > 1:
            outer = {g: margins[("family", g, None)] for g in groups}
            best = max(groups, key=lambda g: outer[g])
            second = max(v for g, v in outer.items() if g != best)
            confidence = 1 / (1 + np.exp(-2 * (outer[best] - second)))
        else:
            best, confidence = groups[0], 1.0
        langs = sorted(k for k, g in self.family.items() if g == best)
        votes, sums, least = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), dict.fromkeys(langs, np.inf)
        for a, b in combinations(langs, 2):
            m = margins[("pair", a, b)]
            votes[a if m >= 0 else b] += 1
            for lang, v in ((a, m), (b, -m)):
                sums[lang] += v
                least[lang] = min(least[lang], v)
        lang = max(langs, key=lambda k: (votes[k], sums[k], k))
        if len(langs) > 1:
            confidence *= 1 / (1 + np.exp(-4 * least[lang]))
        return lang, float(confidence)


def machines_of(rows: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, families: dict[str, tuple[str, ...]] | None, bits: int) -> Hierarchy:
    """The fitted machines of vectors and their languages; vectors without letters are left out."""
    use = [k for k, (i, _) in enumerate(rows) if len(i)]
    rows, of = [rows[k] for k in use], of[use]
    family = families_of(sorted(set(of)), families)
    groups = sorted(set(family.values()))
    names: list[tuple[str, str | None, str | None]] = []
    machines: list[Machine] = []
    group_of = np.asarray([family[x] for x in of])
    if len(groups) > 1:
        for g in groups:
            names.append(("family", g, None))
            machines.append(Machine(bits).fit(rows, np.where(group_of == g, 1, -1)))
    for g in groups:
        for a, b in combinations(sorted(k for k, v in family.items() if v == g), 2):
            at = np.flatnonzero((of == a) | (of == b))
            names.append(("pair", a, b))
            machines.append(Machine(bits).fit([rows[k] for k in at], np.where(of[at] == a, 1, -1)))
    weights = np.stack([m.w for m in machines], axis=1).astype(np.float32) if machines else np.zeros((1 << bits, 0), dtype=np.float32)
    return Hierarchy(family, names, weights, np.asarray([m.b for m in machines]), bits)


def fit(labelled: DataFrame, families: dict[str, tuple[str, ...]] | None = None, at_most: int = AT_MOST, bits: int = BITS, most_ids: int = MOST_IDS) -> Hierarchy:
    """labelled: doc_id, text, lang. Rows with a null language or id, or a text without letters, teach nothing. A
    document with several languages teaches the first in alphabetical order of those that were drawn; of rows with one
    doc_id and different texts the least vector is learnt, repeated rows once. With no rows every text is undetermined;
    with one language every text with letters is of that language. One task fits the machines."""
    known = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    chosen = sampled(known.select("doc_id", "lang"), "lang", at_most, "doc_id").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    some = known.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make() -> Callable[[list[str | None]], list[list]]:
        def say(texts: list[str | None]) -> list[list]:
            found = [vector(t or "", bits) for t in texts]
            return [[i.astype(np.int32).tobytes() for i, _ in found], [x.tobytes() for _, x in found]]

        return say

    rows = map_texts(some, ["doc_id", "lang"], "ids binary, x binary", make).groupBy("doc_id").agg(F.min(F.struct("ids", "x", "lang")).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors: list[tuple[np.ndarray, np.ndarray]] = []
        of: list[str] = []
        held = 0
        for batch in batches:
            for i, x, lang in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(i.as_buffer(), dtype=np.int32)
                held += len(ids)
                if held <= most_ids:
                    vectors.append((ids.copy(), np.frombuffer(x.as_buffer(), dtype=np.float32).copy()))
                    of.append(lang)
        model = machines_of(vectors, np.asarray(of, dtype=object), families, bits)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], type=pa.binary())], names=["model"])

    got = in_one_task(rows.select("row.ids", "row.x", "row.lang", "doc_id"), [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")], run, "model binary")
    return pickle.loads(bytes(got[0]["model"])) if got else machines_of([], np.zeros(0, dtype=object), families, bits)


def identify(docs: DataFrame, model: Hierarchy, keep: list[str] | None = None) -> DataFrame:
    """Rows (*keep, lang_pred, score). Null, empty and letterless texts: 'und' and 0. Repeated rows are predicted alike;
    a null doc_id doesn't matter; columns that aren't kept aren't read; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[str | None]], list[list]]:
        def say(texts: list[str | None]) -> list[list]:
            found = [shared.value.predict(t) for t in texts]
            return [[x for x, _ in found], [s for _, s in found]]

        return say

    return map_texts(docs, keep or ["doc_id"], "lang_pred string, score double", make)


def op3_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(F.col("doc_id").isNotNull() & (crc_rest("doc_id", 4) != 2)))
    return identify(docs, model).select("doc_id", F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
