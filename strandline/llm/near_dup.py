"""Near duplicates by ProbMinHash signatures, banding, and exact verification.

A text's shingles of five words, weighted by how often they occur, are a discrete distribution; two texts are alike as
far as their probability Jaccard similarity says. Each shingle sends a Poisson process of arrivals, at a rate equal to
its weight, to random registers; a register keeps the shingle that arrives first, and a shingle stops as soon as its
next arrival is later than every register's first. The share of equal registers estimates the similarity.

Texts with the same words in the same order are one node from the start. Nodes meet in buckets of equal bands. All
members of a bucket are first compared with one, then with four pivots, those that share most buckets with others; that
joins groups of copies at a few comparisons a member. Buckets whose members are all connected by then are settled. Each
of the rest is compared in blocks: tasks of bounded size that report edges which connect what they find linked, not the
links.
Links are those of exact similarity >= 0.8; none that a bucket holds between different components is missed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import Stage, WordTable, components, hold, map_texts, table

SHINGLE = 5
SIMILARITY = 0.8
#: What sums of rounding errors of similarities stay below.
ROUNDING = 1e-12
#: At similarity 0.8 a pair shares none of the bands with a probability of (1 - 0.8 ** 5) ** 25 = 5e-5.
BANDS, ROWS = 25, 5
#: Pivots of each bucket in the rounds before what is left is compared in blocks of BLOCK members and BLOCK_WORDS words,
#: about.
PIVOTS = (1, 4)
BLOCK = 512
BLOCK_WORDS = 1_000_000

_WORDS = re.compile(r"\w+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TABLE = WordTable(lambda w: [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))], 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_numbers(text: str | None) -> np.ndarray:
    """64-bit numbers of the lower-case words in order."""
    return _TABLE(_WORDS.findall((text or "").lower()))[:, 0]


def shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs. Fewer words than a shingle takes are one shingle."""
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    size = min(size, len(words))
    n = len(words) - size + 1
    s = words[:n].copy()
    for j in range(1, size):
        s = s * _A + words[j : j + n]
    return np.unique(_mix(s), return_counts=True)


def signature(ids: np.ndarray, weights: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash: for each register the (folded) shingle of the first arrival. ids must not be empty."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, dtype=np.uint64)
    at, w, x = np.zeros(len(ids)), weights.astype(float), ids
    k, r = 0, max(1, math.ceil(registers * 6 / len(x)))  # so many arrivals of each that all registers can be expected to fill
    while len(x):
        turn = np.arange(k + 1, k + 1 + r, dtype=np.uint64)
        bits = _mix(x[:, None] + turn[None, :] * _A)
        u = ((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        times = at[:, None] + np.cumsum(-np.log(u) / w[:, None], axis=1)
        where = (_mix(bits) % np.uint64(registers)).astype(np.int64).ravel()
        flat = times.ravel()
        order = np.argsort(-flat, kind="stable")
        new = np.full(registers, np.inf)
        new_owner = np.zeros(registers, dtype=np.uint64)
        new[where[order]] = flat[order]
        new_owner[where[order]] = np.repeat(x, r)[order]
        better = new < first
        first[better], owner[better] = new[better], new_owner[better]
        at = times[:, -1]
        on = at < first.max()
        at, w, x = at[on], w[on], x[on]
        k, r = k + r, min(2 * r, 64)
    return (owner ^ (owner >> np.uint64(32))).astype(np.uint32)


def probability_jaccard(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray) -> float:
    """Exact: the sum over common shingles i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    common, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    fa, fb = wa.astype(float), wb.astype(float)
    ca, cb = fa[ia], fb[ib]
    only_a, only_b = fa.sum() - ca.sum(), fb.sum() - cb.sum()
    total = 0.0
    ratio = ca / cb
    for q in np.unique(ratio):
        total += ca[ratio == q].sum() / (np.maximum(ca, q * cb).sum() + only_a + q * only_b)
    return float(total)


def _read(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, h1, h2, n_words, sig)."""

    def make() -> Callable[[list[str | None]], list[list]]:
        hold("near duplicates", _TABLE.forget)

        def say(texts: list[str | None]) -> list[list]:
            out: list[list] = [[], [], [], []]
            for text in texts:
                words = word_numbers(text)
                h = xxhash.xxh3_128_digest(words.tobytes())
                sig = signature(*shingles(words)).tobytes() if len(words) else b""
                for o, v in zip(out, (int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), len(words), sig), strict=True):
                    o.append(v)
            return out

        return say

    return map_texts(docs, keep, "h1 long, h2 long, n_words int, sig binary", make)


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """(uid, sig, n_words, ids, counts): shingles as bytes; counts is null where all are 1."""

    def make() -> Callable[[list[str | None]], list[list]]:
        hold("near duplicates", _TABLE.forget)

        def say(batch: list[str | None]) -> list[list]:
            found = [shingles(word_numbers(t)) for t in batch]
            return [[x.tobytes() for x, _ in found], [None if (n == 1).all() else n.astype("<u4").tobytes() for _, n in found]]

        return say

    return map_texts(texts, ["uid", "sig", "n_words"], "ids binary, counts binary", make)


def _linked(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of rows (a, b, a_ids, a_counts, b_ids, b_counts) those that are similar enough: (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(ids: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            x = np.frombuffer(ids.as_buffer(), dtype=np.uint64)
            return x, np.frombuffer(counts.as_buffer(), dtype="<u4") if counts.is_valid else np.ones(len(x))

        for batch in batches:
            a_ids, a_n, b_ids, b_n = (batch.column(i) for i in range(2, 6))
            ok = [probability_jaccard(*read(a_ids[i], a_n[i]), *read(b_ids[i], b_n[i])) >= threshold - ROUNDING for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(ok, type=pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    side = lambda c: known.select(F.col("uid").alias(c), F.col("ids").alias(f"{c}_ids"), F.col("counts").alias(f"{c}_counts"))
    return _linked(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_ids", "a_counts", "b_ids", "b_counts"), threshold)


def _block_links(frame: pd.DataFrame, threshold: float) -> list[tuple[int, int]]:
    """Edges that connect what is linked between the two sides of a frame (one side: within it), never all links. Pairs
    of one label need no comparison; signatures rule out pairs that would be six standard errors off."""
    a = frame[frame["side"] == 0]
    same = len(a) == len(frame)
    b = a if same else frame[frame["side"] == 1]
    if not len(a) or not len(b):
        return []

    def read(x: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray | None]]:
        sigs = np.stack([np.frombuffer(v, dtype=np.uint32) for v in x["sig"]])
        return sigs, [np.frombuffer(v, dtype=np.uint64) for v in x["ids"]], [None if v is None else np.frombuffer(v, dtype="<u4") for v in x["counts"]]

    sa, xa, na = read(a)
    sb, xb, nb = (sa, xa, na) if same else read(b)
    ua, ub, la, lb = a["uid"].to_numpy(), b["uid"].to_numpy(), a["label"].to_numpy(), b["label"].to_numpy()
    equal = np.zeros((len(a), len(b)), dtype=np.int16)
    for r in range(sa.shape[1]):
        equal += sa[:, r][:, None] == sb[:, r][None, :]
    m = sa.shape[1]
    able = (equal >= m * threshold - 6 * math.sqrt(m * threshold * (1 - threshold))) & (la[:, None] != lb[None, :])
    if same:
        able &= np.triu(np.ones_like(able), 1).astype(bool)
    if not able.any():
        return []
    linked = np.zeros_like(able)
    flat_a, flat_b = np.asarray([n is None for n in na]), np.asarray([n is None for n in nb])
    plain = able & flat_a[:, None] & flat_b[None, :]
    if plain.any():  # without repeated shingles the similarity is the plain Jaccard of sets: one product for all pairs
        every, inverse = np.unique(np.concatenate(xa + ([] if same else xb)), return_inverse=True)
        shared = np.bincount(inverse, minlength=len(every)) > 1
        column = np.cumsum(shared) - 1
        n_columns = int(shared.sum())

        def rows_of(xs: list[np.ndarray], at: int) -> list[np.ndarray]:
            out = []
            for x in xs:
                k = inverse[at : at + len(x)]
                out.append(column[k[shared[k]]])
                at += len(x)
            return out

        ca = rows_of(xa, 0)
        cb = ca if same else rows_of(xb, sum(map(len, xa)))
        common = np.zeros(able.shape, dtype=np.float32)
        for low in range(0, n_columns, 8192):
            width = min(8192, n_columns - low)

            def dense(cs: list[np.ndarray], low: int = low, width: int = width) -> np.ndarray:
                out = np.zeros((len(cs), width), dtype=np.float32)
                for i, c in enumerate(cs):
                    out[i, c[(c >= low) & (c < low + width)] - low] = 1
                return out

            da = dense(ca)
            common += da @ (da if same else dense(cb)).T
        size_a, size_b = np.asarray([len(x) for x in xa]), np.asarray([len(x) for x in xb])
        linked |= plain & (common / (size_a[:, None] + size_b[None, :] - common) >= threshold - ROUNDING)
    ones = lambda x, n: n if n is not None else np.ones(len(x))
    for i, j in zip(*np.nonzero(able & ~plain), strict=True):
        linked[i, j] = probability_jaccard(xa[i], ones(xa[i], na[i]), xb[j], ones(xb[j], nb[j])) >= threshold - ROUNDING
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = root(int(la[i])), root(int(lb[j]))
        if x != y:
            parent[x] = y
            edges.append((int(ua[i]), int(ub[j])))
    return edges


def _in_blocks(stage: Stage, now: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among the members (bucket, uid, n_words, label) of buckets that pivots didn't settle. A bucket has its
    commonest label and the rest; buckets with the same rest and commonest label are one group, so a member meets that
    rest once however many buckets it shares with it. Members are dealt to blocks, those of the commonest label apart from
    the rest, and each two blocks that can hold a link between labels meet in one task. Members that share no bucket
    never meet."""
    per_label = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    top = per_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("t")).select("bucket", F.col("t.label").alias("top"))
    now = now.join(stage.write(top, "tops"), "bucket")
    marks = [F.bit_xor(F.when(F.col("label") != F.col("top"), F.xxhash64(F.lit(k), "uid"))).alias(f"x{k}") for k in range(2)]
    groups = now.groupBy("bucket").agg(F.min("top").alias("t"), *marks).select("bucket", F.xxhash64("t", "x0", "x1").alias("g"))
    members = now.join(stage.write(groups, "groups"), "bucket").select("g", "uid", "n_words", "label", "top").distinct()
    members = stage.write(members, "blocked")
    blocks = lambda mine: F.greatest(F.ceil(F.count_if(mine) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(mine, F.col("n_words"))), F.lit(0)) / BLOCK_WORDS)).cast("int")
    common = F.col("label") == F.col("top")
    shape = members.groupBy("g").agg(blocks(common).alias("n_top"), blocks(~common).alias("n_rest"))
    dealt = members.join(stage.write(shape, "shape"), "g").filter("n_rest > 0")
    # blocks of the commonest label count from 0, the others' from n_top; (i, j) with i <= j names a task
    mine = F.when(common, F.pmod(F.xxhash64("uid"), F.col("n_top"))).otherwise(F.col("n_top") + F.pmod(F.xxhash64("uid"), F.col("n_rest"))).cast("int")
    dealt = dealt.withColumn("k", mine)
    meets = F.when(F.col("k") < F.col("n_top"), F.sequence(F.col("n_top"), F.col("n_top") + F.col("n_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("n_top") + F.col("n_rest") - 1))
    dealt = dealt.select("g", "uid", "label", "k", F.explode(meets).alias("x")).select("g", "uid", "label", F.least("k", "x").alias("i"), F.greatest("k", "x").alias("j"), (F.col("k") > F.col("x")).cast("int").alias("side"))

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(frame, threshold), columns=["a", "b"]).astype("int64")

    return dealt.join(known.drop("n_words"), "uid").groupBy("g", "i", "j").applyInPandas(meet, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: float = SIMILARITY, keep: list[str] | None = None) -> DataFrame:
    """Rows (*keep, class_id, kept) for docs (doc_id, text, and what else is to be kept): class_id is the least doc_id of
    the documents connected by links, kept is true for the first document of each class (least doc_id, then row).

    Texts without any word (null and empty ones among them) have no shingles and no links: each is a class of its own.
    Texts of under five words are one shingle. Null doc_id: takes part, comes last in order; a class of such rows alone
    has a null class_id. Repeated rows are copies of each other. Empty table: no rows. Kept columns may have any
    name; one called class_id or kept is replaced."""
    keep = [c for c in keep or ["doc_id"] if c.lower() not in ("class_id", "kept")]
    stage = Stage(spark)
    columns = {c: f"c{i}" for i, c in enumerate(dict.fromkeys(["doc_id", "text", *keep]))}
    plain = docs.select(*(docs[f"`{c}`"].alias(n) for c, n in columns.items()), docs["text"].alias("text"))
    read = _read(plain, list(columns.values()))
    rows = stage.write(read.withColumn("uid", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col("c0").isNull().alias("none"), F.col("c0").alias("doc_id"), F.col("uid").alias("uid"))

    with_words = rows.filter("n_words > 0")
    nodes = stage.write(with_words.groupBy("h1", "h2").agg(F.min(place).alias("first")), "nodes")
    first = nodes.select(F.col("first.uid").alias("uid"))
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring(F.col("sig"), 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)))
    banded = with_words.select("uid", "sig", "n_words").join(first, "uid", "left_semi").select("uid", "n_words", F.explode(bands).alias("bucket"))
    # a table, so that the join is a plain one, which adaptive execution splits at a hot bucket
    shared = stage.write(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "shared")
    members = stage.write(banded.join(shared, "bucket").select("bucket", "uid", "n_words"), "members0")
    some = members.select("uid").distinct()
    known = stage.write(_shingle_rows(rows.select("uid", "sig", "n_words", F.col("c1").alias("text")).join(some, "uid", "left_semi")), "shingles")

    labels = None

    def merged(k: int, now: DataFrame, links: DataFrame) -> DataFrame | None:
        """Labels after the links found in round k."""
        if links.isEmpty():
            return labels
        old = now.select("uid", "label").distinct()
        ends = links.join(old.select(F.col("uid").alias("a"), F.col("label").alias("la")), "a").join(old.select(F.col("uid").alias("b"), F.col("label").alias("lb")), "b")
        roots = components(spark, stage, ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), f"round{k}")
        before = some.withColumn("label", F.col("uid")) if labels is None else labels
        return stage.write(before.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").select("uid", F.coalesce("root", "label").alias("label")), f"labels{k}")

    def unsettled(k: int) -> DataFrame:
        """Members of buckets that hold different labels, and how many of the bucket's members share buckets with each."""
        now = members.withColumn("label", F.col("uid")) if labels is None else members.join(labels, "uid", "left").select("bucket", "uid", "n_words", F.coalesce("label", "uid").alias("label"))
        mixed = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
        now = now.join(stage.write(mixed.select("bucket", "n"), f"unlike{k}"), "bucket")
        central = now.groupBy("uid").agg(F.sum("n").alias("central"))
        return stage.write(now.select("bucket", "uid", "n_words", "label").join(central, "uid"), f"mixed{k}")

    for k, pivots in enumerate(PIVOTS):
        now = unsettled(k)
        if now.isEmpty():
            break
        # who shares most buckets with others is likely to be what the others are copies of
        order = F.struct((-F.col("central")).alias("c"), F.xxhash64("uid").alias("h"), F.col("uid"), F.col("label"))
        if pivots == 1:
            chosen = now.groupBy("bucket").agg(F.min(order).alias("p"))
        else:
            w = Window.partitionBy("bucket").orderBy("p")
            chosen = now.select("bucket", order.alias("p")).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= pivots)
        chosen = stage.write(chosen.select("bucket", F.col("p.uid").alias("b"), F.col("p.label").alias("b_label")), f"pivots{k}")
        pairs = now.join(chosen, "bucket").filter("label <> b_label").select(F.col("uid").alias("a"), "b").distinct()
        labels = merged(k, now, stage.write(_verify(pairs, known, threshold), f"links{k}"))
        # a pivot has met all members of its bucket
        members = stage.write(now.select("bucket", "uid", "n_words").join(chosen.select("bucket", F.col("b").alias("uid")), ["bucket", "uid"], "left_anti"), f"members{k + 1}")
        for done in (f"members{k}", f"mixed{k}", f"unlike{k}", f"pivots{k}", f"links{k}"):
            stage.drop(done)
    else:
        now = unsettled(len(PIVOTS))
        if not now.isEmpty():
            labels = merged(len(PIVOTS), now, stage.write(_in_blocks(stage, now, known, threshold), "links"))

    found = nodes.withColumn("uid", F.col("first.uid"))
    found = found.withColumn("label", F.col("uid")) if labels is None else found.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    classes = found.groupBy("label").agg(F.min("first").alias("least"))
    nodes_of = stage.write(found.join(classes, "label").select("h1", "h2", "least"), "classes")
    out = with_words.drop("sig", "n_words").join(nodes_of, ["h1", "h2"])
    named = [F.col(columns[c]).alias(c) for c in keep]
    linked = out.select(*named, F.col("least.doc_id").alias("class_id"), (F.col("uid") == F.col("least.uid")).alias("kept"))
    alone = rows.filter("n_words = 0").select(*named, F.col("c0").alias("class_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs with a common shingle. A pair's similarity is at most the share of either text's mass that is common.
OP4_SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), shingled AS (
    SELECT doc_id, s, count(*) AS n FROM (
        SELECT doc_id, unnest([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') for i in range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM worded WHERE len(w) > 0
    ) GROUP BY ALL
), total AS (SELECT doc_id, sum(n) AS t FROM shingled GROUP BY doc_id),
common AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
    FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (SELECT a, b, sum(k * na) AS ca, sum(k * nb) AS cb FROM common GROUP BY a, b),
able AS (SELECT p.*, x.t AS ta, y.t AS tb FROM pairs p JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b WHERE p.ca >= 0.8 * x.t AND p.cb >= 0.8 * y.t),
ratios AS (SELECT DISTINCT a, b, na, nb FROM common),
shares AS (
    SELECT p.a, p.b, r.na AS p_na, r.nb AS p_nb, any_value(p.ta - p.ca) AS only_a, any_value(p.tb - p.cb) AS only_b,
        sum(c.k * greatest(c.na, r.na * c.nb / r.nb::DOUBLE)) AS shared
    FROM able p JOIN ratios r USING (a, b) JOIN common c ON c.a = p.a AND c.b = p.b GROUP BY ALL
), similar_ones AS (
    SELECT s.a, s.b, sum(c.k * c.na / (shared + only_a + c.na * only_b / c.nb::DOUBLE)) AS j
    FROM shares s JOIN common c ON c.a = s.a AND c.b = s.b AND c.na = p_na AND c.nb = p_nb GROUP BY s.a, s.b
), links AS (SELECT a, b FROM similar_ones WHERE j >= 0.8 - 1e-12 UNION ALL SELECT b, a FROM similar_ones WHERE j >= 0.8 - 1e-12),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(b, doc_id)) AS class_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept FROM documents LEFT JOIN least ON a = doc_id
"""
