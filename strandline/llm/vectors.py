"""Near duplicates among embeddings by dual traversal of cover trees: exact pairs at a cosine threshold.

On unit vectors, cosine >= c means a distance of at most sqrt(2 - 2c). Each label has a tree. Its upper levels are tables:
a node with more vectors than a task should hold is split by a net of its own, drawn from a sample of about SAMPLE of its
vectors; every vector moves to its nearest centre, its home, and the children's covering radii are measured. A vector
also visits the children of later number that could hold a partner: those whose covering radius, enlarged by the
threshold, reaches it and whose border to its own nearest centre is near enough. Visitors move down in the same way. So
every pair meets once, in the home of both or where one visits the other's. A visitor that has a whole node within the
threshold is counted at once and goes no further, and so are the vectors of a node that are all linked with each other.

Nodes that are small enough are compared in tasks of bounded size. There, trees of nested nets with halving radii are
traversed together: pairs of nodes farther apart than their covering radii and the threshold allow are pruned, pairs that
lie wholly within it are counted at once, and only the rest is compared vector by vector.

Tasks report how many links each vector has and edges that connect what is linked, never the pairs themselves. Equal
vectors are one point with a multiplicity. The driver holds nothing that grows with the data.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stage, components, table

COSINE = 0.98
#: Vectors that a task holds of each side, at most, and numbers in them.
BLOCK = 8192
NUMBERS = 1 << 22
#: Children of a node, at most, and how many of a node's vectors a net is drawn from, about.
FANOUT = 32
SAMPLE = 256
_LEAF = 48
#: What sums of rounding errors of distances stay below.
_EPS = 1e-9


class CoverTree:
    """Nested nets over points: a node's centre and the points farthest from the centres so far become its children, until
    they cover its points within half its radius or are FANOUT; each point goes to its nearest, whose radius is then
    measured. All nodes above _LEAF points are split, whether FANOUT children halve the radius or not."""

    def __init__(self, points: np.ndarray, members: np.ndarray | None = None, centre: int | None = None, radius: float | None = None):
        self.points = points
        self.members = np.arange(len(points)) if members is None else members
        self.centre = int(self.members[0]) if centre is None else centre
        d = self._far(self.centre, self.members) if radius is None else None
        self.radius = float(d.max(initial=0.0)) if d is not None else radius
        self.children: list[CoverTree] = []
        if len(self.members) > _LEAF and self.radius > 1e-9:
            self._split()

    def _far(self, i: int, others: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[others] - self.points[i]) ** 2).sum(axis=1), 0.0))

    def _split(self) -> None:
        d = self._far(self.centre, self.members)
        nearest = np.zeros(len(d), dtype=np.int64)
        centres = [self.centre]
        while len(centres) < FANOUT and d.max() > self.radius / 2:
            centres.append(int(self.members[d.argmax()]))
            e = self._far(centres[-1], self.members)
            nearest[e < d] = len(centres) - 1
            d = np.minimum(d, e)
        for j, c in enumerate(centres):
            own = nearest == j
            self.children.append(CoverTree(self.points, self.members[own], c, float(d[own].max())))


class Links:
    """What a traversal finds: link counts (with multiplicities), and a forest over linked points."""

    def __init__(self, weight_a: np.ndarray, weight_b: np.ndarray, same: bool):
        self.wa, self.wb, self.same = weight_a, weight_b, same
        self.na, self.nb = np.zeros(len(weight_a), dtype=np.int64), np.zeros(len(weight_b), dtype=np.int64)
        self.edges: list[tuple[int, int]] = []

    def every(self, a: np.ndarray, b: np.ndarray) -> None:
        """All of a is linked with all of b, which have nothing in common."""
        self.na[a] += self.wb[b].sum()
        self.nb[b] += self.wa[a].sum()
        self.edges += [(int(x), int(b[0])) for x in a] + [(int(a[0]), int(y)) for y in b[1:]]

    def block(self, a: np.ndarray, b: np.ndarray, hit: np.ndarray, both: bool = True) -> None:
        """hit: which of a x b are linked; a point isn't linked with itself. both: the links count for b too."""
        rows = hit.any(axis=1)
        if not rows.any():
            return
        self.na[a] += hit @ self.wb[b]
        if both:
            self.nb[b] += self.wa[a] @ hit
        free_a, free_b = rows, np.ones(len(b), dtype=bool)
        for start in np.flatnonzero(rows).tolist():  # breadth first: an edge for each point that is reached, not for each link
            if not free_a[start]:
                continue
            free_a[start] = False
            todo = [(0, start)]
            while todo:
                side, x = todo.pop()
                if side:
                    new = np.flatnonzero(hit[:, x] & free_a)
                    free_a[new] = False
                    self.edges += [(int(a[i]), int(b[x])) for i in new]
                else:
                    new = np.flatnonzero(hit[x] & free_b)
                    free_b[new] = False
                    self.edges += [(int(a[x]), int(b[j])) for j in new]
                todo += [(1 - side, k) for k in new.tolist()]


def traverse(ta: CoverTree, tb: CoverTree, links: Links, raw_a: np.ndarray, raw_b: np.ndarray, cosine: float) -> None:
    """All links between the points of two trees (the same tree twice: within it)."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    work = [(ta, tb)]
    while work:
        a, b = work.pop()
        same = links.same and a is b
        if not same:
            gap = float(np.sqrt(((a.points[a.centre] - b.points[b.centre]) ** 2).sum()))
            if gap > limit + a.radius + b.radius + 1e-9:
                continue
            if gap + a.radius + b.radius < limit - 1e-9:
                links.every(a.members, b.members)
                continue
        if (not a.children and not b.children) or len(a.members) * len(b.members) <= _LEAF * _LEAF:
            _compare(a.members, b.members, links, raw_a, raw_b, a.points, b.points, cosine, same)
        elif same:
            if 2 * a.radius < limit - 1e-9:
                n = len(a.members)
                links.block(a.members, a.members, ~np.eye(n, dtype=bool), both=False)
                continue
            for i, x in enumerate(a.children):
                work.append((x, x))
                work += [(x, y) for y in a.children[i + 1 :]]
        elif a.children and (not b.children or a.radius >= b.radius):
            work += [(x, b) for x in a.children]
        else:
            work += [(a, y) for y in b.children]


def _compare(a: np.ndarray, b: np.ndarray, links: Links, raw_a: np.ndarray, raw_b: np.ndarray, pa: np.ndarray, pb: np.ndarray, cosine: float, same: bool) -> None:
    for at in range(0, len(a), 512):
        rows = a[at : at + 512]
        c = pa[rows] @ pb[b].T
        hit = c >= cosine
        for i, j in zip(*np.nonzero(np.abs(c - cosine) < 1e-9), strict=True):  # too close to tell: as the definition has it
            x, y = raw_a[rows[i]], raw_b[b[j]]
            hit[i, j] = (x @ y) / math.sqrt((x @ x) * (y @ y)) >= cosine
        if same:
            hit[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
        links.block(rows, b, hit, both=not same)


def _matrix(x: pd.Series) -> np.ndarray:
    return np.asarray(x.tolist(), dtype=np.float64).reshape(len(x), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if x.size else x


def link_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) for vectors (vec_id, embedding, label).

    Vectors that are null, empty, zero, or hold null or non-finite components, and vectors without a label, link with
    nothing and are components of their own; so are vectors of another length than those they would be compared with.
    Equal vectors of one label are linked. Repeated rows are vectors of their own, with an id in common. A null vec_id
    takes part and counts, but names no component. Empty table: no rows. Other columns aren't looked at."""
    stage = Stage(spark)
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    # a length is part of the group: vectors of different lengths are never compared
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: F.abs(x) > 1e-150), F.lit(False))
    rows = rows.withColumn("g", F.when(usable, F.concat_ws(":", F.size("v").cast("string"), F.col("label"))))
    rows = stage.write(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    good = rows.filter(F.col("g").isNotNull())
    key = [F.xxhash64("v").alias("x1"), F.xxhash64(F.lit(1), "v").alias("x2")]
    points = stage.write(good.select("g", "v", "uid", *key).groupBy("g", "x1", "x2").agg(F.min("uid").alias("p"), F.count(F.lit(1)).alias("m")), "points")
    at = rows.select(F.col("uid").alias("p"), "v")
    points_v = points.select(F.col("g").alias("node"), "p", "m").join(at, "p")
    counts, edges = _links(stage, points_v, cosine, block)
    counts = counts.groupBy("p").agg(F.sum("n").alias("n"))
    roots = components(spark, stage, edges, "points").select(F.col("node").alias("p"), "root")
    with_roots = points.join(counts, "p", "left").join(roots, "p", "left").select("g", "x1", "x2", "p", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "p").alias("root"))
    linked = good.select("vec_id", "uid", "g", *key).join(with_roots, ["g", "x1", "x2"])
    linked = stage.write(linked.select("vec_id", "n_links", "root"), "linked")
    least = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = linked.join(least, "root").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("g").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _room(block: int) -> Column:
    """How many of a node's vectors a task holds; a node's name begins with their length."""
    return F.least(F.lit(block), F.greatest(F.lit(1), (F.lit(NUMBERS) / F.substring_index("node", ":", 1).cast("int")).cast("int")))


def _links(stage: Stage, points: DataFrame, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Of points (node, p, m, v), with a root for a node: (p, n), how many links each has, in parts, and edges (a, b)."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = stage.write(points.select("node", "p", "m", "v", F.lit(True).alias("home")), "rows0")
    nodes = stage.write(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).select("node", "n", F.lit(0).cast("long").alias("visitors"), F.lit(False).alias("settled")), "nodes0")
    counts: list[DataFrame] = []
    edges: list[DataFrame] = []
    level = 0
    while True:
        large = nodes.filter((F.col("n") > _room(block)) & (~F.col("settled") | (F.col("visitors") > 0)))
        nets = None if large.isEmpty() else stage.write(_nets(rows, large), f"nets{level}")
        leaves = nodes if nets is None else nodes.join(nets.select("node"), "node", "left_anti")
        met = stage.write(_meet(rows, leaves, cosine, block), f"met{level}")
        counts.append(met.filter("p >= 0").select("p", "n"))
        edges.append(met.filter("a >= 0").select("a", "b"))
        level += 1
        if nets is None:
            break
        moved = stage.write(_moved(rows, nodes, nets, limit), f"moved{level}")
        at_home = moved.filter("home")
        new = stage.write(at_home.groupBy("node").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n"), F.sum("m").alias("weight"), F.min("p").alias("rep"), F.first("settled").alias("settled")), f"new{level}")
        visits = moved.filter("NOT home").join(new.select("node", "r", "weight", "rep"), "node").filter(F.col("d") <= F.col("r") + limit + _EPS)
        whole = F.col("d") + F.col("r") < limit - _EPS
        within = stage.write(visits.filter(whole).select("node", "p", "m", "weight", "rep"), f"within{level}")
        dense = ~F.col("settled") & (2 * F.col("r") < limit - _EPS)
        credit = within.groupBy("node").agg(F.sum("m").alias("credit"))
        told = new.join(credit, "node", "left").select("node", "weight", "rep", F.coalesce("credit", F.lit(0)).alias("credit"), dense.alias("dense")).filter("credit > 0 OR dense")
        own = at_home.select("node", "p", "m").join(stage.write(told, f"told{level}"), "node")
        counts += [within.select("p", F.col("weight").alias("n")), own.select("p", (F.col("credit") + F.when(F.col("dense"), F.col("weight") - F.col("m")).otherwise(0)).alias("n"))]
        edges += [within.select(F.col("p").alias("a"), F.col("rep").alias("b")), own.select(F.col("rep").alias("a"), F.col("p").alias("b"))]
        columns = ["node", "p", "m", "v", "home"]
        rows = stage.write(at_home.select(*columns).unionByName(visits.filter(~whole).select(*columns)), f"rows{level}")
        sizes = rows.groupBy("node").agg(F.count_if("home").alias("n"), F.count_if(~F.col("home")).alias("visitors"))
        nodes = stage.write(sizes.join(new.select("node", (F.col("settled") | dense).alias("settled")), "node"), f"nodes{level}")
        stage.drop(f"rows{level - 1}")
    return stage.write(reduce(DataFrame.unionByName, counts), "counts"), reduce(DataFrame.unionByName, edges)


def _nets(rows: DataFrame, large: DataFrame) -> DataFrame:
    """(node, centres) for the nodes that can be split. A sample's vectors are those of least hash; half of the centres
    are the farthest from those before, so that radii fall, and half come as the sample has them, so that sizes do."""
    lot = F.xxhash64("p").cast("double") / 2.0**64 + 0.5
    drawn = rows.filter("home").select("node", "p", "v").join(large.select("node", "n"), "node").filter(lot * F.col("n") < SAMPLE)

    def net(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p")
        x = _units(_matrix(frame["v"]))
        chosen = [0]
        d = 2 - 2 * x @ x[0]
        while len(chosen) < min(FANOUT, len(x)):
            k = int(d.argmax()) if len(chosen) < FANOUT // 2 else int(np.flatnonzero(d > 1e-12)[0]) if (d > 1e-12).any() else 0
            if d[k] <= 1e-12:
                break
            chosen.append(k)
            d = np.minimum(d, 2 - 2 * x @ x[k])
        return pd.DataFrame({"node": frame["node"].iloc[:1], "centres": [x[chosen].ravel().tolist()], "k": [len(chosen)]})

    return drawn.select("node", "p", "v").groupBy("node").applyInPandas(net, "node string, centres array<double>, k int").filter("k > 1")


def _moved(rows: DataFrame, nodes: DataFrame, nets: DataFrame, limit: float) -> DataFrame:
    """(node, settled, p, m, v, home, d): rows of split nodes at the children that they live in or visit, and how far from
    the child's centre they are. A node's rows are dealt to chunks; each chunk gets the node's centres."""
    chunks = nodes.join(nets.select("node"), "node").select("node", "settled", F.ceil((F.col("n") + F.col("visitors")) / _room(4096)).cast("int").alias("chunks"))
    dealt = rows.join(chunks, "node").withColumn("chunk", F.pmod(F.xxhash64("p"), F.col("chunks"))).drop("chunks")
    centres = nets.join(chunks.drop("settled"), "node").select("node", "centres", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("chunk"))

    def move(frame: pd.DataFrame, net: pd.DataFrame) -> pd.DataFrame:
        c = np.asarray(net["centres"].iloc[0], dtype=np.float64).reshape(int(net["k"].iloc[0]), -1)
        x = _units(_matrix(frame["v"]))
        d2 = np.maximum(2 - 2 * x @ c.T, 0.0)
        between = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0.0))
        home, settled = frame["home"].to_numpy(), frame["settled"].to_numpy()
        own = d2.argmin(axis=1)
        # a partner at child j is nearer to centre j than to any other, so j's side of each border is within the limit
        able = np.ones(d2.shape, dtype=bool)
        for i in range(len(c)):
            able &= d2 - d2[:, i : i + 1] <= 2 * limit * between[i][None, :] + _EPS
        able &= ~home[:, None] | (~settled[:, None] & (np.arange(len(c))[None, :] > own[:, None]))
        visit, child = np.nonzero(able)
        stay = np.flatnonzero(home)
        row, child = np.concatenate([stay, visit]), np.concatenate([own[stay], child])
        out = frame.iloc[row][["p", "m", "v", "settled"]].copy()
        out["node"] = [f"{frame['node'].iloc[0]}.{j}" for j in child]
        out["home"] = np.arange(len(row)) < len(stay)
        out["d"] = np.sqrt(d2[row, child])
        return out[["node", "settled", "p", "m", "v", "home", "d"]]

    return dealt.groupBy("node", "chunk").cogroup(centres.groupBy("node", "chunk")).applyInPandas(move, "node string, settled boolean, p long, m long, v array<double>, home boolean, d double")


def _meet(rows: DataFrame, leaves: DataFrame, cosine: float, block: int) -> DataFrame:
    """(p, n, a, b): link counts (a is -1) and edges (p is -1) of the pairs that meet in leaves: of two vectors at home,
    unless those are settled, and of one at home with a visitor. Leaves are cut into blocks, each two of which are a task."""
    blocks = lambda c: F.ceil(F.col(c) / _room(block)).cast("int")
    shape = leaves.filter((F.col("n") + F.col("visitors") > 1) & (~F.col("settled") | (F.col("visitors") > 0))).select("node", "settled", blocks("n").alias("h"), blocks("visitors").alias("w"))
    dealt = rows.join(shape, "node")
    dealt = dealt.withColumn("k", F.when(F.col("home"), F.pmod(F.xxhash64("p"), F.col("h"))).otherwise(F.col("h") + F.pmod(F.xxhash64("p"), F.greatest("w", F.lit(1)))).cast("int"))
    first = F.when(F.col("home") & F.col("settled"), F.col("h")).otherwise(0)
    last = F.when(F.col("home"), F.col("h") + F.col("w")).otherwise(F.col("h")) - 1
    dealt = dealt.select("node", "p", "m", "v", "k", F.explode(F.sequence(first, last)).alias("x"))
    work = dealt.select("node", F.least("k", "x").alias("i"), F.greatest("k", "x").alias("j"), (F.col("k") > F.col("x")).cast("int").alias("side"), "p", "m", "v")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        one = bool(frame["i"].iloc[0] == frame["j"].iloc[0])
        a = frame[frame["side"] == 0]
        b = a if one else frame[frame["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"p": [], "n": [], "a": [], "b": []}).astype("int64")
        raw_a = _matrix(a["v"])
        raw_b = raw_a if one else _matrix(b["v"])
        ta = CoverTree(_units(raw_a))
        tb = ta if one else CoverTree(_units(raw_b))
        links = Links(a["m"].to_numpy(), b["m"].to_numpy(), one)
        traverse(ta, tb, links, raw_a, raw_b, cosine)
        ids_a, ids_b = a["p"].to_numpy(), b["p"].to_numpy()
        parts = [(ids_a, links.na + (links.nb if one else 0))] + ([] if one else [(ids_b, links.nb)])
        counts = pd.DataFrame({"p": np.concatenate([x for x, _ in parts]), "n": np.concatenate([n for _, n in parts]), "a": -1, "b": -1})
        found = pd.DataFrame({"p": -1, "n": 0, "a": [ids_a[x] for x, _ in links.edges], "b": [ids_b[y] for _, y in links.edges]})
        return pd.concat([counts[counts["n"] > 0], found]).astype("int64")

    return work.groupBy("node", "i", "j").applyInPandas(meet, "p long, n long, a long, b long")


def op5_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


#: All pairs of a label.
OP5_SQL = r"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
    SELECT vec_id, label, v, sqrt(list_sum([x * x for x in v])) AS size FROM vectors
    WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len([x for x in v if x IS NOT NULL AND isfinite(x)]) = len(v) AND len([x for x in v if x <> 0]) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98
), reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) AS kept
FROM vectors LEFT JOIN least l ON l.a = vec_id LEFT JOIN counted c ON c.a = vec_id
"""
