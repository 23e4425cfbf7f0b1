"""Consensus with insertions and deletions: a weighted graph of alternatives along each read, and its best path.

Nodes are places of the read, with its own base, and stretches inserted before a place; a substitution is an insertion and
a deletion. Each overlapping read adds its weight to the edges of the path that its edit script takes. The best path
maximises the product of the edges' shares at each node; where the read's own edge is heavy enough, it is the only one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.consensus import trim_range
from strandline.operators.distance import EDIT, edit_script, extend, extend_back

Node = tuple[int, str]  # a place and what is inserted before it up to this base; '' is the place itself


def common_seed(a: str, b: str, k: int) -> tuple[int, int, int]:
    """Longest common stretch that begins with a shared k-mer: (place in a, place in b, length); the first if equal."""
    where = defaultdict(list)
    for i in range(len(a) - k + 1):
        where[a[i : i + k]].append(i)
    best, done = (0, 0, 0), set()
    for j in range(len(b) - k + 1):
        for i in where.get(b[j : j + k], ()):
            if (i - 1, j - 1) in done:
                done.add((i, j))
                continue
            done.add((i, j))
            n = k
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    return best


def overlap_path(a: str, b: str, k: int, error_rate: float, min_overlap: int, mode: str = EDIT, min_share: float = 0.0) -> tuple[int, int, list[tuple[int, str, str]], int, int, int] | None:
    """(start and end in a, script with places in a, errors, allowed, start in b) of b's overlap with a, None if there is
    none that is good enough. The overlap's size is that of its shorter side; errors allowed are those of a's side."""
    i, j, n = common_seed(a, b, k)
    if not n:
        return None
    limit = int(error_rate * min(len(a), len(b)))
    d1, la1, lb1 = extend_back(a[:i], b[:j], limit, mode)
    d2, la2, lb2 = extend(a[i + n :], b[j + n :], limit, mode)
    if d1 < 0 or d2 < 0:
        return None
    size_a, size_b = la1 + n + la2, lb1 + n + lb2
    errors, least = d1 + d2, max(min_overlap, int(min_share * len(a)))
    if errors > int(error_rate * min(size_a, size_b)) or min(size_a, size_b) - errors < least:
        return None
    start = i - la1
    script = [(start + p, op, c) for p, op, c in edit_script(a[start:i], b[j - lb1 : j], mode)]
    script += [(i + n + p, op, c) for p, op, c in edit_script(a[i + n : i + n + la2], b[j + n : j + n + lb2], mode)]
    return start, i + n + la2, script, errors, int(error_rate * size_a), j - lb1


def normalized(a: str, start: int, end: int, script: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """The script on a[start:end] in one form for all that do the same: a substitution is an insertion and a deletion,
    both move right over bases that are the same, insertions come before deletions, and an insertion and a deletion of one
    base next to each other cancel out."""
    by_place: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for p, op, c in script:
        by_place[p].append((op, c))
    columns: list[tuple[str, str]] = []  # a base of a, or none; a base of the other, or none
    for p in range(start, end + 1):
        columns += [("", c) for op, c in by_place.get(p, ()) if op == "I"]
        if p == end:
            break
        changed = [(op, c) for op, c in by_place.get(p, ()) if op != "I"]
        if not changed:
            columns.append((a[p], a[p]))
        else:
            columns += [("", changed[0][1])] * (changed[0][0] == "S") + [(a[p], "")]
    at = len(columns) - 2
    while at >= 0:
        (x, y), (u, v) = columns[at], columns[at + 1]
        if bool(x) != bool(y):  # an insertion or a deletion, and what follows it
            if u == v == x + y:
                columns[at], columns[at + 1] = columns[at + 1], columns[at]
                at = min(at + 1, len(columns) - 2)
                continue
            if bool(u) != bool(v) and bool(x) != bool(u):
                if x + y == u + v:
                    columns[at : at + 2] = [(x + y, x + y)]
                    at = min(at, len(columns) - 2)
                    continue
                if x:
                    columns[at], columns[at + 1] = columns[at + 1], columns[at]
                    at = min(at + 1, len(columns) - 2)
                    continue
        at -= 1
    out, p = [], start
    for x, y in columns:
        if not x:
            out.append((p, "I", y))
        else:
            if not y:
                out.append((p, "D", x))
            p += 1
    return out


def path_nodes(a: str, start: int, end: int, script: list[tuple[int, str, str]]) -> list[Node]:
    """The nodes that a script passes on a[start:end], and the inserted ones at its end."""
    by_place: dict[int, list[tuple[str, str]]] = defaultdict(list)
    for p, op, c in script:
        by_place[p].append((op, c))
    out: list[Node] = []
    for p in range(start, end + 1):
        inserted = "".join(c for op, c in by_place.get(p, ()) if op == "I")
        changed = [(op, c) for op, c in by_place.get(p, ()) if op != "I"]
        if changed and changed[0][0] == "S":
            inserted += changed[0][1]
        out += [(p, inserted[: n + 1]) for n in range(len(inserted))]
        if p < end and not changed:
            out.append((p, ""))
    return out


def node_base(a: str, n: Node) -> str:
    return n[1][-1:] or a[n[0] : n[0] + 1]


def _order(n: Node) -> tuple:
    return (n[0], len(n[1]) or 1 << 30, n[1])


Path = tuple[list[float], list[Node], bool, bool]


def best_path(a: str, paths: list[Path], own: list[float] | None = None, reserve: float = math.inf, reserve_share: float = 1.0) -> tuple[list[Node], list[float]]:
    """The nodes of the read after correction, and the weights of the edges to them and to the end.

    paths: for each overlap the weight of the edge to each of its nodes, and of one to the end, its nodes, and whether it
    holds the read's start and its end. own: the
    same of the read itself (1 each by default). The read's own edge is the only one where it has the weight `reserve`, or
    `reserve_share` of the heaviest; bases that are unknown are passed only where nothing else is; the read's own way wins
    ties."""
    if not a:
        return [], []
    first, last = (-1, ""), (len(a), "")
    edges: dict[Node, dict[Node, float]] = defaultdict(lambda: defaultdict(float))
    line = [first, *((i, "") for i in range(len(a))), last]
    follows = dict(zip(line, line[1:], strict=False))
    for (x, y), w in zip(follows.items(), own or [1.0] * (len(a) + 1), strict=True):
        edges[x][y] += w
    for weights, nodes, at_start, at_end in paths:
        chain = [first] * at_start + nodes + [last] * at_end
        for x, y, w in zip(chain, chain[1:], weights if at_start else weights[1:], strict=False):
            edges[x][y] += w
    score, back = {first: 0.0}, {}
    for x in sorted(edges, key=_order):
        if x not in score:
            continue
        out = edges[x]
        most, mine = max(out.values()), out.get(follows.get(x, x), 0.0) if node_base(a, follows.get(x, x)) != "N" else 0.0
        if x in follows and (mine >= reserve or most < 1e-4 or mine / most >= reserve_share):
            out = {follows[x]: 1.0}
        else:
            known = {y: w for y, w in out.items() if node_base(a, y) != "N"}
            out = known if sum(known.values()) > 1e-4 else out
        total = sum(out.values())
        for y, w in sorted(out.items(), key=lambda e: (e[0] != follows.get(x), _order(e[0]))):
            s = score[x] + math.log(w / total) if w > 0 else -math.inf
            if y not in score or s > score[y] + 1e-12:
                score[y], back[y] = s, x
    nodes, weights, at = [], [], last
    while at != first:
        weights.append(edges[back[at]][at])
        nodes.append(at)
        at = back[at]
    return nodes[:0:-1], weights[::-1]


def path_quality(nodes: list[Node], quality: list[int]) -> list[int]:
    """Own bases keep their quality; a new one gets the whole mean of those from the own base before to the one after it."""
    own = [n[0] if not n[1] else -1 for n in nodes]
    before, after, low, high = [], [], 0, len(quality) - 1
    for p in own:
        low = p if p >= 0 else low
        before.append(low)
    for p in reversed(own):
        high = p if p >= 0 else high
        after.append(high)
    return [quality[p] if p >= 0 else sum(quality[x : y + 1]) // (y + 1 - x) for p, x, y in zip(own, before, reversed(after), strict=True)]


def right_share(ordinal: int) -> float:
    return 0.1 if ordinal <= 0 else 1 - 10 ** (-ordinal / 10)


def correct_read(a: str, others: list[tuple[str, str | None]], options: EditOptions, quality: str | None = None) -> tuple[str, str | None]:
    """The corrected read and its quality (None without one). others: sequences with qualities or None."""
    paths = []
    for b, bq in others:
        found = overlap_path(a, b, options.k, options.error_rate, options.min_overlap, options.mode, options.min_share)
        if not found:
            continue
        start, end, script, errors, allowed, at_b = found
        w = 1.0 if allowed <= 0 else 1 - (1 - options.min_weight) * math.sqrt(errors / allowed)
        if w <= 0:
            continue
        nodes = path_nodes(a, start, end, normalized(a, start, end, script))
        scale = [right_share(ord(c) - 33) for c in bq[at_b : at_b + len(nodes)]] if bq else [1.0] * len(nodes)
        paths.append(([w if n[1] else w * s for n, s in zip(nodes, scale, strict=True)] + [w], nodes, start == 0, end == len(a)))
    ordinals = [ord(c) - 33 for c in quality] if quality is not None else None
    own = [right_share(q) for q in ordinals] + [1.0] if ordinals is not None and options.use_quality else None
    nodes, weights = best_path(a, paths, own, options.reserve, options.reserve_share)
    kept = range(len(nodes))
    if options.trim_factor and nodes:  # the edges are gone through from the read's end
        low, high = trim_range(weights[::-1], options.trim_factor)
        kept = range(len(nodes) - max(high - 1, low), len(nodes) - low)
    done = "".join(node_base(a, nodes[i]) for i in kept)
    if ordinals is None:
        return done, None
    new = path_quality(nodes, ordinals)
    return done, "".join(chr(33 + min(max(new[i], 0), 93)) for i in kept)


@dataclass(frozen=True)
class EditOptions:
    """What a read's correction depends on; no trim_factor means no trimming."""

    k: int
    error_rate: float
    min_overlap: int
    min_share: float = 0.0
    min_weight: float = 0.0
    mode: str = EDIT
    reserve: float = math.inf
    reserve_share: float = 1.0
    trim_factor: float = 0.0
    use_quality: bool = True


def correct_edit(cands: DataFrame, reads: DataFrame, stranded: DataFrame, options: EditOptions) -> DataFrame:
    """(read_id, seq[, qual]): each read with its candidates' sequences (capped before, so a row is bounded) in one kernel
    call. Qualities of reads (and of stranded, if used) count where they are there."""
    qual = "qual" in reads.columns
    bq = F.col("qual") if "qual" in stranded.columns and options.use_quality else F.lit(None).cast("string")
    b = stranded.select(F.col("read_id").alias("cand_id"), F.col("strand").alias("cand_strand"), F.col("seq").alias("b"), bq.alias("bq"))
    lists = cands.join(b, ["cand_id", "cand_strand"]).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("max_overlap")).alias("o"), "cand_id", "cand_strand", "b", "bq"))).alias("l"))
    lists = lists.select("read_id", F.transform("l", lambda x: x["b"]).alias("others"), F.transform("l", lambda x: x["bq"]).alias("quals"))
    rows = reads.select("read_id", "seq", (F.col("qual") if qual else F.lit(None).cast("string")).alias("qual")).join(lists, "read_id", "left")

    @F.pandas_udf("seq string, qual string")
    def fix(seq: pd.Series, quality: pd.Series, others: pd.Series, quals: pd.Series) -> pd.DataFrame:
        given = zip(seq, quality, others, quals, strict=True)
        return pd.DataFrame([correct_read(a, list(zip(o, oq, strict=True)) if o is not None else [], options, q) for a, q, o, oq in given], columns=["seq", "qual"])

    return rows.select("read_id", fix("seq", "qual", "others", "quals").alias("x")).select("read_id", "x.seq", *(["x.qual"] if qual else []))
