"""Repeated passages by enhanced suffix arrays, split over the corpus.

Texts are UTF-8 bytes. Every string of `length` bytes is dealt by the least hash of the GRAM-byte strings within it, so
equal strings, wherever they are, meet under one key. Neighbouring strings with the same key make a segment, and a
segment's content is what they cover. Keys that occur once hold no repeat and leave at the first count.

1. Equal segments are one: all but the first occurrence are repeats as a whole. Copies of documents end here.
2. Segments of one key that differ go, once each, into an enhanced suffix array (suffixes in order, common-prefix
   lengths). A stack scan yields its interval tree; intervals of at least `length` bytes whose occurrences differ in the
   byte to the left are maximal repeats, with all their occurrences. Every occurrence but the first is a repeat; strings
   in the first are repeats only where a longer or another interval says so.
3. A document's repeated starts are merged into spans of covered bytes, which are cut out.

Keys with more different segments than one array should hold are dealt anew before step 2, by the 2, 4, 8 ... least
hashes within a string in place of the least one, until no key is too long. The list of all hashes within a string
leaves no other strings together than rotations of a short period, so that ends, and each string meets its equals in an
array however common its gram is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import Stage, give_back, table

LENGTH = 100
GRAM = 32
#: Different segments of one key that one suffix array takes, at most; longer lists are dealt anew by more hashes.
MOST = 4096
#: Segments that are put into one suffix array together, about; those of one key stay together.
TOGETHER = 2500
_PLACE_BITS = 20
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first starts and numbers of strings of the segments of one text. A string's key is the hash of its gram that
    is least by the hash's upper bits, the leftmost of those equal; a segment's strings have that gram in one place."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) < length:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = gram_hashes(raw, gram)
    window = length - gram + 1
    strings = len(h) - window + 1
    places = []
    step = (1 << _PLACE_BITS) - window
    for at in range(0, strings, step):
        part = h[at : at + step + window - 1]
        # upper bits of the hash and the place in one number: its least is the leftmost
        m = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= window:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < window:
            m = np.minimum(m[: len(m) - (window - width)], m[window - width :])
        places.append((m & _PLACE).astype(np.int64) + at)
    place = np.concatenate(places) if len(places) > 1 else places[0]
    starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return h[place[starts]], starts, np.diff(np.append(starts, strings))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of `gram` bytes, a power of two: polynomials (modulo 2 ** 64) by doubling, then mixed."""
    h, width, base = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(31)
    h *= _MUL
    h ^= h >> np.uint64(29)
    return h


def finer_segments(data: bytes, many: int, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as segments(), but a string's key tells of the `many` least hashes within it, equal ones included."""
    h = gram_hashes(np.frombuffer(data, dtype=np.uint8), gram)
    keys = []
    for at in range(0, len(h) - (length - gram), 4096):
        part = np.sort(np.lib.stride_tricks.sliding_window_view(h[at : at + 4096 + length - gram], length - gram + 1), axis=1)[:, :many]
        key = np.zeros(len(part), dtype=np.uint64)
        for j in range(part.shape[1]):
            key = (key ^ (key >> np.uint64(31))) * _MUL + part[:, j]
        keys.append(key)
    key = np.concatenate(keys)
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return key[starts], starts, np.diff(np.append(starts, len(key)))


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of at least `least` bytes of each segment [start, end), in order of their bytes up to the segment's
    end, and the common-prefix length of each with the one before it. Ranks of 7 bytes are doubled to ranks of 56 for all
    suffixes; those that count are then ranked 56 bytes further at a time. A suffix that ends sorts before longer ones."""
    n = len(data)
    left = np.repeat(ends, ends - starts) - np.arange(n)
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    packed = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        packed = (packed << np.uint64(8)) | padded[j : j + n]
    few = np.flatnonzero(left < 7)
    gone = (8 * (7 - left[few])).astype(np.uint64)
    packed[few] = (packed[few] >> gone) << gone
    packed = (packed << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)

    def ranks(x: np.ndarray) -> np.ndarray:
        return np.unique(x, return_inverse=True)[1] + 1

    rank = np.append(ranks(packed), 0)
    width = 7
    while width < min(depth, 56):
        ahead = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(left > width)
        ahead[inside] = rank[inside + width]
        rank[:n] = ranks(rank[:n] * (n + 2) + ahead)
        width *= 2
    chosen = np.flatnonzero(left >= least)
    own, step = rank[chosen], width
    while width < depth and len(chosen):
        ahead = np.where(left[chosen] > width, rank[np.minimum(chosen + width, n)], 0)
        own = ranks(own * (n + 2) + ahead)
        width += step
    order = chosen[np.argsort(own, kind="stable")]
    lcp = np.zeros(len(order), dtype=np.int64)
    a, b = order[:-1], order[1:]
    room = np.minimum(left[a], left[b])
    words = np.zeros(n + 1, dtype=np.uint64)
    for j in range(8):
        words |= padded[j : j + n + 1].astype(np.uint64) << np.uint64(8 * j)
    at, alive = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    while len(alive):  # eight bytes at a time
        x = words[np.minimum(a[alive] + at[alive], n)] ^ words[np.minimum(b[alive] + at[alive], n)]
        low = (x & (~x + np.uint64(1))).astype(np.float64)
        low[x == 0] = 2.0**64
        at[alive] = np.minimum(at[alive] + np.log2(low).astype(np.int64) // 8, room[alive])
        alive = alive[(x == 0) & (at[alive] < room[alive])]
    lcp[1:] = at
    return order, lcp


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, occurrences) of all maximal repeats of at least `least` bytes: intervals of the common-prefix tree, found
    with a stack, whose suffixes don't all have the same byte before them (before: that byte, or a number of its own for
    a suffix with none)."""
    n = len(order)
    stack: list[tuple[int, int]] = []  # (depth, first index)
    left = before[order]
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    for i in range(1, n + 1):
        depth = int(lcp[i]) if i < n else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if change[first] != change[i - 1]:
                yield d, order[first:i]
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def repeated_starts(contents: list[bytes], rank: np.ndarray, length: int) -> list[np.ndarray]:
    """For different segments (rank: the order of their first occurrences), the starts within each of strings of `length`
    bytes that another segment of lower rank holds too, or the same one earlier."""
    sizes = np.asarray([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = starts + sizes
    owner = np.repeat(np.arange(len(contents)), sizes)
    order, lcp = suffix_array(data, starts, ends, int(sizes.max()), length)
    before = np.full(len(data), -1, dtype=np.int64)
    before[1:] = data[:-1]
    before[starts] = 256 + np.arange(len(starts))
    place = rank[owner] * (int(sizes.max()) + 1) + (np.arange(len(data)) - starts[owner])
    flags = np.zeros(len(data) + 1, dtype=np.int64)
    for depth, where in maximal_repeats(order, lcp, before, length):
        later = np.delete(where, int(place[where].argmin()))
        np.add.at(flags, later, 1)
        np.add.at(flags, later + (depth - length + 1), -1)
    on = np.cumsum(flags[:-1]) > 0
    return [np.flatnonzero(on[s:e]) for s, e in zip(starts, ends, strict=True)]


def _keys(docs: DataFrame, length: int, only_keys: bool) -> DataFrame:
    """(key, chash, uid, start, n) of all segments, or their keys alone; chash is a hash of the segment's bytes."""
    kinds = [pa.int64()] if only_keys else [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["key", "chash", "uid", "start", "n"][: len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[] for _ in kinds]
            held = 0
            for i, uid in enumerate(uids):
                data = texts[i].as_buffer().to_pybytes()
                keys, starts, n = segments(data, length)
                out[0].append(keys.view(np.int64))
                if not only_keys:
                    stop = (starts + n + length - 1).tolist()
                    found = (xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(starts.tolist(), stop, strict=True))
                    out[1].append(np.fromiter(found, dtype=np.uint64, count=len(starts)).view(np.int64))
                    out[2].append(np.full(len(keys), uid))
                    out[3].append(starts)
                    out[4].append(n)
                held += len(keys)
                if held > 200_000 or i == len(uids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(k.to_pandas_dtype())) for x, k in zip(out, kinds, strict=True)], names=names)
                    out, held = [[] for _ in kinds], 0
            give_back()

    types = {"key": "long", "chash": "long", "uid": "long", "start": "int", "n": "int"}
    return docs.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in names))


def _packed(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, z): texts compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(1)
            z = [press.compress(texts[i].as_buffer().to_pybytes()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, type=pa.binary()), batch.column(2)], names=["uid", "z", "doc_id"])
            give_back()

    return docs.mapInArrow(run, "uid long, z binary, doc_id long")


def _numbered(stage: Stage, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, text, doc_id) of all rows, and the same without repeated rows. uid has the order of the documents. It is
    doc_id where that is there and differs everywhere; else the rows' ids and text hashes are sorted and numbered."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n, there, different = given.agg(F.count(F.lit(1)), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n == there == different:
        same = given.select(F.col("doc_id").alias("uid"), "text", "doc_id")
        return same, same
    given = given.withColumn("h", F.xxhash64("text"))
    rows = given.select("doc_id", "h").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "h").withColumn("uid", F.monotonically_increasing_id())
    rows = stage.write(rows, "ids").withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g")
    numbered = stage.write(given.join(rows, given["doc_id"].eqNullSafe(rows["d"]) & (given["h"] == rows["g"])).select("uid", "text", "doc_id"), "numbered")
    return numbered, stage.write(numbered.groupBy("uid").agg(F.min("text").alias("text"), F.min("doc_id").alias("doc_id")), "unique")


def _contents(wanted: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """wanted: (key, chash, uid, start, n) -> the same with the segment's bytes."""
    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("key", "chash", "start", "n")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for uid, w, z in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = open_.decompress(z)
                for at in range(0, len(w), 50_000):
                    part = w[at : at + 50_000]
                    bytes_ = [data[x["start"] : x["start"] + x["n"] + length - 1] for x in part]
                    yield _rows([(x["key"], x["chash"], uid, x["start"], x["n"], c) for x, c in zip(part, bytes_, strict=True)], _SEGMENT)
            give_back()

    return lists.join(packed.select("uid", "z"), "uid").select("uid", "w", "z").mapInArrow(run, _ddl(_SEGMENT))


_SEGMENT = {"key": pa.int64(), "chash": pa.int64(), "uid": pa.int64(), "start": pa.int32(), "n": pa.int32(), "content": pa.binary()}
_FINER = {**_SEGMENT, "p_key": pa.int64(), "p_chash": pa.int64(), "p_start": pa.int32()}


def _rows(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {'binary' if k == pa.binary() else 'int' if k == pa.int32() else 'long'}" for c, k in kinds.items())


def _by_arrays(contents: DataFrame, groups: int, length: int) -> DataFrame:
    """(uid, s, e): bytes that repeats of segments with one key cover; keys are put together in groups."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rank = np.empty(len(frame), dtype=np.int64)
        rank[np.lexsort((frame["start"].to_numpy(), frame["uid"].to_numpy()))] = np.arange(len(frame))
        out: list[tuple[int, int, int]] = []
        for uid, start, on in zip(frame["uid"].tolist(), frame["start"].tolist(), repeated_starts(frame["content"].tolist(), rank, length), strict=True):
            if len(on):
                gaps = np.flatnonzero(np.diff(on) > 1)
                out += [(uid, start + int(a), start + int(b) + length) for a, b in zip(on[np.append(0, gaps + 1)], on[np.append(gaps, len(on) - 1)], strict=True)]
        give_back()
        return pd.DataFrame(out, columns=["uid", "s", "e"]).astype({"uid": "int64", "s": "int64", "e": "int64"})

    group = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")
    return contents.select(group, "uid", "start", "content").groupBy("group").applyInPandas(one, "uid long, s long, e long")


def _intervals(contents: DataFrame, groups: int, length: int) -> DataFrame:
    """(r1, r2, size, key, chash, uid, at): all maximal repeats of segments with one key, by a hash of their bytes, and
    where in the segment (key, chash) of document uid they begin."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        contents = frame["content"].tolist()
        sizes = np.asarray([len(c) for c in contents])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data = b"".join(contents)
        raw = np.frombuffer(data, dtype=np.uint8)
        owner = np.repeat(np.arange(len(contents)), sizes)
        order, lcp = suffix_array(raw, starts, starts + sizes, int(sizes.max()), length)
        before = np.full(len(raw), -1, dtype=np.int64)
        before[1:] = raw[:-1]
        before[starts] = 256 + np.arange(len(starts))
        found = [(xxhash.xxh3_128_digest(data[w[0] : w[0] + d]), d, w) for d, w in maximal_repeats(order, lcp, before, length)]
        n = [len(w) for _, _, w in found]
        where = np.concatenate([w for _, _, w in found]) if found else np.zeros(0, dtype=np.int64)
        hashes = np.frombuffer(b"".join(h for h, _, _ in found), dtype=np.int64).reshape(-1, 2)
        own = owner[where]
        parts = {"r1": np.repeat(hashes[:, 0], n), "r2": np.repeat(hashes[:, 1], n), "size": np.repeat(np.asarray([d for _, d, _ in found], dtype=np.int64), n)}
        return pd.DataFrame({**parts, **{c: frame[c].to_numpy()[own] for c in ("key", "chash", "uid")}, "at": where - starts[own]})

    group = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")
    return contents.select(group, "key", "chash", "uid", "content").groupBy("group").applyInPandas(one, "r1 long, r2 long, size long, key long, chash long, uid long, at long")


def _dealt_anew(contents: DataFrame, many: int, length: int) -> DataFrame:
    """The finer segments of segments, with the segment (p_key, p_chash, p_start) that they are from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            rows: list[tuple] = []
            for old, chash, uid, start, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key, s, n in zip(*(x.tolist() for x in finer_segments(content, many, length)), strict=True):
                    part = content[s : s + n + length - 1]
                    # the old key goes on in the new one: whole keys are dealt, never parts of two together
                    new = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little"), seed=old & 0xFFFFFFFFFFFFFFFF)
                    rows.append((signed(new), signed(xxhash.xxh3_64_intdigest(part)), uid, start + s, n, part, old, chash, start))
                if len(rows) > 50_000:
                    yield _rows(rows, _FINER)
                    rows = []
            if rows:
                yield _rows(rows, _FINER)

    return contents.select("key", "chash", "uid", "start", "content").mapInArrow(run, _ddl(_FINER))


def merged_spans(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """Unions of spans that overlap or touch, in order."""
    if not len(s):
        return []
    order = np.argsort(s, kind="stable")
    s, reach = s[order], np.maximum.accumulate(e[order])
    first = np.append(True, s[1:] > reach[:-1])
    return list(zip(s[first].tolist(), reach[np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)].tolist(), strict=True))


def _dealt(stage: Stage, unique: DataFrame, packed: DataFrame, length: int, most: int) -> list[tuple[DataFrame, DataFrame, DataFrame | None, int]]:
    """For each level of keys: all segments of keys that occur twice, of different ones (by key, chash) the first and
    whether their key is too long and goes on to the next level, and those to put into arrays with their bytes, with a
    number of groups that bounds an array. Keys' counts are tables of their own, so that joins on keys are plain ones, which adaptive execution splits where a key is hot."""
    plain = unique.select("uid", "text")
    often = stage.write(_keys(plain, length, True).groupBy("key").count().filter("count > 1").select("key"), "often")
    found = stage.write(_keys(plain, length, False).join(often, "key"), "segments0")
    levels = [2**k for k in range(1, (length - GRAM).bit_length())] + [length - GRAM + 1]
    out = []
    for level in range(len(levels) + 1):
        held = ["content"] if level else []
        one = stage.write(found.groupBy("key", "chash").agg(F.min(F.struct("uid", "start")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), *(F.min(c).alias(c) for c in held)), f"different{level}")
        long = F.lit(False) if level == len(levels) else F.col("c") > most
        per_key = stage.write(one.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", long.alias("long")), f"keys{level}")
        part = stage.write(one.join(per_key, "key").select("key", "chash", F.col("first.uid").alias("uid"), F.col("first.start").alias("start"), "n", "long", *held), f"parts{level}")
        few, many = part.agg(F.count_if(~F.col("long")), F.count_if("long")).first()
        with_bytes = lambda p, held=held: p if held else _contents(p, packed, length)
        said = one.join(per_key, "key", "left").withColumn("long", F.coalesce("long", F.lit(False)))
        out.append((found, said, with_bytes(part.filter("NOT long")) if few else None, max(1, few // TOGETHER)))
        if not many:
            return out
        found = stage.write(_dealt_anew(with_bytes(part.filter("long")), levels[level], length), f"segments{level + 1}")
    return out


def repeat_spans(stage: Stage, unique: DataFrame, packed: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(uid, s, e): bytes to remove, overlapping pieces of them."""
    spans = []
    for found, one, contents, groups in _dealt(stage, unique, packed, length, most):
        copies = found.join(one.select("key", "chash", "first"), ["key", "chash"]).filter(F.struct("uid", "start") > F.col("first"))
        spans.append(copies.select("uid", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("n") + (length - 1)).cast("long").alias("e")))
        if contents is not None:
            spans.append(_by_arrays(contents, groups, length))
    return stage.write(reduce(DataFrame.unionByName, spans), "spans")


def repeat_groups(spark: SparkSession, docs: DataFrame, length: int = LENGTH, most: int = MOST) -> DataFrame:
    """(group, size, n_places, doc_id, start): passages of at least `length` bytes that occur more than once, each with
    all places where it does, in bytes.

    The maximal repeats of the arrays, and segments with copies, which overlap by length - 1 bytes, are put together
    where they have the same places but for a shift. So a group can't be extended to either side without losing a place,
    unless strings within the longer passage occur elsewhere too: then it is given in parts, between those. Null text
    counts as empty, repeated rows are one document, an empty table gives no rows."""
    stage = Stage(spark)
    _, unique = _numbered(stage, docs)
    ids = unique.select("uid", "doc_id")
    levels = _dealt(stage, unique, _packed(unique), length, most)
    names = ["r1", "r2", "size", "key", "chash", "at"]
    at_level = None
    for level in reversed(range(len(levels))):
        found, one, contents, groups = levels[level]
        # a segment with copies, here or of the one that it is part of, is a repeat as a whole; the hash of its bytes is
        # the one that an array would give it. Segments of long keys are looked at in their parts
        whole = one.filter("NOT long" if level else "NOT long AND copies > 1").select("key", "chash", F.col("first.uid").alias("uid"), F.col("first.start").alias("start"), "n", *(["content"] if level else []))
        whole = (whole if level else _contents(whole, _packed(unique), length)).select("key", "chash", "content")
        parts = [_whole_repeats(whole)] + ([_intervals(contents, groups, length).select(*names)] if contents is not None else []) + ([at_level] if at_level is not None else [])
        inside = stage.write(reduce(DataFrame.unionByName, parts).distinct(), f"inside{level}")
        places = inside.join(found, ["key", "chash"])
        at = (F.col("start") + F.col("at")).cast("long")
        if level:  # places in the segments of the level above
            at_level = places.select("r1", "r2", "size", F.col("p_key").alias("key"), F.col("p_chash").alias("chash"), (at - F.col("p_start")).alias("at"))
        else:
            places = places.select("r1", "r2", "size", "uid", at.alias("start")).distinct()
    places = stage.write(places, "places")
    first = places.groupBy("r1", "r2").agg(F.min(F.struct("uid", "start")).alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    first = stage.write(first.filter("n > 1"), "firsts")
    shape = [F.bit_xor(F.xxhash64(F.lit(k), "uid", F.col("start") - F.col("first.start"))).alias(f"x{k}") for k in range(2)]
    shapes = places.join(first.select("r1", "r2", "first"), ["r1", "r2"]).groupBy("r1", "r2").agg(*shape).join(first, ["r1", "r2"])
    same = Window.partitionBy("first.uid", "x0", "x1", "n").orderBy("first.start", F.col("size").desc(), "r1", "r2")
    end = F.col("first.start") + F.col("size")
    reach = F.max(end).over(same.rowsBetween(Window.unboundedPreceding, -1))
    rows = shapes.withColumn("new", (reach.isNull() | (F.col("first.start") > reach - (length - 1))).cast("int")).withColumn("end", end)
    rows = rows.withColumn("island", F.sum("new").over(same))
    island = Window.partitionBy("first.uid", "x0", "x1", "n", "island")
    rows = rows.withColumn("size", F.max("end").over(island) - F.min("first.start").over(island)).filter("new = 1")
    name = F.concat(F.hex("r1"), F.hex("r2")).alias("group")
    return places.drop("size").join(stage.write(rows.select("r1", "r2", "size", "n"), "groups"), ["r1", "r2"]).join(ids, "uid").select(name, "size", F.col("n").alias("n_places"), "doc_id", "start")


def _whole_repeats(segments_: DataFrame) -> DataFrame:
    """(r1, r2, size, key, chash, at) of segments (key, chash, content) that are repeats as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column(2).to_pylist()
            h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, content)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(list(map(len, content)), type=pa.int64()), batch.column(0), batch.column(1), pa.array(np.zeros(len(content), dtype=np.int64))], names=["r1", "r2", "size", "key", "chash", "at"])

    return segments_.mapInArrow(run, "r1 long, r2 long, size long, key long, chash long, at long")


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, most: int = MOST, with_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text: spans and the remaining bytes).

    A byte goes if a string of `length` bytes covers it that also starts earlier (smaller doc_id, null last; of rows with
    one doc_id in the order of their text's hash; or earlier in the text). Null text counts as empty; texts shorter than
    `length` lose nothing. Repeated rows (same doc_id and text) are one document. Empty table: no rows. Other columns
    aren't looked at."""
    stage = Stage(spark)
    numbered, unique = _numbered(stage, docs)
    packed = _packed(numbered)
    lists = repeat_spans(stage, unique, _packed(unique), length, most).groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("w"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept_bytes"] if with_text else [])]
    span = pa.struct([("s", pa.int64()), ("e", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.list_(span), pa.binary()] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            lists = batch.column(2)
            at, all_s, all_e = lists.offsets.to_numpy(), *(lists.values.field(i).to_numpy() for i in range(2))
            some = lists.is_valid().to_pylist()
            for i, (doc_id, z) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = open_.decompress(z)
                merged = merged_spans(all_s[at[i] : at[i + 1]], all_e[at[i] : at[i + 1]]) if some[i] else []
                kept = b"".join(data[s:e] for s, e in zip([0, *(e for _, e in merged)], [*(s for s, _ in merged), len(data)], strict=True))
                row = [doc_id, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()]
                for x, v in zip(out, row + ([[{"s": s, "e": e} for s, e in merged], kept] if with_text else []), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(out, kinds, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<s:long,e:long>>, kept_bytes binary" if with_text else "")
    return packed.join(lists, "uid", "left").select("doc_id", "z", "w").mapInArrow(run, schema)


def op6_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Every string of 100 bytes, two hexadecimal digits each.
OP6_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
    SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99))::INT AS i FROM bytes)
), later AS (
    SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), starts AS (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later
), runs AS (
    SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM starts) GROUP BY doc_id, r
), listed AS (SELECT doc_id, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e, count(*) AS n, sum(e - s) AS gone FROM runs GROUP BY doc_id)
SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string([substr(h, 2 * coalesce(e[k], 0) + 1, 2 * (coalesce(s[k + 1], length(h) // 2) - coalesce(e[k], 0))) for k in range(0, n + 1)], '') END)) AS kept_sha256
FROM bytes b LEFT JOIN listed l USING (doc_id)
"""
