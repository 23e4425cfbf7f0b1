"""Best-fit packing of token sequences with swap-based local search.

Documents become token ids (an end id appended), only those longer than the sequence length are cut, and the pieces are
packed. Lengths alone decide a packing, so token ids never move between executors: tokenizing leaves a row of a few
numbers for each piece. Pieces are dealt by a hash into blocks of bounded size, each packed alone by best-fit-decreasing
and then improved by moves, one-for-one and two-for-one exchanges that raise the sum of squared fills until bins empty.
A block leaves at most its last bins open, so what is lost against packing all at once is a share of 1 / block_size.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stage, hold, table

MAX_LENGTH = 4096
END_ID = 1
BLOCK = 16_384

#: Texts of these characters alone, without apostrophes and special tokens, split into words and runs of other marks
#: that the tokenizer never joins, so each can be encoded alone and remembered in lower case.
_PLAIN = re.compile(r"[\t\n\r\x20-\x26\x28-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PARTS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[^\sa-z\u00df-\u00f6\u00f8-\u00ff]+")
_WORD = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids as little-endian bytes. The tokenizer lower-cases, drops white space and never joins across it, so parts of a
    text can be encoded alone and remembered. Both memories are bounded and emptied when full; what is remembered never
    changes a result."""

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.is_end[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def _alone(self, texts: list[str], into: dict[str, bytes]) -> None:
        for i in range(0, len(texts), 1024):
            part = texts[i : i + 1024]
            for text, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                into[text] = np.asarray(e.ids, dtype="<u4").tobytes()

    def _together(self, words: list[str]) -> None:
        """Words that are one token group each, many in a call: ids that end a word tell them apart."""
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            lines = [" ".join(part[j : j + 64]) for j in range(0, len(part), 64)]
            ids = np.concatenate([np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer splits words in an unforeseen way")
            raw = ids.tobytes()
            self.parts.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))

    def _plain(self, found: list[list[str]]) -> None:
        new = {x for x in set().union(*found) if x not in self.parts}
        if len(self.parts) + len(new) > self.limit:
            self.parts = {}
            new = set().union(*found)
        words = [x for x in new if _WORD.fullmatch(x)]
        self._together(words)
        self._alone(list(new.difference(words)), self.parts)

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; memory is that of a few texts."""
        at = 0
        while at < len(texts):
            group: list[tuple[bool, list[str]]] = []
            size = 0
            while at < len(texts) and (not group or size < 1 << 21):
                text = texts[at] or ""
                if _PLAIN.fullmatch(text) and "<|" not in text:
                    group.append((True, _PARTS.findall(text.lower())))
                else:
                    group.append((False, text.replace("\n", " ").split(" ")))
                size += len(text)
                at += 1
            self._plain([x for plain, x in group if plain])
            odd = {c for c in set().union(*(x for plain, x in group if not plain)) if c not in self.chunks}
            if len(self.chunks) + len(odd) > self.limit // 4:
                self.chunks = {"": b""}
                odd = set().union(*(x for plain, x in group if not plain)) - {""}
            self._alone(list(odd), self.chunks)
            for plain, x in group:
                yield b"".join(map((self.parts if plain else self.chunks).__getitem__, x))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    hold("packing", _ENCODERS.clear)
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), and the ids themselves if asked for. A null text counts as empty
    and gives the end id alone; a null doc_id stays null; other columns are ignored."""

    path = tokenizer_path
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_tokenizer())
        end = np.asarray([end_id], dtype="<u4").tobytes()
        gc.disable()  # its rounds would walk the words remembered again and again; nothing here makes cycles
        try:
            for batch in batches:
                out: list[list] = [[] for _ in names]
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * max_length)):
                        part = ids[at : at + 4 * max_length]
                        row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, dtype="<u4").astype("int32")] if with_ids else []))
                        for x, v in zip(out, row, strict=True):
                            x.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(out, kinds, strict=True)], names=names)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class Bins:
    """Bins of one block. Best-fit-decreasing first, then local search."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.lengths = np.asarray(lengths, dtype=np.int64)
        self.place = np.full(len(lengths), -1, dtype=np.int64)
        self.free: np.ndarray = np.zeros(0, dtype=np.int64)
        self._best_fit()

    def _best_fit(self) -> None:
        mask, open_bins, free = 0, [[] for _ in range(self.capacity + 1)], []
        lengths, place = self.lengths.tolist(), self.place
        for item in np.argsort(-self.lengths, kind="stable").tolist():
            n = lengths[item]
            fits = mask >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = open_bins[room].pop()
                if not open_bins[room]:
                    mask &= ~(1 << room)
            else:
                room, b = self.capacity, len(free)
                free.append(room)
            room -= n
            free[b] = room
            place[item] = b
            if room:
                open_bins[room].append(b)
                mask |= 1 << room
        self.free = np.asarray(free, dtype=np.int64)

    def improve(self) -> int:
        """Empties the least filled bin that the room left elsewhere could take, as long as exchanges raise the sum of
        squared fills; ends when none of the open bins can be emptied. Returns the number of bins that became empty."""
        emptied = 0
        stuck = np.zeros(len(self.free), dtype=bool)
        while True:
            open_ = (self.free > 0) & (self.free < self.capacity)
            todo = np.flatnonzero(open_ & ~stuck)
            if not len(todo):
                return emptied
            donor = int(todo[np.argmax(self.free[todo])])
            open_[donor] = False
            if self.free[open_].sum() < self.capacity - self.free[donor]:
                return emptied  # fuller bins need still more room
            if self._drain(donor, open_):
                emptied += 1
                stuck[:] = False  # what is left has moved
            else:
                stuck[donor] = True

    def _drain(self, donor: int, rest: np.ndarray) -> bool:
        lengths, free, place = self.lengths, self.free, self.place
        others = np.flatnonzero(rest[place])
        size, where = lengths[others], place[others].copy()
        own = np.flatnonzero(place == donor).tolist()
        bins = np.flatnonzero(rest)

        def put(item: int, b: int) -> None:
            place[item] = b
            free[b] -= lengths[item]

        while own:
            own.sort(key=lambda i: -lengths[i])
            filled = self.capacity - free[donor]
            done = False
            for i in own:  # move: to the bin that it leaves least room in
                n = lengths[i]
                room = free[bins]
                ok = (room >= n) & (self.capacity - room > filled - n)
                if ok.any():
                    b = int(bins[np.where(ok, room, 1 << 40).argmin()])
                    free[donor] += n
                    put(i, b)
                    own.remove(i)
                    others, size, where = np.append(others, i), np.append(size, n), np.append(where, b)
                    done = True
                    break
            if done:
                continue
            room = free[where]
            fill = self.capacity - room
            best = (0, -1, ())
            for i in own:  # one for one
                gain = lengths[i] - size
                gain = np.where((gain > 0) & (gain <= room) & (fill + gain > filled), gain, 0)
                j = int(gain.argmax()) if len(gain) else -1
                if j >= 0 and gain[j] > best[0]:
                    best = (int(gain[j]), j, (i,))
            if not best[0]:
                for x, i in enumerate(own):  # two for one
                    for k in own[x + 1 :]:
                        gain = lengths[i] + lengths[k] - size
                        gain = np.where((gain > 0) & (gain <= room) & (fill + gain > filled), gain, 0)
                        j = int(gain.argmax()) if len(gain) else -1
                        if j >= 0 and gain[j] > best[0]:
                            best = (int(gain[j]), j, (i, k))
                    if best[0]:
                        break
            gain, j, given = best
            if not gain:
                return False
            taken, b = int(others[j]), int(where[j])
            free[b] += lengths[taken]
            free[donor] += sum(lengths[i] for i in given) - lengths[taken]
            place[taken] = donor
            for i in given:
                put(i, b)
                own.remove(i)
            own.append(taken)
            others[j], size[j] = given[0], lengths[given[0]]
            for i in given[1:]:
                others, size, where = np.append(others, i), np.append(size, lengths[i]), np.append(where, b)
        return True


def pack(spark: SparkSession, pieces: DataFrame, max_length: int = MAX_LENGTH, block_size: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, start, length, ids_crc32). Pieces of full length are their
    own sequences; the others go to blocks of about block_size pieces. Repeated rows are packed each on its own; an
    empty table gives an empty one."""
    stage = Stage(spark)
    staged = stage.write(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == max_length
    short = staged.filter(~full).count()
    blocks = max(1, -(-short // block_size))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # a null id would turn ids into floats here, so the id travels as text
        frame = frame.sort_values(["length", "uid"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins = Bins(frame["length"].to_numpy(), max_length)
        bins.improve()
        frame["sequence_id"] = ((int(key[0]) << 24) + bins.place) * 2
        frame = frame.sort_values("sequence_id", kind="stable")
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    schema = PIECES.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long"
    short_ones = staged.filter(~full).withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = short_ones.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks))).groupBy("block").applyInPandas(one, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
    alone = staged.filter(full).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID, block_size: int = BLOCK) -> DataFrame:
    """Places of all documents (doc_id, text) in sequences of at most max_length tokens.

    Null or empty text: the end id alone. Null doc_id: kept, null. Repeated rows: each is packed. Very long texts are
    cut into pieces of max_length, the last may be shorter. Empty table: no rows. Other columns are not looked at."""
    return pack(spark, token_pieces(docs, tokenizer_path, max_length, end_id), max_length, block_size)


def packed_sequences(docs: DataFrame, places: DataFrame, tokenizer_path: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, input_ids, doc_ids. A sequence gathers at most max_length tokens. Needs
    doc_id to be unique and not null in docs."""
    ids = token_pieces(docs, tokenizer_path, max_length, end_id, with_ids=True).select("doc_id", "piece", "ids")
    part = F.struct("offset", "doc_id", "ids")
    got = places.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return got.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))


__all__ = ["Bins", "Encoder", "op10_best_fit_packing", "pack", "pack_documents", "packed_sequences", "token_pieces"]
