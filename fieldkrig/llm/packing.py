"""Packing: tokens of whole documents into sequences of at most ``limit`` ids.

Bounded-space online packing.  A document's ids end with ``eos``.  Every full
``limit`` ids of a document are a sequence of their own; the rest is one piece.  Each
task keeps at most ``open_windows`` windows: a piece goes to the window it fits
best; when it fits none and no window may be opened, the fullest is emitted.  The
windows still open at the end of a task are merged afterwards, by best fit in
falling order, in rounds of tasks of at most about MERGE_ITEMS windows.  Of a round's
windows at most one a task is half full or less, since two would have met; only these go
on, so a round leaves at most a MERGE_ITEMS-th and the rounds end.

Tokens come from a public tokenizer.  One that lower-cases, drops white space and never
joins text across it (WORDWISE) works word by word: the ids of a text are those of its
words in order, and words already seen in a task are looked up.  Any other encodes whole texts.

Null or empty text: the end id only.  Null ids stay null.  Rows that repeat are packed as
often as they occur.  An empty table gives an empty table.  Other columns are not carried.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_kernel as bk
from .common import map_arrow, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most words (or parts of words) and ids that a task's table holds (about 60 MB) before it starts anew.
TABLE_WORDS, TABLE_IDS = 1_000_000, 12_000_000
#: Windows that one task merges.
MERGE_ITEMS = 2048
#: Normalizer and pre-tokenizer of tokenizers whose words may be encoded one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class HashTable:
    """Open addressing from 64-bit hashes to codes, by whole arrays; 12 bytes a slot, at most half full."""

    def __init__(self):
        self.n, self.keys, self.codes = 0, np.zeros(1 << 12, np.uint64), np.full(1 << 12, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 if missing."""
        slot = self._slot(h)
        out = self.codes[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            out[left] = self.codes[slot]
            go = (out[left] >= 0) & (self.keys[slot] != h[left])
            left, slot = left[go], slot[go]
        return out

    def put(self, h: np.ndarray, codes: np.ndarray) -> None:
        """Distinct hashes that are missing."""
        if 2 * (self.n + len(h)) > len(self.keys):
            old, own = self.keys[self.codes >= 0], self.codes[self.codes >= 0]
            size = 1 << (2 * (self.n + len(h))).bit_length()
            self.n, self.keys, self.codes = 0, np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self.put(old, own)
        self.n += len(h)
        left, slot = np.arange(len(h)), self._slot(h)
        while len(left):
            free = np.flatnonzero(self.codes[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.codes[slot[put]] = h[left[put]], codes[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & (len(self.keys) - 1)


MARKS = np.zeros(256, bool)
MARKS[[*b".,"]] = True
PLAIN = np.zeros(256, bool)
PLAIN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True


class TextTokenizer:
    """Ids of whole texts, then the end id."""

    def __init__(self, tokenizer, eos: int):
        self.tokenizer, self.eos = tokenizer, eos

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:z].decode("utf-8", "replace") for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return [np.array([*e.ids, self.eos], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordTable:
    """Ids of words, part by part, looked up by a 64-bit hash of a part's bytes (equal hashes are taken for equal parts).

    A word that ends in an ASCII letter or digit and then periods or commas is two parts, what stands
    before and the marks; A-Z have the ids of a-z.  Only parts not seen before go through the tokenizer.
    """

    def __init__(self, tokenizer, eos: int):
        self.tokenizer, self.eos = tokenizer, eos
        self.clear()

    def clear(self) -> None:
        self.table = HashTable()
        self.pool = np.zeros(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.start, self.length = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.n, self.used = 0, 0
        self._add(np.array([self.eos]), np.ones(1, np.int64))

    def _add(self, flat: np.ndarray, lengths: np.ndarray) -> int:
        """Appends entries; returns the first one's code."""
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used // 2), self.pool.dtype)])
        if self.n + len(lengths) > len(self.start):
            grow = np.zeros(max(len(lengths), self.n // 2), np.int32)
            self.start, self.length = np.concatenate([self.start[: self.n], grow]), np.concatenate([self.length[: self.n], grow])
        first, to = self.n, self.n + len(lengths)
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[first:to], self.length[first:to] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used, self.n = self.used + len(flat), to
        return first

    def _flat(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all codes joined, running count of ids)."""
        length = self.length[codes].astype(np.int64)
        total = np.cumsum(length)
        if not len(codes):
            return np.zeros(0, np.uint32), total
        return self.pool[np.arange(total[-1]) + np.repeat(self.start[codes] - (total - length), length)].astype(np.uint32), total

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Codes for new parts."""
        out = np.empty(len(texts), np.int32)
        for lo in range(0, len(texts), 1_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1_000], add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            first = self._add(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)
            out[lo : lo + len(ids)] = np.arange(first, self.n)
        return out

    def _parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray):
        """Starts, ends and hashes of parts, and for each text the index of its first part, then the count of all."""
        cut = ends.copy()  # where the marks at a word's end begin
        live = np.flatnonzero(MARKS[data[cut - 1]])
        while len(live):
            cut[live] -= 1
            live = live[cut[live] > starts[live]]
            live = live[MARKS[data[cut[live] - 1]]]
        cut = np.where((cut > starts) & PLAIN[data[np.maximum(cut, 1) - 1]], cut, ends)
        control = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # where a control token may start; such words stay as they are
        exact = np.searchsorted(control, ends - 1) > np.searchsorted(control, starts) if len(control) else np.zeros(len(starts), bool)
        cut = np.where(exact, ends, cut)
        first = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(1 + (cut < ends), out=first[1:])
        begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        begin[first[:-1]], end[first[:-1]] = starts, cut
        marked = np.flatnonzero(cut < ends)
        begin[first[marked] + 1], end[first[marked] + 1] = cut[marked], ends[marked]
        h = bk.word_hashes(data, begin, end)
        if exact.any():
            h[first[:-1][exact]] = ~bk.word_hashes(data, starts[exact], ends[exact], bk.VALUES)
        return begin, end, h, first[firsts]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a slice, then the end id."""
        if self.used > TABLE_IDS or self.table.n > TABLE_WORDS:
            self.clear()
        starts, ends, firsts = bk.word_bounds(data, offsets)
        begin, end, h, firsts = self._parts(data, starts, ends, firsts)
        codes = self.table.get(h)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            raw, at = data.tobytes(), missing[at]
            own = self._learn([raw[a:z].decode("utf-8", "replace") for a, z in zip(begin[at].tolist(), end[at].tolist())])
            self.table.put(new, own)
            codes[missing] = own[back]
        flat, total = self._flat(np.insert(codes, firsts[1:], 0))  # code 0 is the end id
        return np.split(flat, total[firsts[1:] + np.arange(len(offsets) - 1)][:-1])


def token_table(tokenizer_path: str, eos: int) -> WordTable | TextTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    made = json.loads(tokenizer.to_str())
    return (WordTable if all(made[k] == v for k, v in WORDWISE.items()) else TextTokenizer)(tokenizer, eos)


class Windows:
    """At most k open windows; a window is (id, fill)."""

    def __init__(self, limit: int, k: int, first_id: int):
        self.limit, self.k, self.next = limit, k, first_id
        self.open: list[tuple[int, int]] = []  # (room, id), rising

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> tuple[int, int]:
        """(window, offset) for a piece of n ids."""
        i = bisect_left(self.open, (n, -1))
        if i < len(self.open):
            room, window = self.open.pop(i)
        else:
            if len(self.open) >= self.k:
                self.open.pop(0)  # the fullest
            room, window = self.limit, self.fresh()
        if room > n:
            insort(self.open, (room - n, window))
        return window, self.limit - room


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches, tokenizer_path: str, limit: int, eos: int, k: int, with_ids: bool):
    from pyspark import TaskContext

    words = token_table(tokenizer_path, eos)
    windows = Windows(limit, k, TaskContext.get().partitionId() << 32)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows_of(rows: list[tuple], ids: list[np.ndarray], is_open: bool) -> pa.RecordBatch:
        columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
        columns.append(pa.array([is_open] * len(rows), pa.bool_()))
        fields = [*names, "is_open"]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            fields.append("ids")
        return pa.RecordBatch.from_arrays(columns, fields)

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for lo, hi, data, offsets in bk.slices(batch.column(1)):
            rows, pieces = [], []
            for doc_id, ids in zip(doc_ids[lo:hi], words.encode(data, offsets)):
                n = len(ids)
                for start in range(0, n, limit):
                    piece = ids[start : start + limit]
                    window, offset = (windows.fresh(), 0) if len(piece) == limit else windows.place(len(piece))
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), n, window, offset))
                    pieces.append(piece)
            yield rows_of(rows, pieces, False)
    # The windows that are still open, as rows of their own: start is their fill.
    left = [(None, limit - room, 0, 0, 0, window, 0) for room, window in windows.open]
    yield rows_of(left, [np.zeros(0, np.uint32)] * len(left), True)


def _merge(batches, limit: int, last: bool):
    """Best fit in falling order of whole windows; rows: fill, members (window, offset).  Windows over half full are done: of those left, a task has at most one."""
    items = sorted(((f, m) for b in batches for f, m in zip(b.column("fill").to_pylist(), b.column("members").to_pylist())), key=lambda x: (-x[0], x[1][0]["window"]))
    room: list[tuple[int, int]] = []
    out: list[list] = []
    for fill, members in items:
        i = bisect_left(room, (fill, -1))
        if i < len(room):
            free, at = room.pop(i)
        else:
            free, at = limit, len(out)
            out.append([0, []])
        base = limit - free
        out[at][1] += [{"window": m["window"], "offset": m["offset"] + base} for m in members]
        out[at][0] = base + fill
        if free > fill:
            insort(room, (free - fill, at))
    members = pa.list_(pa.struct([("window", pa.int64()), ("offset", pa.int64())]))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], members), pa.array([last or x[0] * 2 > limit for x in out], pa.bool_())],
        ["fill", "members", "done"],
    )


def pack_documents(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, eos: int = 2, open_windows: int = 64, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids]."""
    schema = PIECE + ", is_open boolean" + (", ids array<int>" if with_ids else "")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(map_arrow(docs, lambda b: _pack(b, tokenizer_path, limit, eos, open_windows, with_ids), schema), "packed")
    pieces = rows.filter(~F.col("is_open")).drop("is_open")
    items = rows.filter("is_open").select(F.col("start").alias("fill"), F.array(F.struct(F.col("sequence_id").alias("window"), F.lit(0).cast("long").alias("offset"))).alias("members"), F.lit(False).alias("done"))
    done = None
    while True:
        tasks = -(-items.count() // MERGE_ITEMS)
        last = tasks <= 1
        dealt = items.select("fill", "members").coalesce(1) if last else items.select("fill", "members").repartition(tasks, F.xxhash64(F.col("members")[0]["window"]))
        merged = written(map_arrow(dealt, lambda b, last=last: _merge(b, limit, last), "fill long, members array<struct<window:long,offset:long>>, done boolean"), "merged")
        ready = merged.filter("done")
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        items = merged.filter("not done")
    moves = done.select(F.col("members")[0]["window"].alias("_to"), F.explode("members").alias("_m")).select(F.col("_m.window").alias("sequence_id"), "_to", F.col("_m.offset").alias("_by"))
    moved = pieces.join(moves, "sequence_id", "left")
    return moved.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("_to", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("_by", F.lit(0))).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
