"""Token ids as ORC files: sorted by document, in blocks, with indexes.

``write_token_ids`` deals rows by ranges of doc_id, sorts each range and writes one shard of
ORC a task.  A row is a block of at most ``BLOCK`` ids of one document, so that a reader's
memory is bounded whatever the documents' length, and a long document's blocks can be read side by side.
Integer columns are run-length encoded by the format; stripes carry row indexes (minimum and maximum of each
``STRIDE`` rows) and Bloom filters on doc_id.

``read_token_ids`` reads all, some documents or a range of places.  Spark splits files by stripes, hands the
condition to the reader, and the reader skips stripes and strides that can't hold such rows.  ``shard_directory``
has each shard's first and last document and how many ids stand before it: as many rows as the writer had tasks.

Ids come from a public tokenizer.  A byte-level one with the usual pattern (BYTELEVEL) never joins text across the
beginning of white space, so the ids of a text are those of its pieces (a run of blanks and the word behind it),
and pieces already seen by a worker are looked up by a 64-bit hash (equal hashes are taken for equal pieces).
Any other tokenizer encodes whole texts.

Null or empty text: the end id only.  Null ids come first, rows that share an id stand in order of a hash
of their texts, so equal rows are each written.  An empty table gives no document.  Other columns are not carried.
"""

from __future__ import annotations

import json
import os
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_kernel as bk
from .common import delete_on_exit, map_arrow, shared_dir
from .packing import MARKS, PLAIN, TABLE_IDS, TABLE_WORDS, TextTokenizer, WordTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most ids in a row, rows between index entries, bytes of a stripe.
BLOCK, STRIDE, STRIPE = 8192, 1000, 16 << 20
#: Pre-tokenizer of tokenizers whose pieces may be encoded one by one; they have no normalizer.
BYTELEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

SCHEMA = "shard int, doc_id long, start long, doc_tokens long, at long, ids array<int>"


def piece_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces, and for each text the index of its first piece, then the count of all.

    A piece begins with its text, or where a run of ASCII blanks begins; not behind other white space, which is part of that run.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = bk.BLANK[data]
    at = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
    wide |= (three == 0xE2) & ((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)) | (two == 0x81) & (one == 0x9F))
    first = np.zeros(len(data), bool)
    first[at[~wide & ((one < 0x1C) | (one > 0x1F))]] = True
    held = np.diff(offsets) > 0
    first[offsets[:-1][held]] = True
    # Periods and commas at the end of a piece, behind an ASCII letter or digit, are a piece of their own.
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    cut = ends.copy()
    live = np.flatnonzero(MARKS[data[cut - 1]])
    while len(live):
        cut[live] -= 1
        live = live[cut[live] > starts[live]]
        live = live[MARKS[data[cut[live] - 1]]]
    first[cut[(cut > starts) & (cut < ends) & PLAIN[data[np.maximum(cut, 1) - 1]]]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)


class PieceTable(WordTable):
    """Ids of pieces, looked up; those not seen before go through the tokenizer."""

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if self.used > TABLE_IDS or self.table.n > TABLE_WORDS:
            self.clear()
        starts, ends, firsts = piece_bounds(data, offsets)
        h = bk.word_hashes(data, starts, ends, bk.VALUES)
        codes = self.table.get(h)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            raw, at = data.tobytes(), missing[at]
            own = self._learn([raw[a:z].decode("utf-8", "replace") for a, z in zip(starts[at].tolist(), ends[at].tolist())])
            self.table.put(new, own)
            codes[missing] = own[back]
        flat, total = self._flat(np.insert(codes, firsts[1:], 0))  # code 0 is the end id
        return np.split(flat, total[firsts[1:] + np.arange(len(offsets) - 1)][:-1])


def kept_table(tokenizer_path: str, eos: int) -> PieceTable | TextTokenizer:
    """piece_table, kept from one task of a Python worker to the next: pieces that a worker has seen are not encoded again.

    A table holds at most TABLE_WORDS pieces (and one slice's) before it starts anew.
    """
    held = sys.modules.setdefault("_fieldkrig_worker", types.ModuleType("_fieldkrig_worker")).__dict__.setdefault("tables", {})
    key = (tokenizer_path, eos)
    if key not in held:
        held.clear()  # one at a time
        held[key] = piece_table(*key)
    return held[key]


def piece_table(tokenizer_path: str, eos: int) -> PieceTable | TextTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    made = json.loads(tokenizer.to_str())
    plain = made["normalizer"] is None and made["pre_tokenizer"] == BYTELEVEL and not any(set(x["content"]) & set(" \t\n\x0b\x0c\r") or x["lstrip"] or x["rstrip"] or x["single_word"] for x in made["added_tokens"])
    return (PieceTable if plain else TextTokenizer)(tokenizer, eos)


def _blocks(batches, tokenizer_path: str, eos: int):
    """Rows of SCHEMA from sorted doc_id, text."""
    from pyspark import TaskContext

    table, shard, start = kept_table(tokenizer_path, eos), TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo, hi, data, offsets in bk.slices(batch.column(1)):
            ids = table.encode(data, offsets)
            n = np.array([len(x) for x in ids], np.int64)
            first = start + np.cumsum(n) - n
            blocks = -(-n // BLOCK)
            row = np.repeat(np.arange(len(n)), blocks)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
            edges = np.append(0, np.cumsum(np.minimum(n[row] - at, BLOCK))).astype(np.int32)
            start += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(row), shard, np.int32)), batch.column(0).slice(lo, hi - lo).take(pa.array(row)),
                    pa.array(first[row]), pa.array(n[row]), pa.array(at), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(ids).astype(np.int32))),
                ],
                ["shard", "doc_id", "start", "doc_tokens", "at", "ids"],
            )


def write_token_ids(df: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", eos: int = 0) -> None:
    """ORC shards in ascending doc_id order; start counts from the shard's beginning, at from the document's."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Rows of one id are told apart by text, equal rows by where they were read, so that no id fills a task.
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_text"), F.col("_row")]
    dealt = docs.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = map_arrow(dealt.select("doc_id", "text"), lambda b: _blocks(b, tokenizer_path, eos), SCHEMA)
    options = {"orc.create.index": "true", "orc.row.index.stride": STRIDE, "orc.stripe.size": STRIPE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}
    rows.write.options(**{k: str(v) for k, v in options.items()}).orc(path, compression="zstd")


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of SCHEMA.  doc_ids: only theirs; stripes that can't hold them are skipped by range and Bloom filter."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def shard_directory(rows: DataFrame) -> DataFrame:
    """shard, first_doc, last_doc, n_docs, n_tokens, before (ids of all shards before); reads no ids."""
    whole = rows.filter("at = 0").groupBy("shard").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"), F.sum("doc_tokens").alias("n_tokens"))
    out, before = [], 0
    for r in sorted(whole.collect(), key=lambda r: r["shard"]):  # one row a shard
        out.append((*r, before))
        before += r["n_tokens"]
    return rows.sparkSession.createDataFrame(out, "shard int, first_doc long, last_doc long, n_docs long, n_tokens long, before long")


def read_places(rows: DataFrame, directory: DataFrame, low: int, high: int) -> DataFrame:
    """The blocks that hold ids low <= place < high of the whole corpus: place (of the block's first id), ids; shards and strides outside are skipped."""
    hit = directory.filter((F.col("before") < high) & (F.col("before") + F.col("n_tokens") > low)).collect()  # at most one row a shard
    out = rows.filter(F.lit(False)).select(F.lit(0).cast("long").alias("place"), "ids")
    for r in hit:
        place = F.col("start") + F.col("at") + F.lit(r["before"])
        inside = rows.filter((F.col("shard") == r["shard"]) & (F.col("start") < high - r["before"]) & (place < high) & (place + F.size("ids") > low))
        out = out.unionByName(inside.select(place.alias("place"), "ids"))
    return out


def _times(a: int, b: int) -> int:
    """Product modulo the CRC-32 polynomial, bits reversed."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_before(crc: int, n: int) -> int:
    """What crc adds to the CRC-32 of a whole in which n more bytes follow; the parts' values are XORed."""
    power = 1 << 23  # eight zero bits, one byte
    while n:
        if n & 1:
            crc = _times(power, crc)
        power, n = _times(power, power), n >> 1
    return crc


def _crcs(batches):
    for b in batches:
        ids, total, at = b.column("ids"), b.column("doc_tokens").to_pylist(), b.column("at").to_pylist()
        edges, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
        n = np.diff(edges)
        crc = [zlib.crc32(flat[4 * a : 4 * z]) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]
        crc = [c if a + k == t else crc_before(c, 4 * (t - a - k)) for c, k, t, a in zip(crc, n.tolist(), total, at)]
        yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), b.column("start"), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n", "crc"])


def document_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start (of the whole corpus), n_tokens, ids_crc32 of each document, from the rows of its blocks."""
    own = map_arrow(rows, _crcs, "shard int, doc_id long, start long, n long, crc long")
    docs = own.groupBy("shard", "start", "doc_id").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    before = F.broadcast(shard_directory(rows).select("shard", "before"))  # one row a shard
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the ids of df to the shared folder and gives each document's digest, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_ids(df, path, tokenizer_path, **options)
    delete_on_exit(spark, path)
    return document_digests(read_token_ids(spark, path))
