"""Collocations: phrases of two or more words that stand together more often than their parts would, by Toivonen mining.

1. A sample of whole documents (a fraction by hash) proposes the phrases that it holds at least ``SAMPLE_COUNT`` times.
2. A full pass counts every word, and every phrase whose parts (itself without its last and without its
   first word) were both proposed: the proposals, and the negative border around them.  Phrases of the greatest
   length have no border of their own, so proposals are needed for shorter ones only.
3. Border phrases that turn out frequent are failures of the sample.  They join the proposals, and a further pass counts
   what their joining lets in, each phrase in one pass only; until a pass finds no failure.
So all frequent phrases have exact counts, whatever the sample was.

Proposals go to the tasks as bit maps of a bounded size, one a length.  A bit that two phrases share lets some more phrases be
counted, which costs shuffled rows and changes no count.  Counts are summed in each task, packed by bucket of key, and added bucket by bucket, so no phrase, word or
language fills a task.  Words and phrases are told apart by 64-bit hashes over language and bytes.

Null text: empty; null language: ``und``.  Empty texts, or an empty table, give nothing.  Rows that repeat count as often
as they occur; ids play no part.  Ties rank by phrase, in byte order.  Long texts are slices by themselves.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import byte_kernel as bk
from .common import map_arrow, share, shared, small_side, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Part of the documents in the sample, and how often it must hold a phrase to propose it.
FRACTION, SAMPLE_COUNT = 0.05, 2
#: Bits for each proposal, and the most of a map (32 MB).
PROPOSAL_BITS, MOST_BITS = 32, 1 << 28
#: Parts of a language that are ranked apart.
SALTS = 16
#: Bytes of a slice, and phrases that a task holds before it sums them.
SLICE, HELD = 1 << 18, 3 << 19

U = np.uint64
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OUTSIDE = BREAK.copy()
OUTSIDE[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Buckets of counts for each partition of the shuffle; over how many the phrases of one beginning are spread (a power of two).
BUCKETS, SPREAD = 2, 8

COUNTS = "level int, x long, y long, n long, lang string, word string, h long"


def phrase_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, the text of each, and its piece: neighbours of one piece stand together."""
    inside = ~OUTSIDE[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    text = np.searchsorted(offsets, starts, side="right") - 1
    return starts, np.flatnonzero(last) + 1, text, np.cumsum(BREAK[data])[starts] + text


def extended(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last."""
    with np.errstate(over="ignore"):
        return bk.mix(x * bk.PLACES[0] + y * bk.PLACES[1])


def bits_of(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys >> U(65 - size.bit_length())).astype(np.int64)


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = bits_of(keys, 8 * len(bitmap))
    return bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0


class Sums:
    """Counts by (x, y) of one level, summed whenever HELD of them have come in; words carry their language and text."""

    def __init__(self, level: int):
        self.level, self.parts, self.size = level, [], 0

    def add(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, lang: pa.Array | None = None, word: pa.Array | None = None) -> bool:
        """True if there are many."""
        self.parts.append((x, y, np.ones(len(x), np.int64) if n is None else n, lang, word))
        self.size += len(x)
        return self.size >= HELD

    def merge(self):
        """(h, x, y, n, lang, word) of each phrase, h rising; they stay held, as one part."""
        if not self.parts:
            none = np.zeros(0, U)
            return none, none, none, np.zeros(0, np.int64), None, None
        x, y, n = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        h, at, back = np.unique(extended(x, y) if self.level > 1 else x, return_index=True, return_inverse=True)
        texts = [None if self.parts[0][i] is None else pa.chunked_array([p[i] for p in self.parts]).combine_chunks().take(pa.array(at)) for i in (3, 4)]
        total = np.zeros(len(h), np.int64)
        np.add.at(total, back, n)
        self.parts, self.size = [(x[at], y[at], total, *texts)], len(h)
        return h, *self.parts[0]

    def packed(self, buckets: int):
        """Rows of bucket and counts, one a bucket; nothing stays."""
        h, x, y, n, lang, word = self.merge()
        self.parts, self.size = [], 0
        if not len(h):
            return
        with np.errstate(over="ignore"):
            own = (bk.mix(x + bk.PLACES[2] * (y % U(SPREAD))) % U(buckets)).astype(np.int32)
        order = np.lexsort((x, own))  # equal beginnings lie together, which packs well
        edge = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1], True])
        columns = [pa.array(x[order]), pa.array(y[order]), pa.array(n[order])] + [pa.nulls(len(h), pa.string()) if c is None else c.take(pa.array(order)) for c in (lang, word)]
        whole = pa.RecordBatch.from_arrays(columns, ["x", "y", "n", "lang", "word"])
        blobs = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as out:
                    out.write_batch(whole.slice(lo, hi - lo))
                blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(own[order][edge[:-1]]), pa.array(np.full(len(blobs), self.level, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "level", "counts"])


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of bytes as strings."""
    edges = np.append(0, np.cumsum(ends - starts))
    flat = data[np.arange(edges[-1]) + np.repeat(starts - edges[:-1], ends - starts)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(flat))


def _count(batches, most: int, words: bool, now: list[np.ndarray] | None, before: list[np.ndarray] | None, buckets: int):
    """Packed counts.

    words: count words (level 1, with their text) and all occurrences of a language (level 0).  now: bit maps of the
    proposals of each length from 1 on (None: all phrases); before: those of the last pass, whose phrases are counted already.
    """
    sums = [Sums(k) for k in range(most + 1)]
    for b in batches:
        langs = b.column("lang").dictionary_encode()
        names, code = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
        salt = bk.mix(np.array([bk.word_hashes(np.frombuffer(s.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(s.encode())]), bk.VALUES)[0] for s in names.to_pylist()], U))  # mixed once more, as a word may be another language's name
        for lo, hi, data, offsets in bk.slices(b.column("text"), SLICE):
            starts, ends, text, piece = phrase_words(data, offsets)
            if not len(starts):
                continue
            own = code[lo:hi][text]
            with np.errstate(over="ignore"):
                h = bk.mix(bk.word_hashes(data, starts, ends) + salt[own])
            if words:
                x, at, n = np.unique(h, return_index=True, return_counts=True)
                if sums[1].add(x, np.zeros(len(x), U), n, names.take(pa.array(own[at])), texts_of(LOWER[data], starts[at], ends[at])):
                    yield from sums[1].packed(buckets)
                used, n = np.unique(own, return_counts=True)
                names_used = names.take(pa.array(used))
                if sums[0].add(salt[used], np.zeros(len(used), U), n, names_used, names_used):
                    yield from sums[0].packed(buckets)
            part = h  # hashes of the phrases of one word less
            for k in range(2, most + 1):
                m = len(h) - k + 1
                if m < 1:
                    break
                hit = piece[:m] == piece[k - 1 :]
                if now is not None:
                    fits = marked(now[k - 2], part)
                    hit &= fits[:m] & fits[1 : m + 1]
                if before is not None:
                    known = marked(before[k - 2], part)
                    hit &= ~(known[:m] & known[1 : m + 1])
                at = np.flatnonzero(hit)
                if sums[k].add(part[at], h[at + k - 1]):
                    yield from sums[k].packed(buckets)
                part = extended(part[:m], h[k - 1 :])
    for level in sums:
        yield from level.packed(buckets)


def _add_up(batches, least: int):
    """Rows of COUNTS of whole buckets, which come one after the other; a task holds one bucket's distinct phrases."""
    sums: dict[int, Sums] = {}
    merged: dict[int, int] = {}  # phrases held since the last merge
    at = None
    for b in batches:
        for bucket, level, blob in zip(b.column("bucket").to_pylist(), b.column("level").to_pylist(), b.column("counts")):
            if bucket != at:
                yield from _frequent(sums, least)
                sums, merged, at = {}, {}, bucket
            own = sums.setdefault(level, Sums(level))
            with pa.ipc.open_stream(blob.as_buffer()) as stream:
                for x in stream:
                    own.add(x.column("x").to_numpy(), x.column("y").to_numpy(), x.column("n").to_numpy(), *((x.column(c) if level < 2 else None) for c in ("lang", "word")))
            if own.size - merged.get(level, 0) > max(HELD, merged.get(level, 0)):
                own.merge()
                merged[level] = own.size
    yield from _frequent(sums, least)


def _frequent(sums: dict[int, Sums], least: int):
    for level, own in sums.items():
        h, x, y, n, lang, word = own.merge()
        keep = np.flatnonzero((n >= least) | (level == 0))
        texts = [pa.nulls(len(keep), pa.string()) if c is None else c.take(pa.array(keep)) for c in (lang, word)]
        numbers = [pa.array(np.full(len(keep), level, np.int32)), *[pa.array(c[keep].view(np.int64)) for c in (x, y)], pa.array(n[keep])]
        yield pa.RecordBatch.from_arrays([*numbers, *texts, pa.array(h[keep].view(np.int64))], ["level", "x", "y", "n", "lang", "word", "h"])


def count_phrases(docs: DataFrame, least: int, most: int, words: bool, now=None, before=None) -> DataFrame:
    """Rows of COUNTS with n >= least, and level 0 as it is.  Counts are packed by bucket in the tasks, and dealt and added by bucket."""
    spark = docs.sparkSession
    held, parts = share(spark, (now, before)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = map_arrow(docs, lambda b: _count(b, most, words, *shared(held), BUCKETS * parts), "bucket int, level int, counts binary")
    return map_arrow(rows.repartition(parts, "bucket").sortWithinPartitions("bucket"), lambda b: _add_up(b, least), COUNTS)


def bitmap(hashed: DataFrame, size: int) -> np.ndarray:
    """The bit map of column h; words of 64 bits are put together before they go to the driver (at most MOST_BITS / 64)."""
    at = F.shiftrightunsigned("h", 65 - size.bit_length())
    found = hashed.select((F.shiftrightunsigned(at, 6)).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {65 - size.bit_length()}) & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def frequent_phrases(docs: DataFrame, least: int = 10, most: int = 3, fraction: float = FRACTION) -> DataFrame:
    """level (words of the phrase; 0: a language), x, y, n, lang, word, h: all phrases with n >= least.  docs: text, lang."""
    sampled = docs.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < int(fraction * (1 << 20)))
    proposed = written(count_phrases(sampled, SAMPLE_COUNT, most - 1, True).filter("level > 0"), "proposed", free=True)
    many = {r["level"]: r["count"] for r in proposed.groupBy("level").count().collect()}
    sizes = [min(MOST_BITS, max(1 << 16, 1 << (PROPOSAL_BITS * many.get(k, 0)).bit_length())) for k in range(1, most)]
    now, before, out = [bitmap(proposed.filter(F.col("level") == k), s) for k, s in zip(range(1, most), sizes)], None, None
    while True:
        counted = written(count_phrases(docs, least, most, before is None, now, before), "counted", free=True)
        out = counted if out is None else out.unionByName(counted)
        # A frequent phrase that no bit stands for is a failure.
        grown = [m | bitmap(counted.filter(F.col("level") == k), s) for k, s, m in zip(range(1, most), sizes, now)]
        if all((a == b).all() for a, b in zip(grown, now)):
            return out
        now, before = grown, now


def collocations(df: DataFrame, least: int = 10, most: int = 3, top: int = 2000, absorbed: int = 50, text: str = "text", lang: str = "lang", fraction: float = FRACTION) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``most`` words.

    A phrase's score is that of its weakest cut: 1,000,000 a**2 / (l r), rounded down.  A phrase goes if a longer
    frequent one that contains it has at least ``absorbed`` percent of its count.
    """
    docs = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    found = frequent_phrases(docs, least, most, fraction)
    short = found.filter("level = 1").select("h", F.array("x").alias("words"), F.col("word").alias("phrase"), "lang", "n", F.array().cast("array<bigint>").alias("heads"), F.array().cast("array<bigint>").alias("tails"))
    kept = []
    for k in range(2, most + 1):
        # heads: counts of the first 1, 2 ... words; tails: of what follows them.
        head = short.select(F.col("h").alias("x"), F.col("words").alias("_words"), F.concat("heads", F.array("n")).alias("heads"), F.split("phrase", " ")[0].alias("_first"))
        tail = short.select(F.col("words").alias("_rest"), F.concat(F.array("n"), "tails").alias("tails"), F.col("phrase").alias("_last"), "lang")
        own = found.filter(F.col("level") == k).select("h", "x", "y", "n").join(small_side(head, 200_000), "x")
        own = own.withColumns({"words": F.concat("_words", F.array("y"))}).withColumn("_rest", F.slice("words", 2, k - 1)).join(small_side(tail, 200_000), "_rest")
        phrases = written(own.select("h", "words", F.concat_ws(" ", "_first", "_last").alias("phrase"), "lang", "n", "heads", "tails"), "phrases", free=True)
        kept.append(phrases)
        short = phrases
    rows = None
    for k, (own, longer) in enumerate(zip(kept, [*kept[1:], None]), 2):
        if longer is not None:
            over = longer.select(F.explode(F.array(F.slice("words", 1, k), F.slice("words", 2, k))).alias("words"), F.col("n").alias("_n")).groupBy("words").agg(F.max("_n").alias("_n"))
            own = own.join(over, "words", "left").filter(F.col("_n").isNull() | (100 * F.col("_n") < absorbed * F.col("n"))).drop("_n")
        cut = F.expr(f"array_min(transform(sequence(1, {k - 1}), j -> struct((cast(1000000 as decimal(38,0)) * n * n) div (cast(heads[j - 1] as decimal(38,0)) * tails[j - 1]) as score, j, heads[j - 1] as l, tails[j - 1] as r)))")
        own = own.select("lang", "phrase", F.col("n").alias("a"), cut.alias("_cut"))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    # First the best of each of SALTS parts of a language, so that a language's task has top x SALTS rows, however many tasks come before it.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = found.filter("level = 0").select("lang", "n")
    return best.join(small_side(totals, 10_000), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
