"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is an n-gram model of bytes (order ORDER) of all trusted text.  Counts are summed by
Spark, sharded by n-gram.  The model holds each distinct n-gram once; these
grow slowly with the text (by its power of about 0.3), so it is broadcast.  Every document is scored whole.

Each language has its own limit: ``margin`` times the ``quantile`` of the perplexities of all
trusted documents in that language.  A mean over n bytes scatters as 1 / sqrt(n), so a
document's threshold is its language's limit times 1 + SLACK / sqrt(n).  Documents
above it are rejected.
Languages without trusted documents take the limit over all trusted ones.

Null or empty text: perplexity null, kept is false.  Null lang is a language.  Rows
that repeat are judged alike.  An empty table gives an empty table; without trusted
rows nothing can be judged and every row with text is kept.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_kernel as bk
from .common import map_arrow, row_key, share, shared, small_side, unused, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 5
U = np.uint64
SLACK = 3.0
PAD = 10  # the byte that stands before a text


def padded(data: np.ndarray, offsets: np.ndarray, pad: int = ORDER - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with padding before each text, places of the texts' bytes in it, text lengths)."""
    n = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(n) + 1) * pad, n)
    out = np.full(len(data) + pad * len(n), PAD, np.uint8)
    out[at] = data
    return out, at, n


def grams(buffer: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes at each place as one number."""
    wide = buffer.astype(U)
    key = wide[order - 1 :].copy()
    for k in range(1, order):
        key |= wide[order - 1 - k : len(wide) - k] << U(8 * k)
    return key[at - (order - 1)]


#: Grams that a task holds beside those it has added up; ids of trusted rows that are broadcast.
LOOSE, TRUSTED = 1 << 22, 5_000_000


def _count(batches):
    """gram, count of a task's texts: each of its grams once."""
    keys, counts, new, size = np.zeros(0, U), np.zeros(0, np.int64), [], 0

    def added():
        key, count = np.unique(np.concatenate([*new, np.zeros(0, U)]), return_counts=True)
        both, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
        out = np.zeros(len(both), np.int64)
        np.add.at(out, back, np.concatenate([counts, count]))
        return both, out

    for b in batches:
        for _, _, data, offsets in bk.slices(b.column(0)):
            buffer, at, _ = padded(data, offsets)
            new.append(grams(buffer, at, ORDER))
            size += len(new[-1])
            if size > LOOSE:
                keys, counts = added()
                new, size = [], 0
    keys, counts = added()
    for lo in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 16)].astype(np.int64)), pa.array(counts[lo : lo + (1 << 16)])], ["gram", "count"])


class Table:
    """Open addressing from n-gram to float, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(2 * len(keys)).bit_length())
        self.shift = U(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, U)
        self.values = np.zeros(1 << bits, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            _, one = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.float32(missing))
        left = np.flatnonzero((found != keys) & (found != np.iinfo(np.uint64).max))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            go = ~hit & (found != np.iinfo(np.uint64).max)
            left, slot = left[go], slot[go]
        return out


class Model:
    """P_n(w | h) = discounted count + gamma(h) P_(n-1)(w | shorter h), down to 1 / 256."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: distinct ORDER-grams; counts of each."""
        self.alpha: list[Table] = [None] * (ORDER + 1)
        self.gamma: list[Table] = [None] * (ORDER + 1)
        levels = {ORDER: (keys.astype(U), counts.astype(np.int64))}
        for n in range(ORDER - 1, 0, -1):  # continuation counts: how many bytes stand before the shorter gram
            levels[n] = np.unique(levels[n + 1][0] & U((1 << (8 * n)) - 1), return_counts=True)
        for n, (key, c) in levels.items():
            of = [max(1, int((c == k).sum())) for k in (1, 2, 3, 4)]
            y = of[0] / (of[0] + 2 * of[1])
            cut = np.clip([0.0, 1 - 2 * y * of[1] / of[0], 2 - 3 * y * of[2] / of[1], 3 - 4 * y * of[3] / of[2]], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.85])
            d = cut[np.minimum(c, 3)]
            order = np.argsort(key, kind="stable")
            key, c, d = key[order], c[order], d[order]
            h = key >> U(8)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            total, lost = np.add.reduceat(c, first) if len(h) else c, np.add.reduceat(d, first) if len(h) else d
            size = np.diff(np.r_[first, len(h)])
            self.alpha[n] = Table(key, ((c - d) / np.repeat(total, size)).astype(np.float32))
            self.gamma[n] = Table(h[first], (lost / total).astype(np.float32))
        self.full = Table(levels[ORDER][0], np.log(self._probability(levels[ORDER][0])).astype(np.float32))
        self.alpha[ORDER] = None  # from here on the longest grams that were counted are looked up in full

    def _probability(self, key: np.ndarray) -> np.ndarray:
        p = np.full(len(key), 1 / 256)
        for n in range(1, ORDER + 1):
            own = key & U((1 << (8 * n)) - 1)
            p = self.gamma[n].get(own >> U(8), 1.0) * p
            if self.alpha[n] is not None:
                p += self.alpha[n].get(own, 0.0)
        return p

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        """Natural logarithms; grams of the training text are looked up ready, the rest interpolated."""
        out = self.full.get(key, np.nan)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            few, back = np.unique(key[rest], return_inverse=True)
            out[rest] = np.log(self._probability(few))[back]
        return out


def _score(batches, model, text_at: int):
    model = shared(model)
    for b in batches:
        total, size = [], []
        for _, _, data, offsets in bk.slices(b.column(text_at)):
            buffer, at, n = padded(data, offsets)
            logs = np.zeros(len(data) + 1)
            if len(data):
                np.cumsum(model.log_probability(grams(buffer, at, ORDER)), out=logs[1:])
            total.append(logs[offsets[1:]] - logs[offsets[:-1]])
            size.append(n)
        total, size = (np.concatenate(x) if x else np.zeros(0) for x in (total, size))
        with np.errstate(invalid="ignore", divide="ignore"):
            ppl = np.exp(-total / size)
        columns = [b.column(i) for i in range(b.num_columns) if i != text_at]
        names = [n for i, n in enumerate(b.schema.names) if i != text_at]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(size.astype(np.int64)), pa.array(ppl, mask=size == 0)], [*names, "n_bytes", "perplexity"])


def trusted_rows(labels: DataFrame) -> DataFrame:
    return labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id").alias("_id")).distinct()


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on the whole texts of all trusted rows."""
    # Texts stay where they are read; beyond that many ids the join shuffles them.
    texts = docs.join(small_side(trusted_rows(labels), TRUSTED), F.col("doc_id") == F.col("_id"), "left_semi").select("text")
    counts = map_arrow(texts, _count, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count")).toArrow()
    return Model(counts.column(0).to_numpy().astype(U), counts.column(1).to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row_key, lang, n_bytes, perplexity of every row, written to the shared folder."""
    held = share(docs.sparkSession, model)
    rows = docs.select("doc_id", row_key().alias("row_key"), "lang", "text")
    kinds = dict(rows.dtypes)
    scored = written(map_arrow(rows, lambda b: _score(b, held, 3), f"doc_id {kinds['doc_id']}, row_key long, lang string, n_bytes long, perplexity double"), "scores")
    held.destroy()
    return scored


def limits(scored: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.15) -> tuple[DataFrame, float]:
    """(lang, threshold) over all trusted documents, and the threshold of languages without any."""
    trusted = scored.join(trusted_rows(labels), F.col("doc_id") == F.col("_id"), "left_semi")
    limit = lambda: margin * F.percentile_approx("perplexity", quantile, 10_000)
    every = trusted.agg(limit()).first()[0]
    return trusted.groupBy("lang").agg(limit().alias("threshold")), float("inf") if every is None else every


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.15) -> DataFrame:
    """doc_id, row_key, lang, n_bytes, perplexity, threshold, kept for every row of docs (doc_id, text, lang)."""
    scored = score(docs, train(docs, labels))
    by_lang, otherwise = limits(scored, labels, quantile, margin)
    by_lang = written(by_lang, "limits")
    joined = scored.join(by_lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    joined = joined.withColumn("threshold", F.coalesce("threshold", F.lit(otherwise)) * (1 + SLACK / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))))
    return joined.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows."""
    own_id, own_key = unused(docs, "_id", "_key")
    bad = classify(docs.select("doc_id", "text", "lang"), labels, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(own_id), F.col("row_key").alias(own_key)).distinct()
    bad = small_side(written(bad, "rejected"), 500_000)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own_id)) & (row_key() == F.col(own_key)), "left_anti")
