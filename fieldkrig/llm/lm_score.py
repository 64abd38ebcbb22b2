"""LM scoring by online logistic context mixing.

Tokens are lower-cased (A-Z) words and one end per text.  A token is coded as its
class, in CLASS_BITS binary decisions, and the word within its class:

* the TOP_WORDS commonest words (at most; all of one count or none; met twice at least) are known to every task.  The first
  ones are classes of their own, the others are dealt to classes by their last
  two bytes; end is a class, and all rarer and unseen words are one.
* Each decision is predicted by several hashed contexts (the class before, the two
  and three before, the word before), each with counts of ones and zeros from all training
  documents.  Their log odds are combined by weights that a gate selects (the
  decision's depth and how often the longest context was seen), learned online;
  the mix is then refined by an adaptive map from (node, mixed log odds) to what was
  seen there.
* The word within its class has probability (c + 0.1) / (sum over the class).  Among the rare ones stands
  one more, any unseen word, with the weight of all words met once (as Good and Turing estimate it).
  What it is, is then spelled, byte by byte and an end, by how often bytes stand in the rare words of training texts.
  ``score`` is of tokens, to which any unseen word is the same, as it is to base_score; ``spelling`` adds what such words are, and bits per byte are
  the total of both.

Word counts and context counts come from every training document: word counts by a
sharded sum, context counts as arrays of fixed size, summed by chunk, apart for two halves of
the documents.  Weights and the map are learned from every training document too, with the counts of the
half that it isn't in, as texts to be scored have not been counted either.  Texts are dealt to learners by
the checksum of their doc_id, as many learners as LEARNER_TOKENS goes into all training tokens (two at least, one a half); a learner goes online through its texts
in order of doc_id, MIX_BATCH tokens at a time, then the weights of all steps of all learners are averaged
by how often a gate was met and their map counts are summed.  So scores don't depend on how texts are dealt to tasks.
Rare words meet their counts in a shuffled join, so the vocabulary may
grow without bound.

A text learns if crc32 of its doc_id as text modulo 10 is not 0 (null counts as the
empty text, held out).  Null or empty text: the end only.  Rows that repeat are scored
row by row (and all learned from).  Without training text every score is that of
an empty vocabulary.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_kernel as bk
from .common import at_most, map_arrow, share, shared, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

U = np.uint64
CLASS_BITS = 6
CLASSES = 1 << CLASS_BITS
OWN, END_CLASS, RARE_CLASS = 30, 30, 31
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TOP_WORDS = 1 << 19
END = np.array([0x656E64], U)  # the end token's hash
#: Log2 of the slots of each context's table; the sum of all is cut into chunks for the shuffle.
TABLE_BITS = (12, 18, 20, 20)
CHUNK = 1 << 16
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
GATE_LEVELS, MAP_CELLS = 4, 24
WEIGHT_UNIT = 1 << 16
#: Tokens that a task counts at a time; of a learner, about; between two steps of the weights.
TABLE_TOKENS, LEARNER_TOKENS, MIX_BATCH = 400_000, 4_000_000, 8192
#: Where byte counts come among the chunks: behind those of both halves.
SPELLING = -(-2 * int(OFFSETS[-1]) // CHUNK)


class Index:
    """Open addressing from 64-bit hashes to their positions; -1 if missing."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(2 * len(keys)).bit_length())
        self.shift, self.keys, self.at = U(64 - bits), np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.at[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]] = keys[left[put]], left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & (len(self.at) - 1)

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        at = self.at[slot]
        left = np.flatnonzero((at >= 0) & (self.keys[slot] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.at) - 1)
            at[left] = self.at[slot]
            go = (at[left] >= 0) & (self.keys[slot] != keys[left])
            left, slot = left[go], slot[go]
        return at


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d in doc_ids], bool)


def half_of(doc_ids: list) -> np.ndarray:
    """Which half's counts a training document adds to; it learns from the other's."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) // 10 % 2 for d in doc_ids], np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with an end after each text, suffix codes, first token of each text, then the count of all)."""
    return tokens_of(data, *bk.word_bounds(data, offsets))


def tokens_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = bk.word_hashes(data, starts, ends)
    low = lambda at: np.where((data[at] >= 65) & (data[at] <= 90), data[at] + 32, data[at]).astype(np.int64)
    suffix = (low(ends - 1) * 257 + np.where(ends - starts > 1, low(np.maximum(ends - 2, 0)), 0)) * 2654435761 % (1 << 32) >> 27 if len(ends) else np.zeros(0, np.int64)
    return np.insert(h, firsts[1:], END[0]), np.insert(suffix, firsts[1:], 0), firsts + np.arange(len(firsts))


def _counts(batches):
    hashes, suffixes, held = [], [], 0

    def flush():
        key, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.concatenate(suffixes)[first].astype(np.int8))], ["word", "n", "suffix"])

    for b in batches:
        learn = np.flatnonzero(~held_out(b.column(0).to_pylist()))
        for _, _, data, offsets in bk.slices(b.column(1).take(pa.array(learn))):
            h, s, _ = tokens(data, offsets)
            hashes.append(h)
            suffixes.append(s)
            held += len(h)
            if held > 2_000_000:
                yield flush()
                hashes, suffixes, held = [], [], 0
    if hashes:
        yield flush()


class Vocabulary:
    """The commonest words with their classes; class totals."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, suffixes: np.ndarray, total: int, distinct: int, unseen: float = 0.1):
        order = np.lexsort((words, -counts))
        words, counts, suffixes = words[order], counts[order], suffixes[order]
        self.total, self.distinct = total, distinct
        self.index, self.counts = Index(words.view(U)), counts
        is_end = words.view(U) == END[0]
        place = np.arange(len(words)) - np.cumsum(is_end)
        self.classes = np.where(is_end, END_CLASS, np.where(place < OWN, place, 32 + suffixes.astype(np.int64) % 32)).astype(np.uint8)
        mass = np.bincount(self.classes, counts + 0.1, CLASSES)
        mass[RARE_CLASS] = total - counts.sum() + 0.1 * (distinct - len(words)) + unseen
        self.log_mass = np.log10(np.maximum(mass, 1e-9))
        self.log_counts = np.log10(counts + 0.1)

    def classes_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.index.get(h)
        c = self.classes[at] if len(self.classes) else np.zeros(len(h), np.uint8)
        c = np.where(at < 0, RARE_CLASS, c)
        c[h == END[0]] = END_CLASS
        return c.astype(np.int64), at


def contexts(h: np.ndarray, c: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """A hash of each context for each token; before a text stands class 0 and no word."""
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))

    def before(x, k, none):
        out = np.empty_like(x)
        out[k:], out[:k] = x[: len(x) - k], none
        return np.where(place >= k, out, none)

    a, b, d = (before(c, k, 0).astype(U) for k in (1, 2, 3))
    with np.errstate(over="ignore"):
        return [a, a * U(CLASSES) + b, bk.mix((a * U(CLASSES) + b) * U(CLASSES) + d + U(7)), bk.mix(before(h, 1, U(0)) + U(11))]


def slots(ctx: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """The place in the joined tables of each context with a decision's node."""
    out = []
    with np.errstate(over="ignore"):
        for k, (x, bits) in enumerate(zip(ctx, TABLE_BITS)):
            if k < 2:
                s = x * U(CLASSES) + node.astype(U)
            else:
                s = (x ^ (node.astype(U) * U(0x9E3779B97F4A7C15))) * U(0xD6E8FEB86659FD93) >> U(40)
            out.append((s & U((1 << bits) - 1)).astype(np.int64) + OFFSETS[k])
    return out


def decisions(c: np.ndarray):
    """(node, bit) of each decision in order; node 1 is the root."""
    for k in range(CLASS_BITS):
        yield (c + CLASSES) >> (CLASS_BITS - k), (c >> (CLASS_BITS - 1 - k)) & 1


TABLES = "chunk int, width byte, counts binary"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _chunks(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Each chunk's ones and zeros, exact, in the narrowest width that holds them all."""
    kinds = [np.min_scalar_type(x.max()) for x in counts.values()]
    raw = [x.astype(k.newbyteorder("<")).tobytes() for k, x in zip(kinds, counts.values())]
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([k.itemsize for k in kinds], pa.int8()), pa.array(raw, pa.binary())], ["chunk", "width", "counts"])


def _tables(batches, held):
    """Ones and zeros of the slots of both halves, one half after the other."""
    vocabulary, size = shared(held), int(OFFSETS[-1])
    ones, zeros = np.zeros(2 * size, np.uint32), np.zeros(2 * size, np.uint32)
    waiting: list[list] = [[], []]
    tokens_held = [0, 0]

    def flush(half):
        c, *ctx = (np.concatenate(x) for x in zip(*waiting[half]))
        for node, bit in decisions(c):
            one = bit == 1
            for s in slots(ctx, node):
                lo = s.min()
                for table, part in ((ones, s[one]), (zeros, s[~one])):
                    n = np.bincount(part - lo)
                    table[half * size + lo : half * size + lo + len(n)] += n.astype(np.uint32)
        waiting[half], tokens_held[half] = [], 0

    spelled = np.zeros((2, 257), np.uint32)
    for half, h, first, data, starts, ends in _training(batches):
        c, at = vocabulary.classes_of(h)
        rare = np.flatnonzero(np.delete(at, first[1:] - 1) < 0)
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[rare]] = 1
        edge[ends[rare]] -= 1
        spelled[0, :256] += np.bincount(LOWER[data[np.cumsum(edge[:-1]) > 0]], minlength=256).astype(np.uint32)
        spelled[0, 256] += len(rare)
        waiting[half].append((c, *contexts(h, c, first)))
        tokens_held[half] += len(c)
        if tokens_held[half] > TABLE_TOKENS:  # counting goes through whole tables, so it waits for many tokens
            flush(half)
    for half in (0, 1):
        if waiting[half]:
            flush(half)
    for at in range(0, 2 * size, CHUNK):
        pair = np.stack([t[at : at + CHUNK] for t in (ones, zeros)])
        if pair.any():
            yield _chunks({at // CHUNK: pair.ravel()})
    yield _chunks({SPELLING: spelled.ravel()})


def _training(batches):
    """(half, hashes, first tokens, data, starts and ends of words) of slices of the training documents of either half."""
    for b in batches:
        ids = b.column(0).to_pylist()
        learns, half = ~held_out(ids), half_of(ids)
        for k in (0, 1):
            for _, _, data, offsets in bk.slices(b.column(1).take(pa.array(np.flatnonzero(learns & (half == k))))):
                starts, ends, firsts = bk.word_bounds(data, offsets)
                h, _, first = tokens_of(data, starts, ends, firsts)
                yield k, h, first, data, starts, ends


def _sum_tables(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for chunk, width, raw in zip(*(c.to_pylist() for c in b.columns)):
            x = np.frombuffer(raw, f"<u{width}").astype(U)
            total[chunk] = total[chunk] + x if chunk in total else x
    yield _chunks(total)


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    """Weights by gate, and the adaptive map; both are learned by ``learn`` in each task, then joined by ``adopt`` and fixed."""

    def __init__(self, ones: np.ndarray, zeros: np.ndarray):
        self.see(ones, zeros)
        k = len(TABLE_BITS)
        self.weights = np.full((CLASS_BITS * GATE_LEVELS * GATE_LEVELS, k + 1), 1.0 / k, np.float32)
        self.weights[:, -1] = 0
        # The map starts as the identity: what was seen at each node and cell of mixed log odds.
        centre = squash((np.arange(MAP_CELLS + 1) - MAP_CELLS / 2) / 2)
        self.seen = np.tile(np.stack([centre, 1 - centre])[None] * 8, (CLASSES, 1, 1))
        self.met, self.mass = np.zeros(len(self.weights), np.int64), np.zeros(self.weights.shape)
        self.freeze()

    def see(self, ones: np.ndarray, zeros: np.ndarray) -> None:
        """The counts to predict from."""
        self.odds = (np.log(ones + 0.4) - np.log(zeros + 0.4)).astype(np.float32)
        self.level = np.minimum(np.log2(1.0 + ones + zeros) / 3, GATE_LEVELS - 1).astype(np.uint8)

    def freeze(self) -> None:
        self.map = (np.log(self.seen[:, 0] + 0.02) - np.log(self.seen[:, 1] + 0.02)).astype(np.float32)

    def gate(self, depth: int, s: list[np.ndarray]) -> np.ndarray:
        return (depth * GATE_LEVELS + self.level[s[2]].astype(np.int64)) * GATE_LEVELS + self.level[s[3]]

    def refine(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The mean of the mixed log odds and the map's, interpolated between cells."""
        at = np.clip(x * 2 + MAP_CELLS / 2, 0, MAP_CELLS - 1e-3)
        cell = at.astype(np.int64)
        part = (at - cell).astype(np.float32)
        return 0.5 * x + 0.5 * (self.map[node, cell] * (1 - part) + self.map[node, cell + 1] * part)

    def log_probability(self, ctx: list[np.ndarray], c: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's class."""
        out = np.zeros(len(c), np.float32)
        for depth, (node, bit) in enumerate(decisions(c)):
            s = slots(ctx, node)
            w = self.weights[self.gate(depth, s)]
            x = w[:, -1].copy()
            for k, at in enumerate(s):
                x += w[:, k] * self.odds[at]
            x = self.refine(node, x)
            out -= np.logaddexp(np.float32(0), np.where(bit == 1, -x, x))
        return out

    def learn(self, ctx, c, rate: float = 0.02, batch: int = 8192) -> None:
        """Online: tokens in order, a batch at a time."""
        total = np.zeros(self.weights.shape)
        for lo in range(0, len(c), batch):
            part, own = [x[lo : lo + batch] for x in ctx], c[lo : lo + batch]
            odds = np.ones((len(TABLE_BITS) + 1, len(own)), np.float32)
            for depth, (node, bit) in enumerate(decisions(own)):
                s, one = slots(part, node), bit.astype(np.float32)
                for k, at in enumerate(s):
                    odds[k] = self.odds[at]
                g = self.gate(depth, s)
                x = (self.weights[g].T * odds).sum(axis=0)
                step = (one - squash(x)) * odds
                n = np.bincount(g, minlength=len(self.weights))
                for k, by in enumerate(step):
                    total[:, k] = np.bincount(g, by, len(self.weights))
                self.weights += (rate * total / np.maximum(1, np.sqrt(n))[:, None]).astype(np.float32)
                self.met += n
                self.mass += n[:, None] * self.weights
                at = np.clip(np.rint(x * 2 + MAP_CELLS / 2), 0, MAP_CELLS).astype(np.int64)
                self.seen += np.bincount((node * 2 + 1 - bit) * (MAP_CELLS + 1) + at, minlength=self.seen.size).reshape(self.seen.shape)

    def learned(self) -> np.ndarray:
        """What the sums of several learners need, as whole numbers: weights of all steps by gates met, gates met, map counts."""
        return np.concatenate([np.rint(self.mass * float(WEIGHT_UNIT)).ravel(), self.met, self.seen.ravel()]).astype(np.int64)

    def adopt(self, total: np.ndarray) -> None:
        """The learners' mean weights, and the map's start with all their counts."""
        w, met, seen = np.split(total, np.cumsum([self.weights.size, self.met.size]))
        some = met > 0
        self.weights[some] = w.reshape(self.weights.shape)[some] / (met[some, None] * float(WEIGHT_UNIT))
        self.seen = self.seen + seen.reshape(self.seen.shape)
        self.freeze()


def _learn(batches, held, start):
    """Whole learners (rows of learner, text in order): what each has learned, added up."""
    vocabulary, (mixer, views) = shared(held), shared(start)
    begin, total = mixer.weights, np.zeros(len(mixer.learned()), np.int64)
    waiting: list[tuple] = []

    def step(last: bool) -> None:
        """Steps of MIX_BATCH tokens; what is left waits unless it is the last."""
        if waiting:
            c, *ctx = (np.concatenate(x) for x in zip(*waiting))
            n = len(c) if last else len(c) // MIX_BATCH * MIX_BATCH
            mixer.learn([x[:n] for x in ctx], c[:n], batch=MIX_BATCH)
            waiting[:] = [(c[n:], *(x[n:] for x in ctx))]

    def end() -> None:
        step(True)
        waiting.clear()
        total[:] += mixer.learned()

    now = None
    for b in batches:
        learners = b.column(0).to_numpy()
        edges = np.flatnonzero(np.r_[True, learners[1:] != learners[:-1], True])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if learners[lo] != now:
                if now is not None:
                    end()
                now = learners[lo]
                mixer.weights, mixer.met, mixer.mass, mixer.seen = begin.copy(), np.zeros_like(mixer.met), np.zeros_like(mixer.mass), np.zeros_like(mixer.seen)
                mixer.odds, mixer.level = views[1 - int(now) % 2]
            for _, _, data, offsets in bk.slices(b.column(1).slice(lo, hi - lo)):
                h, _, first = tokens(data, offsets)
                c, _ = vocabulary.classes_of(h)
                waiting.append((c, *contexts(h, c, first)))
                if sum(len(x[0]) for x in waiting) >= 4 * MIX_BATCH:
                    step(False)
    if now is not None:
        end()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])


def least_common(counts: DataFrame, room: int) -> int:
    """The least count of 2 or more such that at most ``room`` words have it or more; exact: words are counted by the leading bits of their counts, 16 more each time."""
    high = counts.agg(F.max("n")).first()[0] or 0
    least, within = 1 << 62, F.col("n") >= 2
    for shift in range((max(int(high), 1).bit_length() - 1) // 16 * 16, -1, -16):
        rows = counts.filter(within).groupBy(F.shiftright("n", shift).alias("k")).count().collect()  # at most 65,536
        for r in sorted(rows, key=lambda r: -r["k"]):
            if r["count"] > room:
                within = (F.col("n") >= 2) & (F.shiftright("n", shift) == r["k"])
                break
            room, least = room - r["count"], max(r["k"] << shift, 2)
        else:
            break
    return least


SCORE = "row long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_top long, log_counts double, log_class double, rare_tokens long, word long, spell double"


def _score(batches, held, mixer):
    from pyspark import TaskContext

    vocabulary, (mixer, letters) = shared(held), shared(mixer)
    names = _names(SCORE)
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
    base = TaskContext.get().partitionId() << 36

    def out(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, types)], names)

    for b in batches:
        ids, outside = b.column(0), held_out(b.column(0).to_pylist())
        for lo, hi, data, offsets in bk.slices(b.column(1)):
            starts, ends, firsts = bk.word_bounds(data, offsets)
            h, _, first = tokens_of(data, starts, ends, firsts)
            c, at = vocabulary.classes_of(h)
            logs = mixer.log_probability(contexts(h, c, first), c) / np.log(10)
            top = at >= 0
            counted = np.where(top, vocabulary.log_counts[at] if len(vocabulary.log_counts) else 0.0, 0.0)
            total = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has a token
            row = base + np.arange(hi - lo)
            base += hi - lo
            yield out(hi - lo, row=row, doc_id=ids.slice(lo, hi - lo), held_out=outside[lo:hi], n_bytes=np.diff(offsets), n_tokens=np.diff(first), n_top=total(top.astype(np.int64)), log_counts=total(counted), log_class=total(logs - vocabulary.log_mass[c]))
            rare = np.flatnonzero(~top)
            if len(rare):
                owner = np.repeat(row, np.diff(first))[rare]
                place = rare - np.searchsorted(first[1:] - 1, rare)  # among words; the ends before it don't count
                sums = np.append(0.0, np.cumsum(letters[LOWER[data]]))
                spell = np.where(h[rare] == END[0], 0.0, sums[np.append(ends, 0)[place]] - sums[np.append(starts, 0)[place]] + letters[256])
                o = np.lexsort((h[rare], owner))
                owner, word, spell = owner[o], h[rare][o], spell[o]
                edge = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1]), True])
                yield out(len(edge) - 1, row=owner[edge[:-1]], word=word[edge[:-1]].view(np.int64), rare_tokens=np.diff(edge), spell=spell[edge[:-1]])


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelling, n_bytes, bits_per_byte (null without bytes) for every row."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = written(map_arrow(docs, _counts, "word long, n long, suffix byte").groupBy("word").agg(F.sum("n").alias("n"), F.first("suffix").alias("suffix")), "words")
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("n") == 1).alias("once")).first()
    least = least_common(counts, TOP_WORDS)  # words met once stand for those never met
    is_top = (F.col("n") >= least) | (F.col("word") == int(END.view(np.int64)[0]))
    top = counts.filter(is_top).select("word", "n", "suffix").toArrow()  # at most TOP_WORDS rows, and the end
    unseen = max(0.1, float(seen["once"]))
    vocabulary = Vocabulary(*(c.to_numpy().astype(np.int64) for c in top.columns), seen["total"], seen["distinct"], unseen)
    del top
    held = share(spark, vocabulary)
    size = int(OFFSETS[-1])
    ones, zeros = np.zeros(2 * size, np.int64), np.zeros(2 * size, np.int64)
    # A chunk's counts of all tasks are summed in two steps, about the square root of the tasks' number at a time.
    parts = docs.rdd.getNumPartitions()
    groups, n_chunks, spelled = max(1, math.isqrt(parts)), SPELLING + 1, np.ones(257)
    chunks = map_arrow(docs, lambda b: _tables(b, held), TABLES).withColumn("part", F.spark_partition_id() % groups)
    sums = n_chunks * groups if groups > 1 else at_most(docs, n_chunks)
    some = map_arrow(chunks.repartition(sums, "chunk", "part").select(*_names(TABLES)), _sum_tables, TABLES)
    for r in map_arrow(some.repartition(at_most(docs, n_chunks), "chunk"), _sum_tables, TABLES).toLocalIterator():  # tables of fixed size
        pair = np.frombuffer(r["counts"], f"<u{r['width']}").reshape(2, -1)
        at = r["chunk"] * CHUNK
        if r["chunk"] == SPELLING:
            spelled = spelled + pair[0]
            continue
        ones[at : at + pair.shape[1]], zeros[at : at + pair.shape[1]] = pair
    views = []
    for half in (0, 1):
        mixer = Mixer(ones[half * size : (half + 1) * size], zeros[half * size : (half + 1) * size])
        views.append((mixer.odds, mixer.level))
    start = share(spark, (mixer, views))
    total = np.zeros(len(mixer.learned()), np.int64)
    sum_of = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    learners = max(1, -(-int(seen["total"]) // (2 * LEARNER_TOKENS)))
    learner = (F.pmod(F.floor(sum_of / 20), F.lit(learners)) * 2 + F.floor(sum_of / 10) % 2).cast("int")
    order = ["learner", "doc_id", F.xxhash64("text")]
    dealt = docs.filter(sum_of % 10 != 0).withColumn("learner", learner).repartition("learner").sortWithinPartitions(*order).select("learner", "text")
    learned = map_arrow(dealt, lambda b: _learn(b, held, start), "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for r in learned.collect():  # at most one row for each weight, gate and map cell
        total[r["at"]] = r["n"]
    start.destroy()
    mixer.adopt(total)
    mixer.see(ones[:size] + ones[size:], zeros[:size] + zeros[size:])
    mixed = share(spark, (mixer, np.log10(spelled / spelled.sum())))
    rows = written(map_arrow(docs, lambda b: _score(b, held, mixed), SCORE), "scores")
    mixed.destroy()
    held.destroy()
    rare = rows.filter("word is not null").select("row", "word", "rare_tokens", "spell").join(counts.filter(~is_top).select("word", "n"), "word", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("rare_tokens")).otherwise(0)).alias("rare_known"), F.sum(F.col("rare_tokens") * F.log10(c + 0.1)).alias("rare_logs"), F.sum(F.when(c == 0, F.col("rare_tokens") * math.log10(unseen / 0.1)).otherwise(0.0)).alias("unseen_logs"), F.sum(F.when(c == 0, F.col("rare_tokens") * F.col("spell")).otherwise(0.0)).alias("spelling"))
    whole = rows.filter("word is null").join(rare, "row", "left")
    logs = F.col("log_counts") + F.coalesce("rare_logs", F.lit(0.0))
    score = logs + F.coalesce("unseen_logs", F.lit(0.0)) + F.col("log_class")
    norm = float(np.log10(seen["total"] + 0.1 * (seen["distinct"] + 1)))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(seen["total"])).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * norm).alias("base_score"),
        score.alias("score"),
        F.coalesce("spelling", F.lit(0.0)).alias("spelling"),
        "n_bytes",
        F.when(F.col("n_bytes") > 0, -(score + F.coalesce("spelling", F.lit(0.0))) * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
