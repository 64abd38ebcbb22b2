"""Suffix-array dedup by prefix-free parsing: bytes of repeated strings of ``length`` bytes.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier:
in a document of smaller doc_id, or earlier in the same one.

Parse.  Rolling hashes of GRAM bytes are the triggers: each window of ``length``
bytes takes its smallest trigger (the leftmost if equal), so equal windows take
the same one at the same place.  A run of windows with one trigger is a phrase: the
bytes of these windows.  Neighbouring phrases overlap, and every window lies inside
its phrase.

Parse level.  Since no window crosses a phrase's end, the parse's suffixes need comparing by
their first phrase only: its suffix array is the occurrences of phrases in order of
phrase, then of the corpus.  Occurrences that agree with an earlier one as a whole are repeats,
first within a task, then over all.  Highly repetitive text ends here.

Dictionary level.  Triggers whose phrases differ are marked in a bitmap.  The
distinct phrases at marked triggers are cut in two at the trigger (windows that
reach far to its left, and the others) and dealt by trigger and nearby bytes, so that equal
windows meet.  A task builds the suffix array of its phrases' bytes, to a depth of ``length``, by
prefix doubling.  The two arrays combined give the windows in corpus order: by rank in the
dictionary, then by the occurrence of their phrase.  In each run of equal ranks
(a common prefix of ``length``) all but the first are repeats.

Phrases move as 64-bit hashes (equal ones are taken for equal strings) and, at the
dictionary level, as short strings, whose bytes are compared; texts move once, to meet their spans.

Null or empty text: nothing to remove.  Null doc_id comes before all ids.  Rows with one
doc_id but other texts are ordered by a hash of the text; rows equal in both see
one another not as earlier, but both as copies of earlier strings.  Empty table:
empty result.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute below
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import byte_kernel as bk
from .common import at_most, map_arrow, row_key, share, shared, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 32
PLACE_BITS = 28
#: Rows that a task holds before it drops its own repeats, and limits of the bitmap's size (1 to 32 MB... of bits).
BUFFER_ROWS = 200_000
MIN_BITS, MAX_BITS = 20, 28
#: Phrase parts whose suffixes are sorted together.
SORTED_PARTS = 8_000
#: Texts that are cut at a time.
CUT_ROWS = 256
NULL_ID = -(2**63)
U = np.uint64


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """Each phrase of a slice: text index, first and last window (offsets in the slice), trigger place, trigger and phrase hash."""
    m = len(data) - length + 1
    if m <= 0:
        return None
    if len(data) >> PLACE_BITS:
        raise ValueError(f"a text of 2**{PLACE_BITS} bytes or more")
    triggers = bk.rolling(data, GRAM)
    places = np.arange(len(triggers), dtype=U)
    low = bk.window_minimum((triggers >> U(PLACE_BITS) << U(PLACE_BITS)) | places, length - GRAM + 1)[:m]
    place = (low & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    valid = np.arange(m) + length <= offsets[1:][text]
    window = np.flatnonzero(valid)
    if not len(window):
        return None
    place = place[window]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
    last = np.r_[first[1:] - 1, len(window) - 1]
    p0, p1, at = window[first], window[last], place[first]
    up, down = bk.powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(bk.VALUES[data] * up[:-1], out=sums[1:])
        whole = bk.mix((sums[p1 + length] - sums[p0]) * down[p0] + ((at - p0) * 65536 + (p1 - p0)).astype(U) * U(0x9FB21C651E98DF25))
        shorter = lambda a, b: bk.mix((sums[b] - sums[a]) * down[a])
        return {"text": text[p0], "p0": p0, "p1": p1, "at": at, "trigger": triggers[at], "whole": whole, "part": shorter}


PHRASE = "trigger long, phrase long, doc_id long, start long, span int, known boolean"


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and the high bits of start that tell rows of one doc_id apart."""
    return batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False) << 40


def _firsts(*keys: np.ndarray, by: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order by keys then by; flags in that order: the least of its keys).  Rows equal in ``by`` to the least are flagged too."""
    order = np.lexsort((*reversed(by), *reversed(keys)))
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    if len(new):
        new[0] = True
    start = np.flatnonzero(new)
    least = np.repeat(start, np.diff(np.r_[start, len(order)]))
    same = np.ones(len(order), bool)
    for b in by:
        s = b[order]
        same &= s == s[least]
    return order, same


def _parse(batches, length: int):
    """The first pass: distinct phrases of a task's buffer, and its own repeats merged to spans (known)."""
    names = [f.split()[0] for f in PHRASE.split(", ")]

    def out(trigger, phrase, doc, start, span, known):
        return pa.RecordBatch.from_arrays([pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(doc), pa.array(start), pa.array(span.astype(np.int32)), pa.array(np.full(len(doc), known))], names)

    def flush(parts):
        trigger, phrase, doc, start, span = (np.concatenate(x) for x in zip(*parts))
        order, least = _firsts(trigger, phrase, by=(doc, start))
        yield out(*(x[order[least]] for x in (trigger, phrase, doc, start, span)), False)
        rest = order[~least]
        if len(rest):
            doc, start, end = merged(doc[rest], start[rest], start[rest] + span[rest] + length)
            spread = bk.mix(doc.view(U) ^ start.view(U))
            yield out(spread, spread, doc, start, end - start, True)

    parts, held = [], 0
    for b in batches:
        doc_id, high = _ids(b)
        for lo, hi, data, offsets in bk.slices(b.column(2)):
            p = phrases(data, offsets, length)
            if p is None:
                continue
            row = lo + p["text"]
            parts.append((p["trigger"], p["whole"], doc_id[row], high[row] + p["p0"] - offsets[p["text"]], p["p1"] - p["p0"]))
            held += len(row)
            if held > BUFFER_ROWS:
                yield from flush(parts)
                parts, held = [], 0
    if parts:
        yield from flush(parts)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap, joined; spans of one row lie within one high part of start."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.r_[True, doc[1:] != doc[:-1]]
    # Running maximum of ends within a doc: ends grow by doc rank to keep documents apart.
    reach = end.copy()
    begin = np.flatnonzero(group)
    for a, b in zip(begin, np.r_[begin[1:], len(doc)]):
        np.maximum.accumulate(reach[a:b], out=reach[a:b])
    new = group.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.r_[at[1:], len(doc)] - 1]


FOUND = "kind byte, doc_id long, start long, span int, trigger long"
#: kind of a row: a span to remove; a trigger whose phrases differ.
SPAN, MARK = 0, 1


def _resolve(batches, length: int):
    """Parse level, on one partition of phrases dealt by trigger."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def out(kind, doc, start, span, trigger):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int8)), pa.array(doc), pa.array(start), pa.array(span.astype(np.int32)), pa.array(trigger)], names)

    parts = []
    for b in batches:
        known = b.column(5).to_numpy(zero_copy_only=False)
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if known.any():
            trigger, _, doc, start, span = (c[known] for c in columns)
            yield out(SPAN, doc, start, span, trigger)
        parts.append([c[~known] for c in columns])
    if not parts:
        return
    trigger, phrase, doc, start, span = (np.concatenate(x) for x in zip(*parts))
    if not len(trigger):
        return
    order, least = _firsts(trigger, phrase, by=(doc, start))
    rest = order[~least]
    yield out(SPAN, doc[rest], start[rest], span[rest] + length, trigger[rest])
    t, p = trigger[order], phrase[order]
    differs = np.flatnonzero((t[1:] == t[:-1]) & (p[1:] != p[:-1]))
    marks = np.unique(t[1:][differs])
    none = np.zeros(len(marks), np.int64)
    yield out(MARK, none, none, none, marks)


def _bits(batches, bits: int):
    """Marked cells of the bitmap, by chunk of 2**16 cells."""
    chunks: dict[int, np.ndarray] = {}
    for b in batches:
        cell = b.column(0).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)
        for c in np.unique(cell >> 16).tolist():
            chunks.setdefault(c, np.zeros(1 << 16, bool))[cell[cell >> 16 == c] & 0xFFFF] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([np.packbits(x).tobytes() for x in chunks.values()], pa.binary())], ["chunk", "cells"])


def mark_map(marks: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of marked triggers by their low bits (the high ones are small, as triggers are minima), at most 2**MAX_BITS cells whatever their number; marks that collide cost time only."""
    count = marks.count()
    bits = min(MAX_BITS, max(MIN_BITS, (16 * count).bit_length()))
    cells = np.zeros(1 << (bits - 3), np.uint8)
    rows = map_arrow(marks.repartition(at_most(marks, 64), F.shiftright(F.col("trigger").bitwiseAND((1 << bits) - 1), 16)), lambda b: _bits(b, bits), "chunk int, cells binary")
    for r in rows.toLocalIterator():
        cells[r["chunk"] << 13 : (r["chunk"] + 1) << 13] |= np.frombuffer(r["cells"], np.uint8)
    return cells, bits


ENTRY = "side long, doc_id long, start long, windows int, phrase long, bytes binary"


def _entries(batches, marked, bits: int, length: int):
    """The second pass: phrases at marked triggers in two parts, each once per task buffer."""
    cells = shared(marked)
    names = [f.split()[0] for f in ENTRY.split(", ")]
    near = (length - GRAM) // 2
    for b in batches:
        doc_id, high = _ids(b)
        for lo, _, data, offsets in bk.slices(b.column(2)):
            p = phrases(data, offsets, length)
            if p is None:
                continue
            cell = (p["trigger"] & U((1 << bits) - 1)).astype(np.int64)
            hit = np.flatnonzero(cells[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
            if not len(hit):
                continue
            text, p0, p1, at, trigger = (p[k][hit] for k in ("text", "p0", "p1", "at", "trigger"))
            parts = []
            for left in (True, False):
                # Windows that hold the `near` bytes before the trigger; the others hold as many after it.
                a, z = (p0, np.minimum(p1, at - near)) if left else (np.maximum(p0, at - near + 1), p1)
                some = np.flatnonzero(a <= z)
                if len(some):
                    a, z, t = a[some], z[some], at[some]
                    other = p["part"](t - near, t) if left else p["part"](t + GRAM, t + GRAM + near)
                    with np.errstate(over="ignore"):
                        side = bk.mix(trigger[some] ^ (other * U(3 if left else 5)))
                        phrase = bk.mix(p["part"](a, z + length) + ((t - a) * 65536 + (z - a)).astype(U) * U(0x9FB21C651E98DF25))
                    row = lo + text[some]
                    parts.append((side, doc_id[row], high[row] + a - offsets[text[some]], z - a + 1, phrase, a, z + length))
            if not parts:
                continue
            side, doc, start, windows, phrase, a, z = (np.concatenate(x) for x in zip(*parts))
            order, least = _firsts(side, phrase, by=(doc, start))
            k = order[least]
            size = np.r_[0, np.cumsum(z[k] - a[k])]
            flat = np.arange(size[-1]) + np.repeat(a[k] - size[:-1], z[k] - a[k])
            raw = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(data[flat])])
            yield pa.RecordBatch.from_arrays([pa.array(side[k].view(np.int64)), pa.array(doc[k]), pa.array(start[k]), pa.array(windows[k].astype(np.int32)), pa.array(phrase[k].view(np.int64)), raw], names)
            k = order[~least]
            if len(k):  # equal to an earlier part: known repeats, without bytes; windows is then the span
                d, s, e = merged(doc[k], start[k], start[k] + windows[k] - 1 + length)
                spread, n = pa.array(bk.mix(d.view(U) ^ s.view(U)).view(np.int64)), len(d)
                yield pa.RecordBatch.from_arrays([spread, pa.array(d), pa.array(s), pa.array((e - s).astype(np.int32)), spread, pa.nulls(n, pa.binary())], names)


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The place of each suffix in the suffix array to a depth of ``length`` bytes; suffixes that agree so far have one rank.

    Prefix doubling: ranks by 8 bytes, then by pairs of ranks.  Beyond the end stand zeros.
    """
    n = len(data)
    wide = np.zeros(n + 8, U)
    wide[:n] = data
    key = np.zeros(n, U)
    for k in range(8):
        key = (key << U(8)) | wide[k : n + k]
    width = 8
    if length < width:
        key >>= U(8 * (width - length))
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, U)
        rank[order] = np.cumsum(new).view(U)
        if width >= length:
            return rank
        step = min(width, length - width)
        later = np.zeros(n, U)
        later[: max(0, n - step)] = rank[step:]
        key = (rank << U(32)) | later  # ranks are below 2**32, as a task holds less
        width += step


def _sorted_windows(batches, length: int):
    """Dictionary level, on one partition of phrase parts dealt by side."""
    parts, texts = [], []

    def spans(d, s, n):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(n.astype(np.int32))], ["doc_id", "start", "span"])

    for b in batches:
        known = b.column(5).is_null()
        if pa.compute.any(known).as_py():
            yield spans(*(b.column(i).filter(known).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
            b = b.filter(pa.compute.invert(known))
        if b.num_rows:
            parts.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
            texts.append(b.column(5))
    if not parts:
        return
    side, doc, start, windows, phrase = (np.concatenate(x) for x in zip(*parts))
    raw = pa.concat_arrays([t.cast(pa.large_binary()) for t in texts])
    order, least = _firsts(side, phrase, by=(doc, start))
    k = order[~least]
    yield spans(doc[k], start[k], windows[k] - 1 + length)
    k = order[least]
    k = k[np.isin(side[k], (s := np.sort(side[k]))[1:][s[1:] == s[:-1]])]  # parts that are alone on their side can't repeat
    k = k[np.lexsort((start[k], doc[k], side[k]))]
    lo, out = 0, []
    while lo < len(k):  # whole sides, at least SORTED_PARTS parts at a time
        hi = min(len(k), lo + SORTED_PARTS)
        hi = int(np.searchsorted(side[k], side[k[hi - 1]], side="right"))
        q = k[lo:hi]
        taken = raw.take(pa.array(q))
        _, off, data = taken.buffers()
        off = np.frombuffer(off, np.int64)[: len(q) + 1]
        data = np.frombuffer(data, np.uint8)[: off[-1]]
        owner = np.repeat(np.arange(len(q)), windows[q])
        step = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(windows[q])[:-1]], windows[q])
        rank = suffix_ranks(data, length)[off[owner] + step]
        w_doc, w_start = doc[q][owner], start[q][owner] + step
        o, least = _firsts(rank, by=(w_doc, w_start))
        r = o[~least]
        if len(r):
            d, s, e = merged(w_doc[r], w_start[r], w_start[r] + length)
            out.append((d, s, e - s))
        lo = hi
    if out:
        yield spans(*(np.concatenate(x) for x in zip(*out)))


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.shiftrightunsigned(row_key(doc_id, text), 41).alias("high"), F.col(text).alias("text"))


def repeat_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs: doc_id, high, text.  Spans to remove (not yet joined): doc_id, high, start, span."""
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())  # as many as the input has, so that a task's share doesn't grow with it
    parsed = map_arrow(docs, lambda b: _parse(b, length), PHRASE)
    found = written(map_arrow(parsed.repartition(tasks, "trigger"), lambda b: _resolve(b, length), FOUND), "phrases")
    cells, bits = mark_map(found.filter(F.col("kind") == MARK).select("trigger"))
    marked = share(spark, cells)
    entries = map_arrow(docs, lambda b: _entries(b, marked, bits, length), ENTRY)
    more = written(map_arrow(entries.repartition(tasks, "side"), lambda b: _sorted_windows(b, length), "doc_id long, start long, span int"), "spans")
    marked.destroy()
    spans = found.filter(F.col("kind") == SPAN).select("doc_id", "start", "span").union(more)
    return spans.select("doc_id", F.shiftrightunsigned("start", 40).alias("high"), F.col("start").bitwiseAND((1 << 40) - 1).alias("start"), "span")


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept string"


def _cut(batches, with_text: bool, carried: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in (whole.slice(at, CUT_ROWS) for whole in batches for at in range(0, whole.num_rows, CUT_ROWS)):
        rows = []
        for text, spans in zip(b.column(0), b.column(1).to_pylist()):
            raw = text.as_py().encode("utf-8", "replace") if text.is_valid else b""
            joined: list[dict] = []
            for s, n in sorted((x["start"], x["span"]) for x in spans or ()):
                if joined and s <= joined[-1]["end"]:
                    joined[-1]["end"] = max(joined[-1]["end"], s + n)
                else:
                    joined.append({"start": s, "end": s + n})
            kept, at = [], 0
            for x in joined:
                kept.append(raw[at : x["start"]])
                at = x["end"]
            left = b"".join([*kept, raw[at:]])
            rows.append((len(raw), len(raw) - len(left), len(joined), hashlib.sha256(left).hexdigest(), joined, left.decode("utf-8", "ignore") if with_text else None))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]
        own = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*(b.column(2 + i) for i in range(carried)), *own], [*(b.schema.names[2 : 2 + carried]), *(f.split(" ")[0] for f in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"))])


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, with_text: bool = False) -> DataFrame:
    """df's columns but the text, then n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans) and, with_text, kept.

    kept leaves out bytes of characters that a span cut in two.  A column of df named
    like one of these, in any case, is replaced.
    """
    outputs = {f.split(" ")[0] for f in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")}
    spans = repeat_spans(keyed(df, doc_id, text), length)
    by_row = spans.groupBy(F.col("doc_id").alias("_id"), F.col("high").alias("_high")).agg(F.collect_list(F.struct("start", "span")).alias("_spans"))
    carried = [f for f in df.schema.fields if f.name != text and f.name.lower() not in outputs]
    docs = df.select(F.col(text).alias("_text"), *[F.col(f"`{f.name}`").alias(f"_c{i}") for i, f in enumerate(carried)], F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), F.shiftrightunsigned(row_key(doc_id, text), 41).alias("_high"))
    met = docs.join(by_row, ["_id", "_high"], "left").select("_text", "_spans", *[f"_c{i}" for i in range(len(carried))])
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([*(StructField(f"_c{i}", f.dataType) for i, f in enumerate(carried)), *_parse_datatype_string(REMOVED).fields])
    out = map_arrow(met, lambda b: _cut(b, with_text, len(carried)), schema)
    names: list[Column] = [F.col(f"_c{i}").alias(f.name) for i, f in enumerate(carried)]
    return out.select(*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", *(["kept"] if with_text else []))
