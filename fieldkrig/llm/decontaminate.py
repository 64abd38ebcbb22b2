"""Benchmark decontamination by template canonicalisation.

Native: only DataFrame operations.  Words are runs of letters and digits.  A
number becomes ``#``, a unit ``@``, a capitalised word ``^``, any other word its lower
case; windows of WIDTH such tokens are hashed and joined with the windows of the
benchmark.  Matches of a document and an item are gathered by diagonal (distance
between the places in either).  A diagonal counts if its slots are consistent: each
benchmark value stands for one document value (two of them may stand for the same).  So a
question with other numbers and names is caught, a chance fit of placeholders is not.

An item leaks into a document if one diagonal covers enough of its windows, or all diagonals
that count do so together and are consistent as a whole (words put in or left out cut an
item into several diagonals).  Enough is min(RUN, half of its windows, rounded up), of the
windows that hold enough plain words.

An item none of whose windows holds enough plain words leaks where all its words stand in
a row, in any case; it counts as one window.

An item of fewer than LEAST words leaks where it is all of a line, one of a single word where it is all of the
text; it counts as one window.  Items of fewer than WIDTH words are one window.  Null or empty texts have no windows.  Rows that
repeat give equal rows; items that share an id count as one, which leaks where any text of it does.
Null ids stay null.  Empty tables: empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, small_side, unused, words_of, written

WIDTH, LEAST, RUN, PLAIN = 8, 5, 6, 4
#: Windows of the benchmark, and matched rows, that may be broadcast; beyond it the joins are shuffled.
BROADCAST_WINDOWS, BROADCAST_ROWS = 200_000, 200_000
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "min", "h", "hours", "minutes", "seconds", "days", "miles", "feet", "inches", "meters", "dollars", "euros", "cents", "percent", "kmh", "mph")
SEPARATORS = "[^\\p{L}\\p{N}]+"
SLOTS = ("#", "@", "^")


def canonical(word: Column) -> Column:
    first, low = F.substring(word, 1, 1), F.lower(word)
    return F.when(first.between("0", "9"), "#").when(F.lower(first) != first, "^").when(low.isin(*UNITS), "@").otherwise(low)


def window_hashes(tokens: Column, width: int) -> Column:
    """Hashes of all windows of so many tokens; tokens: array of hashes."""
    windows = F.transform(F.sequence(F.lit(1), F.size(tokens) - (width - 1)), lambda i: F.xxhash64(F.slice(tokens, i, width), F.lit(width)))
    return F.when(F.size(tokens) >= width, windows).otherwise(F.array().cast("array<bigint>"))


def benchmark_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, words, tokens, width"""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text), SEPARATORS).alias("words")).filter(F.size("words") >= LEAST).dropDuplicates()
    return items.withColumn("tokens", F.transform("words", canonical)).withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """One row per window: item_id, words, width, at, hash, n_windows (of the item)."""
    items = benchmark_items(benchmark, item_id, text)
    windows = items.select("item_id", "words", "width", "tokens", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))).alias("at"))
    windows = windows.withColumn("_w", F.slice("tokens", F.col("at") + 1, F.col("width")))
    plain = F.size(F.filter("_w", lambda t: ~t.isin(*SLOTS)))
    windows = windows.filter(plain >= PLAIN).withColumn("hash", F.xxhash64(F.transform("_w", lambda t: F.xxhash64(t)), F.col("width")))
    counts = windows.groupBy("item_id", "words").agg(F.count(F.lit(1)).alias("n_windows"))
    return windows.join(counts, ["item_id", "words"]).select("item_id", "words", "width", "at", "hash", "n_windows")


def bare_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Items none of whose windows holds enough plain words: item_id, raw (lower case), hash (of the first LEAST)."""
    plain = lambda at: F.size(F.filter(F.slice("tokens", at + 1, F.col("width")), lambda t: ~t.isin(*SLOTS)))
    items = benchmark_items(benchmark, item_id, text).filter(~F.exists(F.sequence(F.lit(0), F.size("words") - F.col("width")), lambda at: plain(at) >= PLAIN))
    items = items.select("item_id", F.transform("words", F.lower).alias("raw")).distinct()
    return items.withColumn("hash", F.xxhash64(F.transform(F.slice("raw", 1, LEAST), lambda t: F.xxhash64(t)), F.lit(LEAST)))


def short_items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Items of fewer than LEAST words: item_id, raw (lower case), hash (of all)."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.transform(words_of(F.col(text), SEPARATORS), F.lower).alias("raw")).filter((F.size("raw") > 0) & (F.size("raw") < LEAST)).distinct()
    return items.withColumn("hash", F.xxhash64("raw"))


def whole_lines(base: DataFrame, short: DataFrame) -> DataFrame:
    """Documents in which a short item is all of a line (of the text, if it is one word), in the columns of leaks().

    Within a line so few words stand in many innocent texts; a line of its own they rarely fill.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: words_of(x, SEPARATORS))
    alone = F.filter(lines, lambda w: F.size(w) > 0)
    own = F.filter(alone, lambda w: (F.size(w) < LEAST) & ((F.size(w) > 1) | (F.size(alone) == 1)))
    rows = base.select("doc_id", "row_key", F.explode(F.array_distinct(F.transform(own, lambda w: F.transform(w, F.lower)))).alias("own")).withColumn("hash", F.xxhash64("own"))
    met = rows.join(small_side(short, BROADCAST_WINDOWS), "hash").filter(F.col("own") == F.col("raw"))
    one = F.lit(1).cast("long")
    return met.select("doc_id", "row_key", "item_id", one.alias("n_windows"), one.alias("matched"), F.lit(True).alias("exact"))


def verbatim(base: DataFrame, bare: DataFrame) -> DataFrame:
    """Documents in which all words of a bare item stand in a row, in the columns of leaks()."""
    hashed = base.select("doc_id", "row_key", F.transform(words_of(F.col("text"), SEPARATORS), lambda w: F.xxhash64(F.lower(w))).alias("h"))
    rows = hashed.select("doc_id", "row_key", F.posexplode(window_hashes(F.col("h"), LEAST)).alias("pos", "hash")).join(small_side(bare, BROADCAST_WINDOWS), "hash")
    found = written(rows.groupBy("doc_id", "row_key", "item_id", "raw").agg(F.collect_set("pos").alias("at")), "verbatim")
    found = small_side(found, BROADCAST_ROWS).withColumnsRenamed({"doc_id": "_id", "row_key": "_key"})
    met = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key"))).withColumn("_own", F.transform(words_of(F.col("text"), SEPARATORS), F.lower))
    met = met.filter(F.exists("at", lambda p: F.slice("_own", p + 1, F.size("raw")) == F.col("raw")))
    one = F.lit(1).cast("long")
    return met.select("doc_id", "row_key", "item_id", one.alias("n_windows"), one.alias("matched"), F.lit(True).alias("exact"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and leaked item: doc_id, row_key, item_id, n_windows, matched, exact (no slot differs)."""
    bench = written(benchmark_windows(benchmark, item_id, item_text), "benchmark")
    widths = sorted(r["width"] for r in bench.select("width").distinct().collect())  # at most WIDTH - LEAST + 1
    base = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    side = small_side(bench.select("hash", "item_id", "words", "at", "n_windows"), BROADCAST_WINDOWS)
    placed = lambda h, width: F.transform(window_hashes(h, width), lambda x, i: F.struct(i.alias("pos"), x.alias("hash")))
    hashes = F.transform(words_of(F.col("text"), SEPARATORS), lambda w: F.xxhash64(canonical(w)))
    windows = let(hashes, lambda h: F.concat(*[placed(h, width) for width in widths or [WIDTH]]))
    found = base.select("doc_id", "row_key", F.inline(windows)).join(side, "hash")
    diagonals = found.groupBy("doc_id", "row_key", "item_id", "words", "n_windows", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("ats"))
    diagonals = written(diagonals, "diagonals")
    # The words in the document at the matched places, to look at the slots; written, so that a text is split once.
    met = base.join(small_side(diagonals, BROADCAST_ROWS).withColumnsRenamed({"doc_id": "_id", "row_key": "_key"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_key") == F.col("_key")))
    width = F.least(F.size("words"), F.lit(WIDTH))
    places = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + width - 1))))
    slots = let(words_of(F.col("text"), SEPARATORS), lambda own: F.transform(places, lambda i: F.struct(F.get("words", i).alias("theirs"), F.get(own, i + F.col("shift")).alias("own"))))
    slots = F.array_distinct(F.filter(slots, lambda p: canonical(p["theirs"]).isin(*SLOTS)))
    met = written(met.select("doc_id", "row_key", "item_id", "words", "n_windows", "ats", slots.alias("slots")), "slots")
    consistent = lambda slots: F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda p: p["theirs"])))
    good = met.filter(consistent(F.col("slots"))).withColumn("same", F.forall("slots", lambda p: p["theirs"] == p["own"]))
    every = F.array_distinct(F.flatten(F.collect_list("slots")))
    pair = good.groupBy("doc_id", "row_key", "item_id", "words", "n_windows").agg(
        F.max(F.struct(F.size("ats").alias("n"), "same")).alias("best"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"),
        F.bool_and("same").alias("same"),
        every.alias("slots"),
    )
    whole = consistent(F.col("slots"))
    pair = pair.select("doc_id", "row_key", "item_id", "n_windows", F.when(whole, F.col("n")).otherwise(F.col("best.n")).cast("long").alias("matched"), F.when(whole, F.col("same")).otherwise(F.col("best.same")).alias("exact"))
    need = F.least(F.lit(RUN), F.ceil(F.col("n_windows") / 2))
    out = pair.filter(F.col("matched") >= need)
    bare = written(bare_items(benchmark, item_id, item_text), "bare")
    if not bare.isEmpty():
        out = out.unionByName(verbatim(base, bare))
    short = written(short_items(benchmark, item_id, item_text), "short")
    if not short.isEmpty():
        out = out.unionByName(whole_lines(base, short))
    rows = out.groupBy("doc_id", "row_key", "item_id").agg(F.max(F.struct("exact", "matched", "n_windows")).alias("m"))
    return rows.select("doc_id", "row_key", "item_id", "m.n_windows", "m.matched", "m.exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows into which an item leaks."""
    own_id, own_key = unused(docs, "_id", "_key")
    bad = written(leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(own_id), F.col("row_key").alias(own_key)).distinct(), "leaks")
    return docs.join(small_side(bad, BROADCAST_ROWS), F.col(doc_id).eqNullSafe(F.col(own_id)) & (row_key(doc_id, text) == F.col(own_key)), "left_anti")
