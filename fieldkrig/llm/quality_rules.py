"""Quality rules: a short-circuit cascade ordered by rejection per cost.

Native: only SQL expressions.  Each rule is a boolean Column of statistics of the text.  On a
bounded sample every rule is timed, to powers of two, and its outcomes are noted; the next rule
of the cascade is always the one that rejects most per cost among the sample's rows that those
before it left (equal ones: by name).  The cascade is one CASE in that order, whose later, dearer rules
are evaluated only for rows that passed the earlier ones; so are the statistics, but for those
that the caller asks for.  The order changes the cost and the name of the first failing
rule, never the verdict.

Null or empty text: no words, rejected by ``few_words``.  Repeated rows are judged
row by row; an empty table gives an empty table; other columns pass through,
except that a column named like an output is replaced.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, unused, words_of, written

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_exclaims")


def _blank_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(_blank_null(text), BLANKS, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(_blank_null(text), "[^#*$%&|<>]+", "")).cast("long")


def exclaims(text: Column) -> Column:
    return F.length(F.regexp_replace(_blank_null(text), "[^!]+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(_blank_null(text), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """64-bit hashes of all windows of so many words, in order."""
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(
            F.size(h) > width, F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))
        ).otherwise(F.array().cast("array<bigint>")),
    )


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes.

    Equal hashes stand next to each other after sorting by (hash, place); the
    flagged places, sorted again, cover min(width, gap to the next) words each.
    """

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    def flagged(s: Column) -> Column:
        same = lambda x, other: F.coalesce(other["h"] == x["h"], F.lit(False))
        twins = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(flagged(s), covered)))


@dataclass(frozen=True)
class Rule:
    """rejects: from the statistics by name to a boolean Column that is true for rows to drop."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


#: The first two are the base limits; the rest are this method's own.
RULES = (
    Rule("few_words", lambda c: c["n_words"] < 20),
    Rule("repeated_windows", lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
    Rule("symbols", lambda c: 10 * c["n_symbols"] > 3 * c["n_words"]),
    Rule("duplicate_lines", lambda c: (c["n_dup_lines"] >= 3) & (2 * c["n_dup_lines"] > c["n_lines"])),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])),
    Rule("exclaims", lambda c: 10 * c["n_exclaims"] > 3 * c["n_words"]),
)


def lazy_stats(text: Column) -> dict[str, Column]:
    """Each statistic as one expression of the text, evaluated only where it is reached."""
    words = words_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": symbols(text),
        "n_dup_lines": duplicate_lines(lines_with_words(text)),
        "n_lines": F.size(lines_with_words(text)).cast("long"),
        "n_repeat_words": repeated_words(window_hashes(words)),
        "n_exclaims": exclaims(text),
    }


def with_stats(df: DataFrame, names: Iterable[str], text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """df with those STATS as columns (words, lines and window hashes computed once), and all STATS as Columns of it: the others are evaluated where they are reached."""
    names = set(names)
    words, lines, hashes = unused(df, "_words", "_lines", "_hashes")
    t = F.col(text)
    if names & {"n_words", "n_repeat_words"}:
        df = df.withColumn(words, words_of(t))
    if names & {"n_dup_lines", "n_lines"}:
        df = df.withColumn(lines, lines_with_words(t))
    if "n_repeat_words" in names:
        df = df.withColumn(hashes, window_hashes(F.col(words)))
    ready = {
        "n_words": lambda: F.size(words).cast("long"),
        "word_chars": lambda: word_chars(t),
        "n_symbols": lambda: symbols(t),
        "n_dup_lines": lambda: duplicate_lines(F.col(lines)),
        "n_lines": lambda: F.size(lines).cast("long"),
        "n_repeat_words": lambda: repeated_words(F.col(hashes)),
        "n_exclaims": lambda: exclaims(t),
    }
    df = df.withColumns({n: ready[n]() for n in STATS if n in names}).drop(words, lines, hashes)
    return df, lazy_stats(t) | {n: F.col(n) for n in names}


def plan_order(df: DataFrame, text: str, rules=RULES, sample_rows: int = 512) -> list[tuple[Rule, float, float]]:
    """(rule, seconds to a power of two, share of the rows left that it rejects) in the order of the cascade, from sample_rows rows.

    The sample only estimates; every row is later judged by every rule it reaches.
    """
    sample = written(df.select(F.col(text)).limit(sample_rows), "sample")
    stats = lazy_stats(F.col(text))
    outcomes = [F.coalesce(r.rejects(stats), F.lit(False)) for r in rules]
    left = [tuple(r) for r in sample.select(*[o.alias(f"r{i}") for i, o in enumerate(outcomes)]).collect()]  # sample_rows rows of booleans; also a warm-up
    cost = []
    for outcome in outcomes:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(outcome)).collect()
            took.append(time.perf_counter() - began)
        cost.append(2.0 ** round(math.log2(min(took))))
    order, rest = [], list(range(len(rules)))
    while rest:
        share = {i: sum(r[i] for r in left) / max(1, len(left)) for i in rest}
        best = min(rest, key=lambda i: (-share[i] / cost[i], cost[i], rules[i].name))
        order.append((rules[best], cost[best], share[best]))
        left = [r for r in left if not r[best]]
        rest.remove(best)
    return order


def cascade(columns: dict[str, Column], rules) -> Column:
    """The first failing rule's name in the order given, or null."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects(columns), F.lit(rule.name)) if out is None else out.when(rule.rejects(columns), F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def quality_rules(df: DataFrame, text: str = "text", rules=RULES, sample_rows: int = 512, stats: Iterable[str] = ()) -> DataFrame:
    """df plus the statistics named, ``failed_rule`` (null if none fails) and ``kept``."""
    order = [m[0] for m in plan_order(df, text, rules, sample_rows)]
    df, columns = with_stats(df, stats, text)
    return df.withColumn("failed_rule", cascade(columns, order)).withColumn("kept", F.col("failed_rule").isNull())
