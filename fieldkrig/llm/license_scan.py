"""License scan: phrases, and an exact set-similarity join with license templates.

Native: only DataFrame operations.  A block is a window of WIDTH words, one every
WIDTH / 2 words, so that any WIDTH / 2 words in a row lie inside a block.  A block
meets a template if it holds at least ``threshold`` of the template's distinct
tokens.  The join finds all such blocks:

* tokens are ordered by their frequency over all documents, rarest first, in blocks and templates;
* prefix filter: a block with ``need`` of a template's ``n`` tokens holds one of
  its ``n - need + 1`` rarest, so only blocks at such a token become candidates;
* length filter: a block with fewer than ``need`` template tokens can't match;
* positional filter: of the tokens that a block and a template share, the first stands at place i of
  the block's m template tokens and at place p of the template's n, so at most
  min(m - i, n - p) are shared.

Templates come from license_texts (or the caller), so the frequency table and the prefix table have a
size that doesn't depend on the corpus; the prefix table is broadcast up to BROADCAST_PREFIXES rows.

Null or empty text: no words, no labels, score 0.  Rows that repeat are scanned
row by row.  An empty table gives an empty table.  Other columns pass through; one that is
named like an output is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, words_of
from .license_texts import templates as license_templates

#: What separates words: any ASCII character but digits and letters.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

TEMPLATES = license_templates()
BROADCAST_PREFIXES = 100_000

WIDTH = 64


def lower(text: Column) -> Column:
    """Lower case.  Of all other letters than A-Z only the Kelvin sign would become an ASCII one, so it is put aside."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u2126")))


def token_counts(df: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each token of the vocabulary occurs in all documents."""
    hits = F.filter(words_of(lower(F.col(text)), SEPARATORS), lambda w: w.isin(vocabulary))
    found = df.select(F.explode(hits).alias("token")).groupBy("token").count().collect()  # at most one row for each template token
    return dict.fromkeys(vocabulary, 0) | {r["token"]: r["count"] for r in found}


def base_places(words: Column, phrases=PHRASES) -> Column:
    """array<struct<start, label>> of every place where a phrase's words stand in a row; words are lower case."""
    def places(parts: list[str], label: str) -> Column:
        last = F.greatest(F.size(words) - len(parts), F.lit(0))
        here = lambda i: F.coalesce(_all(F.get(words, i + k) == p for k, p in reversed(list(enumerate(parts)))), F.lit(False))
        return F.transform(F.filter(F.sequence(F.lit(0), last), here), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[places(phrase.split(), label) for phrase, label in phrases])


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def license_scan(df: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = 0.9) -> DataFrame:
    """df plus n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment of a block that meets the threshold, else 0)."""
    spark = df.sparkSession
    token_sets = [(label, sorted(set(t.split()))) for label, t in templates]
    vocabulary = sorted({w for _, s in token_sets for w in s})
    count = token_counts(df, text, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count[w], w)))}
    rows = []
    for i, (label, s) in enumerate(token_sets):
        need = math.ceil(threshold * len(s) - 1e-9)
        ordered = sorted(s, key=rank.get)
        rows += [(i, label, ordered, need, place, ordered[place]) for place in range(len(s) - need + 1)]
    prefix = spark.createDataFrame(rows, "template int, label string, tokens array<string>, need int, place int, token string")
    triggers = sorted({r[5] for r in rows})
    by_rank = F.array(*map(F.lit, sorted(vocabulary, key=rank.get)))

    half = WIDTH // 2
    outputs = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    passed = [c for c in df.columns if c.lower() not in outputs and c != text]
    base = df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(passed)], F.col(text).alias("_text"))
    # Only rows with a template token or a phrase's last word need more than the number of words.
    ends = sorted({p.split()[-1] for p, _ in phrases})
    base = base.withColumn("_lower", words_of(lower(F.col("_text")), SEPARATORS))
    base = base.withColumn("_hit", F.exists("_lower", lambda w: w.isin(triggers)))
    base = base.withColumn("_n", F.size("_lower").cast("long"))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    base = base.withColumn("_base", F.when(F.arrays_overlap("_lower", F.array(*map(F.lit, ends))), base_places(F.col("_lower"), phrases)).otherwise(none))
    # Candidate blocks: for a trigger at word i, the blocks that start at or half a width before i's half block.
    at = F.filter(F.transform("_lower", lambda w, i: F.when(w.isin(triggers), F.floor(i / half).cast("int"))), lambda x: x.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(at, lambda b: F.array(b, F.greatest(b - 1, F.lit(0))))))
    # Of a block the template tokens are kept, in the order of tokens (array_intersect follows its first array).
    blocks = F.transform(starts, lambda b: F.array_intersect(by_rank, F.slice("_lower", b * half + 1, WIDTH)))
    base = base.withColumn("_blocks", F.when(F.col("_hit"), blocks)).drop("_text", "_lower", "_hit")
    rows = base.withColumn("_block", F.explode_outer(F.array_distinct(F.concat(F.array(F.lit(None).cast("array<string>")), F.coalesce("_blocks", F.array().cast("array<array<string>>"))))))
    tokens = F.filter(F.transform("_block", lambda w, i: F.struct(w.alias("token"), i.alias("place"))), lambda x: x["token"].isin(triggers))
    rows = rows.withColumn("_first", F.col("_block").isNull()).drop("_blocks").withColumn("_at", F.explode_outer(tokens))
    long_enough = F.size("_block") >= F.col("need")
    in_reach = F.least(F.size("_block") - F.col("_at.place"), F.size("tokens") - F.col("place")) >= F.col("need")
    met = rows.join(small_side(prefix, BROADCAST_PREFIXES), (F.col("_at.token") == F.col("token")) & long_enough & in_reach, "left")
    leading = F.size(F.array_intersect(F.slice("tokens", 1, F.col("place")), "_block")) == 0  # no token shared before this one
    shared = F.when(leading, F.size(F.array_intersect("_block", "tokens")))
    met = met.withColumn("_score", F.when(shared >= F.col("need"), shared / F.size("tokens")))
    out = met.groupBy("_row").agg(
        F.first(F.when(F.col("_first"), F.struct("_n", "_base", *[f"_p{i}" for i in range(len(passed))])), ignorenulls=True).alias("_b"),
        F.array_compact(F.collect_set(F.when(F.col("_score").isNotNull(), F.col("label")))).alias("_found"),
        F.coalesce(F.max("_score"), F.lit(0.0)).alias("score"),
    )
    places = F.col("_b._base")
    base_set = F.array_distinct(F.transform(places, lambda p: p["label"]))
    starts = F.transform(places, lambda p: p["start"])
    return out.select(
        *[F.col(f"_b._p{i}").alias(c) for i, c in enumerate(passed)],
        F.col("_b._n").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, F.col("_found"))), ",").alias("labels"),
        "score",
    )
