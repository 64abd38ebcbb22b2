"""Jaccard join, repeats, packing, WARC, classifier and scoring against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import pickle
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from fieldkrig.llm import common, kn_classifier, lm_score, ngram_join, packing, suffix_dedup, warc
from fieldkrig.llm.components import components

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def texts(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, short, empty, blank and long texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdé") for _ in range(rng.randrange(2, 7)))
    base = [" ".join(word() for _ in range(rng.randrange(30, 200))) for _ in range(8)]
    passage = " ".join(word() for _ in range(60))
    rows: list[str | None] = [None, "", " \n ", "one", "one two three", "a a a a a a a a a", "ONE two Three", "x" * 700, "ab " * 300, passage]
    while len(rows) < n:
        t = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.3:
            t[10:10] = passage.split()
        rows.append(" ".join(t))
    rows.append(" ".join(word() for _ in range(6000)))
    return list(enumerate(rows))


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("limit", [None, 2])
def test_jaccard_components(spark, monkeypatch, limit):
    """limit: a sketch cell counts as frequent from so few shingles on, so pairs of frequent shingles do the work."""
    if limit is not None:
        plain = ngram_join.frequency_classes

        def few(counts, total):
            classes = plain(counts, total)
            cells = np.zeros(classes.size, np.int64).reshape(64, -1)
            for r in counts.collect():
                cells[r["chunk"]] += np.frombuffer(r["counts"], np.uint8)
            return (cells.ravel() > limit).astype(np.uint8)

        monkeypatch.setattr(ngram_join, "frequency_classes", few)
        monkeypatch.setattr(ngram_join, "TILE", 5)
    rows = texts(2, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    want = brute.jaccard_components(rows)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_pair_entries_meet():
    """Any two sets at the limit share an entry, whatever elements are frequent."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(4, 60))
        x = np.unique(rng.integers(0, 2**62, n * 2, dtype=np.int64).astype(np.uint64))[:n]
        lost = int(rng.integers(0, n - ngram_join.need_of(n, 80) + 1))
        y = np.concatenate([np.delete(x, rng.choice(n, lost, replace=False)), rng.integers(0, 2**62, int(rng.integers(0, 3))).astype(np.uint64)])
        if len(np.intersect1d(x, y)) * 180 < 80 * (len(x) + len(y)) or len(y) < 4:
            continue
        rare = rng.random() * 0.2
        is_rare = lambda v: (v % np.uint64(1000)) < np.uint64(rare * 1000)
        entries = []
        for s in (x, y):
            s = np.sort(s)
            r, f = s[is_rare(s)], s[~is_rare(s)]
            need = len(s) - ngram_join.need_of(len(s), 80) + 1
            own = set(r[:need].tolist())
            if len(r) < need:
                own |= set(ngram_join.pair_entries(f, len(r), len(s), 80).tolist())
            entries.append(own)
        assert entries[0] & entries[1]


def test_jaccard_edges(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "q r s t u v"), (None, "a b c d e f g"), (None, None), (9, "A B C D E F G")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (5, 2, 5), (None, 3, 5), (None, 0, None), (9, 3, 5)], key=str)
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long").repartition(5)).collect()}
    assert all(got.get(v, v) == root(v) for v in list(parent))


def test_suffix_ranks():
    """Order and equality of all suffixes to a depth, against sorting the strings."""
    rng = np.random.default_rng(3)
    for length in (1, 5, 8, 9, 33, 100):
        data = rng.integers(97, 99, 600).astype(np.uint8)
        data[300:500] = data[100:300]
        raw = data.tobytes() + b"\0" * length
        want = [raw[i : i + length] for i in range(600)]
        rank = suffix_dedup.suffix_ranks(data, length)
        place = {w: i for i, w in enumerate(sorted(set(want)))}
        assert rank.tolist() == [place[w] + 1 for w in want]


def test_repeats_need_the_suffix_array(spark, monkeypatch):
    """Windows that repeat in phrases which differ are found by the dictionary's suffix array alone."""
    rows = texts(3, 70)
    monkeypatch.setattr(suffix_dedup, "suffix_ranks", lambda data, length: np.arange(len(data)))
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    want = {d: r[1] for d, r in brute.repeated_bytes(rows).items()}
    assert got != want and all(got[d] <= want[d] for d in want)


def test_repeated_bytes(spark):
    rows = texts(3, 70)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == brute.repeated_bytes(rows)


def test_repeated_bytes_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(3, long, 1), (None, long, 2), (3, long + " end", 3), (4, None, 4)], "doc_id long, text string, n_bytes int")
    out = suffix_dedup.remove_repeats(df, with_text=True).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"] > 0, r["n_removed"] > 0) for r in out) == [(-1, True, False), (3, True, True), (3, True, True), (4, False, False)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = texts(4, 80) + [(1000, "it's <|endoftext|> OK... \x85nbsp\xa0x <|STARTOFTEXT|> É́ 123,45 ,,.. a. b, c-. ǅ."), (1001, "word, " * 9000)]
    out = packing.pack_documents(frame(spark, rows), TOKENIZER, open_windows=4, with_ids=True).collect()
    tokenizer, by, seq = Tokenizer.from_file(TOKENIZER), defaultdict(list), defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for d, t in rows:
        ids, own = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], sorted(by[d], key=lambda r: r["start"])
        assert [i for r in own for i in r["ids"]] == ids
        at = 0
        for r in own:
            piece = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += r["length"]
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    total = sum(r["length"] for r in out)
    assert len(seq) <= 1.1 * total / 4096 + 2
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def test_packing_merge_ends(spark, monkeypatch):
    """Windows over half full that can't be merged, more of them than a task takes, don't keep the merge going."""
    monkeypatch.setattr(packing, "MERGE_ITEMS", 4)
    rows = [(i, "a " * (59 if i % 7 else 9)) for i in range(60)]
    out = packing.pack_documents(frame(spark, rows, 6), TOKENIZER, limit=100, open_windows=4).collect()
    assert sorted(r["doc_id"] for r in out) == [d for d, _ in rows]
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 100 and sum(f <= 50 for f in fill.values()) <= 1


def test_packing_with_another_tokenizer(spark):
    """A tokenizer that keeps case and white space encodes whole texts."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Hello,  World\nfoo BAR."), (2, None), (None, "Ünï  x"), (1, "Hello,  World\nfoo BAR.")]
    tokenizer = Tokenizer.from_file(path)
    want = sorted(([*tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for _, t in rows))
    got = packing.pack_documents(frame(spark, rows), path, eos=7, with_ids=True).collect()
    assert sorted(r["ids"] for r in got) == want and sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None"]


def test_jaccard_tiles_are_contracted(spark, monkeypatch):
    """Blocks of several tiles: one large cluster, and a chain whose links lie across tiles."""
    monkeypatch.setattr(ngram_join, "TILE", 3)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(40):
        t = base.copy()
        t[rng.randrange(60)] = f"x{d}"
        rows.append((d, " ".join(t)))
    for d in range(100, 124):  # each is close to the next only
        rows.append((d, " ".join(f"c{i}" for i in range((d - 100) * 2, (d - 100) * 2 + 40))))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == brute.jaccard_components(rows)


def test_components_in_few_and_many_edges(spark, monkeypatch):
    from fieldkrig.llm import components as module

    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)], "x long, y long").repartition(3)
    want = {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert {r["v"]: r["component"] for r in components(edges).collect()} == want
    monkeypatch.setattr(module, "FEW_EDGES", 3)
    assert {r["v"]: r["component"] for r in components(edges).collect()} == want


def test_shared_values_need_no_package(spark):
    """Broadcast values carry their classes: tasks read them where this package can't be imported."""
    held = common.share(spark, kn_classifier.Model(np.arange(50, dtype=np.uint64), np.ones(50, np.int64)))
    head, arrays = held.value
    script = "import pickle, sys\nhead, arrays = pickle.load(sys.stdin.buffer)\nassert 'fieldkrig' not in sys.modules\nprint(pickle.loads(head, buffers=arrays).log_probability(__import__('numpy').arange(3, dtype='u8')).shape)"
    done = subprocess.run([sys.executable, "-c", script], input=pickle.dumps((head, arrays)), capture_output=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.strip() == b"(3,)", done.stderr.decode()[-500:]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_warc_edges(spark):
    """Rows that are alike in everything, null ids and urls, columns that clash, an empty table."""
    rows = [(1, "http://a.b/", "<p>x</p>", "k", 1)] * 5 + [(None, None, None, "k", 2)] * 3 + [(2, "http://a.b/", "<p>x</p>", "k", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string, digest int").repartition(4)
    out = warc.archive_round_trip(spark, df).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out) == {(1, "response", None): 1, (1, "revisit", 1): 4, (None, "response", None): 1, (None, "revisit", None): 2, (2, "revisit", 1): 1}
    assert warc.archive_round_trip(spark, df.limit(0)).count() == 0


def test_warc_query_reads_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(warc.IndexFile, "captures", lambda self, key: [])
    df = spark.createDataFrame([(1, "http://a.b/", "x")], "page_id long, url string, html string")
    assert warc.archive_round_trip(spark, df).count() == 0


def test_warc_key_in_several_blocks(spark, monkeypatch):
    """A URL of very many captures lies in many blocks and files; all are found."""
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 8)
    df = spark.createDataFrame([(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/\t{i}", f"<p>{i}</p>") for i in range(400)], "page_id long, url string, html string").repartition(5)
    assert sorted(r["page_id"] for r in warc.archive_round_trip(spark, df).collect()) == list(range(400))


def test_warc(spark):
    pages = [(i, f"http://h{i % 3}.example.org/p{i % 7}", f"<p>{i % 5}</p>" if i % 4 else None) for i in range(60)] + [(None, None, "<p>1</p>"), (3, "http://x.y/", "<p>3</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    rows = warc.archive_round_trip(spark, df).collect()
    first: dict[str, int] = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    assert len(rows) == len(pages)
    for r in rows:
        assert r["record_type"] == ("response" if r["refers_to"] is None else "revisit")
    by = defaultdict(list)
    for r in rows:
        by[r["payload_digest"]].append(r)
    for h, p in first.items():
        own = by[base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()]
        assert [r["page_id"] for r in own if r["record_type"] == "response"] == [p]
        assert all(r["refers_to"] == p and r["payload_bytes"] == len(h) for r in own if r["record_type"] == "revisit")


def test_warc_lookup(spark):
    folder = common.shared_dir(spark) + "/warc-lookup"
    pages = spark.createDataFrame([(i, f"http://www.h{i % 9}.example.org/p{i}", f"<p>{i}</p>") for i in range(3000)], "page_id long, url string, html string").repartition(3)
    index = warc.build_index(warc.write_archives(pages, folder), folder)
    files = sorted((r["first_key"], r["file"]) for r in index.collect())
    found = warc.lookup(files, folder, "http://www.h4.example.org/p1354")
    assert [(f["page_id"], f["payload"]) for f in found] == [(1354, b"<p>1354</p>")]
    assert warc.lookup(files, folder, "http://nowhere.test/") == []
    some = spark.createDataFrame([("http://www.h4.example.org/p1354",), ("http://nowhere.test/",), ("https://www.H4.example.org/p1354",)], "url string")
    assert [r["page_id"] for r in warc.read_archives(some, index, folder).collect()] == [1354]
    assert warc.url_key("http://a.b.org/x?y=1") == "org,b,a)/x?y=1"


def test_min_revisit_bytes(spark):
    df = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    assert [r["record_type"] for r in warc.archive_round_trip(spark, df, 5).collect()] == ["response", "response"]


def test_kneser_ney_sums_to_one():
    keys, counts = np.unique(np.random.default_rng(2).integers(97, 103, (4000, 5)) @ (256 ** np.arange(4, -1, -1)), return_counts=True)
    model = kn_classifier.Model(keys.astype(np.uint64), counts)
    for context in (keys[0] >> 8, keys[50] >> 8, 0x7A7A7A7A):
        p = np.exp(model.log_probability(((int(context) << 8) + np.arange(256)).astype(np.uint64)).astype(float))
        assert abs(p.sum() - 1) < 1e-4


def test_perplexity_by_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(3, 60))), "en") for i in range(40)]
    rows += [(50, "zzz unlike anything", "en"), (51, "a", "en"), (52, "abc" * 2000, "en"), (53, None, "en"), (0, "a second row of id 0", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    perplexity = brute.kneser_ney([t.encode() for i, t, _ in rows if 1 <= i < 30])
    out = kn_classifier.classify(docs, labels).collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["n_bytes"]): r["perplexity"] for r in out}
    for d, t, _ in rows:
        if t:
            assert abs(by[d, len(t.encode())] / perplexity(t.encode()) - 1) < 1e-3


def test_filter_quality_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", 3, 4), (1, "a b c", "en", 3, 4), (2, None, "en", 3, 4)], "doc_id long, text string, lang string, _id int, _key int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = kn_classifier.filter_quality(docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1, 1]


def test_classifier(spark):
    rng = random.Random(1)
    good = lambda n: " ".join(rng.choice(("the", "river", "runs", "over", "old", "stones", "and", "sand")) for _ in range(n))
    rows = [(i, good(60), "en") for i in range(80)] + [(100, "## $$ %% @@ !! " * 20, "en"), (101, None, "en"), (102, "", None), (103, good(300), None), (104, good(2), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in kn_classifier.classify(docs, labels).collect()}
    assert [d for d, r in out.items() if not r["kept"]] == [d for d in out if d in (100, 101, 102)]
    assert out[101]["perplexity"] is None and math.isfinite(out[104]["threshold"])
    assert kn_classifier.filter_quality(docs, labels).columns == docs.columns
    assert kn_classifier.classify(docs.limit(0), labels).count() == 0
    assert kn_classifier.classify(docs, labels.limit(0)).filter("kept").count() == len(rows) - 2


def test_scoring(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(words[(i * 7 + j * (1 + i % 3)) % 50] for j in range(rng.randrange(1, 80)))) for i in range(200)] + [(900, None), (901, ""), (902, "Unseen WORDS here"), (None, "w1 w2")]
    out = {r["doc_id"]: r for r in lm_score.score_texts(frame(spark, rows)).collect()}
    find = re.compile(rb"[^\x20\x09-\x0D]+")
    tokens = {d: [*find.findall((t or "").encode().lower()), None] for d, t in rows}
    outside = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    count = Counter(x for d, t in tokens.items() if not outside(d) for x in t)
    total, distinct = sum(count.values()), len(count)
    gain = 0.0
    for d, t in tokens.items():
        r = out[d]
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (outside(d), len(t), sum(count[x] > 0 for x in t), total)
        assert abs(r["base_score"] - base) < 1e-6
        gain += r["score"] - r["base_score"] if outside(d) else 0
    assert gain > 0
    assert lm_score.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_score_by_plain_mixing(spark):
    """The whole model against a version that goes token by token and keeps contexts without hashing: the same but for the few texts with contexts whose slots collide."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    rows = [(i, " ".join(words[min(47, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(0, 9)))) for i in range(40)] + [(70, "never seen WORDS au"), (71, None)]

    def token(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        h, suffix, _ = lm_score.tokens(raw, np.array([0, len(raw)]))
        return h[:1].view(np.int64)[0], int(suffix[0])

    want = brute.context_mixing(rows, lambda w: lm_score.END.view(np.int64)[0] if w is None else token(w)[0], lambda w: token(w)[1])
    out = lm_score.score_texts(frame(spark, rows).coalesce(1).orderBy("doc_id")).collect()
    off = np.array([abs(r["score"] + r["spelling"] - want[r["doc_id"]]) / r["n_tokens"] for r in out])
    assert off.max() < 0.02 and (off < 1e-3).mean() > 0.75
    for r in out:
        size = len((dict(rows)[r["doc_id"]] or "").encode())
        assert r["n_bytes"] == size and (r["bits_per_byte"] is None if not size else abs(r["bits_per_byte"] + (r["score"] + r["spelling"]) * math.log2(10) / size) < 1e-9)


def test_rare_words_join(spark, monkeypatch):
    """With a tiny table of common words, nearly all words meet their counts in the join."""
    monkeypatch.setattr(lm_score, "TOP_WORDS", 3)
    rows = [(i, f"a b a c{i % 4} d{i}") for i in range(40)]
    out = lm_score.score_texts(frame(spark, rows)).collect()
    tokens = {d: [*t.split(), None] for d, t in rows}
    count = Counter(x for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 10 for x in t)
    for r in out:
        assert r["n_known"] == sum(count[x] > 0 for x in tokens[r["doc_id"]])
        base = sum(math.log10((count[x] + 0.1) / (sum(count.values()) + 0.1 * (len(count) + 1))) for x in tokens[r["doc_id"]])
        assert abs(r["base_score"] - base) < 1e-6


def test_scores_do_not_depend_on_the_dealing(spark, monkeypatch):
    """1, 3 and 10 partitions, with several learners: the same scores."""
    monkeypatch.setattr(lm_score, "LEARNER_TOKENS", 500)
    monkeypatch.setattr(lm_score, "MIX_BATCH", 64)
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{min(200, int(rng.expovariate(0.05)))}" for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(5, "w1 w2 w3"), (None, "w1")]
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["base_score"])
    one, *others = ([(r["doc_id"], r["score"]) for r in sorted(lm_score.score_texts(frame(spark, rows, n)).collect(), key=key)] for n in (1, 3, 10))
    for other in others:
        assert [d for d, _ in one] == [d for d, _ in other] and np.allclose([s for _, s in one], [s for _, s in other], atol=1e-6)


def test_unseen_words_are_spelled(spark):
    rows = [(i, "common words here and there " * 3 + f"u{i}") for i in range(1, 60)] + [(100, "q"), (101, "q" * 1000), (102, "common")]
    assert zlib.crc32(b"100") % 10 and zlib.crc32(b"101") % 10
    held = [d for d in range(200, 260) if zlib.crc32(str(d).encode()) % 10 == 0][:2]
    out = {r["doc_id"]: r for r in lm_score.score_texts(frame(spark, rows[:-3] + [(held[0], "q"), (held[1], "q" * 1000)])).collect()}
    short, long = out[held[0]], out[held[1]]
    assert long["spelling"] < short["spelling"] - 500 and long["bits_per_byte"] > 2 and short["n_known"] == long["n_known"] == 1


def test_top_words_are_exact(spark, monkeypatch):
    """Many words far beyond any count of a bin: the threshold is where the table is full."""
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([5_000_000_000] * 3 + [300_000, 299_999, 200_001, 200_000, 200_000, 70_000, 5, 2, 1])], "word long, n long")
    want = {0: 1 << 62, 2: 1 << 62, 3: 5_000_000_000, 4: 300_000, 5: 299_999, 6: 200_001, 7: 200_001, 8: 200_000, 9: 70_000, 99: 2}
    many = lambda least: counts.filter(f"n >= {least}").count()
    assert {room: many(lm_score.least_common(counts, room)) for room in want} == {room: many(least) for room, least in want.items()}
    assert lm_score.least_common(counts.filter("n < 2"), 5) == lm_score.least_common(counts.limit(0), 5) == 1 << 62


def summed_tables(vocabulary, parts):
    """Ones and zeros of all slots, with each part counted by a task of its own."""
    held, total = type("Held", (), {"value": (cloudpickle.dumps(vocabulary), [])}), np.zeros((2, 2 * lm_score.OFFSETS[-1]), np.int64)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["doc_id", "text"])
    for out in lm_score._sum_tables(b for rows in parts for b in lm_score._tables([batch(rows)], held)):
        for chunk, width, raw in zip(*(c.to_pylist() for c in out.columns)):
            pair = np.frombuffer(raw, f"<u{width}").reshape(2, -1)
            if chunk == lm_score.SPELLING:
                continue
            total[:, chunk * lm_score.CHUNK : chunk * lm_score.CHUNK + pair.shape[1]] = pair
    return total[:, : lm_score.OFFSETS[-1]] + total[:, lm_score.OFFSETS[-1] :]


def test_context_counts_are_exact():
    """A context seen more than 65535 times by one task keeps its counts, whatever the partitioning."""
    key = np.array([np.uint64(lm_score.tokens(np.frombuffer(w, np.uint8), np.array([0, 1]))[0][0]) for w in (b"a", b"b")])
    vocabulary = lm_score.Vocabulary(key.view(np.int64), np.array([200_000, 70_000]), np.zeros(2, np.int64), 270_000, 2)
    rows = [(d, "a a a b " * 25_000) for d in range(1, 9) if zlib.crc32(str(d).encode()) % 10][:4]
    together, apart = summed_tables(vocabulary, [rows]), summed_tables(vocabulary, [[r] for r in rows])
    assert (together == apart).all()
    # Each text has 75,001 tokens after class 0 ("a", or the text's start); all have a one or a zero at the root.
    root = lm_score.slots([np.zeros(1, np.uint64)] * 4, np.ones(1, np.int64))[0][0]
    assert together[:, root].sum() == 4 * 75_001
    assert together[:, : lm_score.OFFSETS[1]].sum() == 4 * 100_001 * lm_score.CLASS_BITS


def test_mixer_learns_from_all_texts(spark, monkeypatch):
    """Beyond 600 texts, and from texts of over 20,000 characters: every decision of every training text counts."""
    met = []
    adopt = lm_score.Mixer.adopt
    monkeypatch.setattr(lm_score.Mixer, "adopt", lambda self, total: (met.append(total[self.weights.size :][: self.met.size].sum()), adopt(self, total)))
    rows = [(i, f"a b c{i % 5}") for i in range(900)] + [(i, "a b c1 d " * 3000) for i in range(900, 906)]
    lm_score.score_texts(frame(spark, rows)).collect()
    tokens = sum(len(t.split()) + 1 for d, t in rows if zlib.crc32(str(d).encode()) % 10)
    assert met == [tokens * lm_score.CLASS_BITS]


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    mixer = lm_score.Mixer(rng.integers(0, 9, lm_score.OFFSETS[-1]), rng.integers(0, 9, lm_score.OFFSETS[-1]))
    c = np.arange(lm_score.CLASSES)
    ctx = [np.full(len(c), v, np.uint64) for v in (5, 77, 123456789, 987654321)]
    assert abs(np.exp(mixer.log_probability(ctx, c).astype(float)).sum() - 1) < 1e-4


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(d, t, "en", "s", len(t or "")) for d, t in texts(8, 60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d, *_ in rows if d > 9], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, rows[20][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after = common.written(after, "test")
        assert 0 < after.count() <= docs.count()
        docs = after
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


def _fixture(spark, path, rows, labels, items):
    spark.createDataFrame([(d, t, g, "s", len(t or ""), 1, 2) for d, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, _key int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(d, t, "en" if d % 3 else "de") for d, t in texts(8, 60)] + [(200, "## $$ %% !! 0 0 0 " * 30, "en"), (201, "a river runs over old stones and then under the bridge near the mill", None)]
    labels = [d for d, t, _ in rows if 9 < d < 60 and t]
    items = [(0, rows[20][1]), (1, "What is 12 plus 34 minus 56")]
    _fixture(spark, tmp_path, rows, labels, items)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = brute.pipeline(rows, labels, items, lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {d: len(ids) for d, ids in want.items()}
    for r in got:
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
    assert 0 < len(want) < len(rows) - 15


def test_pipeline_edges(spark, tmp_path):
    """Null, empty and repeated rows, columns named as helpers are, an empty table: every stage keeps the columns and passes."""
    pipeline = pytest.importorskip("corpus_pipeline")
    good = "the river runs over old stones and sand near the mill while birds sing above the water "
    rows = [(1, good, "en"), (1, good, "en"), (1, "another text of this id about birds and the mill", "en"), (None, good + "again", "en"), (None, None, None), (3, "", "en"), (4, None, "en"), (5, good * 3, "xx")]
    _fixture(spark, tmp_path, rows, [1], [(None, None), (9, "not in any document of this small table at all")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for df in (docs, docs.limit(0)):
        left = df
        for name, stage in pipeline.STAGES[:-1]:
            left = common.written(stage(spark, left, str(tmp_path)), "edges")
            assert left.columns == docs.columns, name
        packed = pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
        assert len(packed) >= left.count() and (df is docs) == bool(packed)
    for name, stage in pipeline.STAGES[2:4]:
        assert {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()} >= {None, 3, 4}, name
