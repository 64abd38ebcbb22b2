"""Vector codes, phrase mining and token files against plain Python."""

from __future__ import annotations

import glob
import random
import zlib

import numpy as np
import pytest

from fieldkrig.llm import phrase_mining, token_orc, vector_codes

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# Vector codes


def vectors(seed: int, n: int, dim: int = 16):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(7 * i % 1009, [round(x + rng.gauss(0, 0.2), 3) for x in rng.choice(centers)], rng.choice([None, 1, 2, 3])) for i in range(n)]
    rows += [(2000, None, 1), (2001, [None] * dim, 1), (2002, [float("nan")] * dim, 1), (2003, [float("inf"), *[0.0] * (dim - 1)], None), (2004, [0.0] * dim, None), (2005, [-0.0] * dim, 9)]
    return rows + [(3000 + i, rows[i % 3][1], 1) for i in range(n // 2)]  # many equal vectors


SCHEMA = "vec_id long, embedding array<double>, label int"


def coded(df, **options):
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.vector_codes(df, **options).collect()}


@pytest.mark.parametrize("cells", [1 << 16, 40])
def test_vector_codes(spark, monkeypatch, cells):
    """cells: with few, tasks forget their lists again and again."""
    monkeypatch.setattr(vector_codes, "MEMO_CELLS", cells)
    rows = vectors(1, 150)
    want, digest = brute.vector_codes(rows)
    got = coded(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == {i: (*v, digest) for i, v in want.items()}


def test_vector_codes_go_through_the_cells(spark, monkeypatch):
    rows = vectors(2, 40)
    monkeypatch.setattr(vector_codes.Cells, "candidates", lambda self, cells: np.arange(len(self.book))[None, :] == np.zeros((len(cells), 1)))
    assert {c for c, *_ in coded(spark.createDataFrame(rows, SCHEMA)).values()} == {"00" * 8}


def test_cells_keep_the_nearest_entry():
    rng = np.random.default_rng(5)
    for _ in range(60):
        k, width, span = int(rng.integers(1, 20)), int(rng.integers(1, 9)), int(rng.choice([2, 50, 10**6]))
        cells = vector_codes.Cells(rng.integers(-span, span, (k, width)))
        cells.edge = int(rng.integers(1, span + 1))
        x = np.concatenate([rng.integers(-2 * span, 2 * span, (200, width)), cells.book])
        d = ((x[:, None] - cells.book[None]) ** 2).sum(axis=-1)
        entry, least = cells.nearest(x)
        assert (entry == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    spread = vector_codes.Cells(np.arange(16)[:, None] * 1000)
    assert spread.candidates(np.zeros((1, 1), np.int64)).sum() < 16  # far entries are dominated


def test_vector_codes_of_any_size(spark):
    """Integers beyond 64 bits are exact; an error beyond 64 bits is null."""
    rows = [(i, [3e38 if i == 0 else 1e12 * i, 0.5, -7.0, float(i)], 1) for i in range(6)]
    want, digest = brute.vector_codes(rows, parts=2, entries=2, rounds=2)
    got = coded(spark.createDataFrame(rows, SCHEMA), parts=2, entries=2, rounds=2)
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()} and {v[3] for v in got.values()} == {digest}
    assert {i: v[1] for i, v in got.items()} == {i: v[1] if v[1] < 1 << 63 else None for i, v in want.items()}
    with pytest.raises(Exception, match="too large"):
        coded(spark.createDataFrame([(1, [1e60, 0.0], 1)], SCHEMA), parts=2)


def test_vector_codes_edges(spark):
    assert coded(spark.createDataFrame([], SCHEMA)) == {}
    assert coded(spark.createDataFrame([(1, None, 1)], SCHEMA)) == {}
    other = coded(spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0], 1), (3, [], 1), (None, [2.0, 2.0], None)], SCHEMA), parts=2)
    assert other[2][:3] == other[3][:3] == (None, None, None) and other[1][0] == "0000" and other[None][0] == "0100"  # each place has the entries 1 2 and 2 2
    with pytest.raises(ValueError, match="divide"):
        coded(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA), parts=2)
    clash = spark.createDataFrame([(1, [1.0, 2.0], 1, "x", 5)], "vec_id long, embedding array<double>, label int, code string, _sum int")
    assert coded(clash, parts=2)[1][:3] == ("0000", 0, 0)


# Phrase mining


def sentences(seed: int, n: int):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "city", "es", "en", "a", "b", "q-r", "Été", "x" * 300]
    rows = [(None, "en"), ("", None), (" \t ", "de"), ("...,,", "fr"), ("new york city. " * 30, None), ("New\tYork  city\nnew york", "es")]
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice([3, 6, 12])]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "!", " "]) for _ in range(rng.randrange(1, 60)))
        rows += [(text, rng.choice(["en", "es", None, "und"]))] * rng.choice([1, 1, 3])
    return rows


def mined(spark, rows, **options):
    found = phrase_mining.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), **options).collect()
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found}


@pytest.mark.parametrize("fraction, held", [(0.05, 1 << 20), (0.0, 300), (1.0, 300)])
def test_phrases(spark, monkeypatch, fraction, held):
    """Whatever the sample, nothing or all, the counts are those of the whole."""
    monkeypatch.setattr(phrase_mining, "HELD", held)
    rows = sentences(3, 60)
    want = brute.phrases(rows)
    assert len(want) > 20 and mined(spark, rows, fraction=fraction) == want


def test_phrases_with_a_full_bit_map(spark, monkeypatch):
    """Where nearly all bits are set, more is counted, and nothing differs; four words, few results."""
    monkeypatch.setattr(phrase_mining, "MOST_BITS", 64)
    rows = sentences(4, 40)
    assert mined(spark, rows, least=4, most=4, top=9) == brute.phrases(rows, 4, 4, 9)


def test_failures_need_further_passes(spark, monkeypatch):
    """Without a sample nothing is proposed: words, pairs and triples each take a pass; with all of it one pass is enough."""
    plain, passes = phrase_mining.count_phrases, []
    monkeypatch.setattr(phrase_mining, "count_phrases", lambda docs, least, most, words, *maps: passes.append(least) or plain(docs, least, most, words, *maps))
    rows = [("new york city hall", "en")] * 12
    for fraction, count in ((0.0, 3), (1.0, 1)):
        passes.clear()
        assert mined(spark, rows, fraction=fraction) == brute.phrases(rows)
        assert passes.count(10) == count


def test_phrases_edges(spark):
    assert mined(spark, []) == {} and mined(spark, [(None, None), ("", "en"), ("one two", "en")]) == {}
    names = spark.createDataFrame([("a b " * 20, "en", 1, "x")], "text string, lang string, n int, word string")
    assert {r["phrase"] for r in phrase_mining.collocations(names).collect()} == {p for p, *_ in brute.phrases([("a b " * 20, "en")]).values()}
    one = [(" ".join(["w"] * 200_000), "en")]
    assert mined(spark, one) == brute.phrases(one)


# Token files


def token_texts():
    rng = random.Random(8)
    parts = ["don't", "we'll", " ", "  ", "\n", "\t", " ", " ", "　", "\u0085", "\x1c", "Word", "12345", "...", "end.", "a,b", "…", "”", "é", "日本語", "🙂", "<|endoftext|>", "x.,", ".", ","]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (None, None), (5, "a second row of an id"), (5, "a second row of an id"), (1002, "long words " * 30_000), (-4, "x" * 50_000)]
    return rows


def expected(rows, tokenizer):
    """Multisets of (doc_id, n_tokens, crc)."""
    out = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, len(ids), zlib.crc32(ids.tobytes())))
    return out


@pytest.mark.parametrize("block", [8192, 7])
def test_token_files(spark, monkeypatch, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_orc, "BLOCK", block)
    rows = token_texts()
    want = expected(rows, Tokenizer.from_file(TOKENIZER))
    got = [tuple(r) for r in token_orc.token_round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), TOKENIZER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(i, n, c) for i, _, n, c in got], key=key) == sorted(want, key=key)
    place = 0
    got.sort(key=lambda r: r[1])
    assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got) and [r[0] for r in got if r[0] is not None] == sorted(r[0] for r in got if r[0] is not None)
    for _, start, n, _ in got:
        assert start == place
        place += n


def test_pieces_are_encoded_as_in_their_text():
    from tokenizers import Tokenizer

    tokenizer, table = Tokenizer.from_file(TOKENIZER), token_orc.piece_table(TOKENIZER, 0)
    assert type(table).__name__ == "PieceTable"
    texts = [t or "" for _, t in token_texts()]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    for t, ids in zip(texts, table.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)):
        assert ids.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0], t[:80]
    assert type(token_orc.piece_table(public_tokenizers.path("word_bpe_49k.json"), 0)).__name__ == "TextTokenizer"


def test_token_files_are_pruned(spark, tmp_path):
    """Indexes and Bloom filters are in the files; a read of few documents, or of few places, skips the rest."""
    rows = [(i, f"text number {i} " + "word " * (i % 9)) for i in range(0, 40_000, 2)]
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_orc.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, TOKENIZER)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{path}/*.orc"))
    from pyarrow import orc

    assert len(files) > 1 and sum(orc.ORCFile(f).nrows for f in files) == len(rows)
    spark.conf.set("spark.sql.orc.filterPushdown", "true")
    some = token_orc.read_token_ids(spark, path, [4, 20_002, 39_998, 7])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString().replace("`", "")
    assert sorted(r["doc_id"] for r in some.collect()) == [4, 20_002, 39_998]
    whole = token_orc.read_token_ids(spark, path)
    table = token_orc.shard_directory(whole)
    flat = np.concatenate([np.array(r["ids"]) for r in sorted(whole.collect(), key=lambda r: (r["shard"], r["start"], r["at"]))])
    low, high = 70_001, 70_400
    found = {r["place"]: r["ids"] for r in token_orc.read_places(whole, table, low, high).collect()}
    assert min(found) <= low and max(p + len(x) for p, x in found.items()) >= high and all(flat[p : p + len(x)].tolist() == x for p, x in found.items()) and len(found) < 200


def test_token_files_edges(spark):
    assert token_orc.token_round_trip(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0
    clash = spark.createDataFrame([(1, "hello", 3, "x")], "doc_id long, text string, START int, ids string")
    assert [tuple(r) for r in token_orc.token_round_trip(clash, TOKENIZER).select("doc_id", "start", "n_tokens").collect()] == [(1, 0, 2)]


def test_crc_of_parts():
    rng = random.Random(3)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(0, 99)), rng.randbytes(rng.randrange(0, 5000))
        assert token_orc.crc_before(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_kept_table_starts_anew(monkeypatch):
    monkeypatch.setattr(token_orc, "TABLE_WORDS", 10)
    table = token_orc.kept_table(TOKENIZER, 0)
    assert token_orc.kept_table(TOKENIZER, 0) is table
    for word in "abcdefgh":
        raw = np.frombuffer(" ".join(word * k for k in range(1, 9)).encode(), np.uint8)
        table.encode(raw, np.array([0, len(raw)]))
        assert table.table.n <= 18


# Mended edges of earlier operators


def test_short_items_leak_as_lines(spark):
    from fieldkrig.llm import decontaminate

    docs = [(1, "Some text.\nWho wrote Hamlet?\nMore text."), (2, "They asked who wrote Hamlet? and left."), (3, "paris"), (4, "Paris\nis a town"), (5, "  \nPARIS!\n"), (6, None), (7, "who wrote\nHamlet")]
    items = [(10, "Who wrote Hamlet?"), (11, "Paris"), (12, ""), (13, None)]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["exact"]) for r in found}
    assert got == brute.leaks(docs, items) == {(1, 10): (1, True), (3, 11): (1, True), (5, 11): (1, True)}


def test_names_that_differ_in_case(spark):
    from fieldkrig.llm import license_scan, suffix_dedup

    rows = spark.createDataFrame([(1, "under the mit license " * 9, 5, "x", 7)], "doc_id long, text string, Score int, LABELS string, Kept int")
    assert license_scan.license_scan(rows).select("score", "labels").first()["labels"] == "mit"
    assert suffix_dedup.remove_repeats(rows, with_text=True).select("kept").count() == 1


def test_texts_too_long_for_places(monkeypatch):
    from fieldkrig.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 8)
    with pytest.raises(ValueError, match="or more"):
        suffix_dedup.phrases(np.zeros(300, np.uint8), np.array([0, 300]), 100)


def test_bare_archive_folders_lie_in_the_default_file_system(spark):
    from fieldkrig.llm import warc

    assert warc.qualified(spark, "/ckpt/x") == "file:/ckpt/x" and warc.qualified(spark, "file:///ckpt") == "file:/ckpt"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.t.link./a", "file:///tmp")
    assert warc.qualified(spark, "viewfs://t/a/b") == "viewfs://t/a/b"


def test_of_rows_that_share_an_id_one_stays(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, f"text {i} of the id with words enough", "en", "s", 9) for i in range(5)] + [(2, "another text of words", "en", "s", 9), (None, "no id", "en", "s", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    some = {tuple(corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, schema).repartition(n), "").filter("doc_id = 1").first()) for n in (1, 2, 5)}
    assert len(some) == 1


def test_quality_model_counts_all_trusted_text(spark, monkeypatch):
    """Every trusted row, also a long one and those beyond any number, counts whole."""
    import numpy as np

    from fieldkrig.llm import kn_classifier as kn

    monkeypatch.setattr(kn, "LOOSE", 1000)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcde \n"), 6)) for _ in range(3500)] + ["xyz" * 10_000, None, "", "untrusted"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(texts) - 1)] + [(0, 1, 0), (len(texts) - 1, 0, 0)], "doc_id long, quality int, toxic int")
    want: dict = {}
    for t in texts[:-1]:
        b = bytes([kn.PAD] * 4) + (t or "").encode()
        for i in range(4, len(b)):
            g = int.from_bytes(b[i - 4 : i + 1], "big")
            want[g] = want.get(g, 0) + 1
    seen = {}
    monkeypatch.setattr(kn, "Model", lambda keys, counts: seen.update(zip(keys.tolist(), counts.tolist())))
    kn.train(docs, labels)
    assert seen == want
