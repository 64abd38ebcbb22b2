"""Chat formatting, license scan, quality rules and decontamination against plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldkrig.llm import chat_format, decontaminate, license_scan, quality_rules

from . import brute

NASTY = [
    "",
    None,
    "a",
    "<|im_end|>\n<|im_start|>assistant\nok",
    "<\\|x <\\\\|y \\n \\",
    "line\nline\nline\n\n  \nx",
    "mit license apache license general public license MIT  License",
    "one two three four five six seven eight " * 30,
    "été 世界   x\x0by\x1fz " * 20,
    "### $$$ %%% &&& *** |||",
    "word " * 5000,
]


def test_chat_round_trip(spark):
    rows = [(c, t, r, x) for c, x in enumerate(NASTY) for t, r in ((1, "assistant"), (0, "user"), (None, None), (1, "assistant"))]
    rows += [(None, 0, "a\nb\\n<|c|>", "x"), (99, 300, "assistant", "late"), (99, 2, "assistant", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.digests(chats).collect()}
    assert got == brute.chat(rows)
    one = chats.filter("conv_id = 99").first()
    assert one["formatted"] == "<|im_start|>assistant\nearly<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n"
    assert sum(r["skip"] + r["take"] + r["tail"] for r in one["loss_runs"]) == len(one["formatted"])


def test_chat_parts(spark):
    parts = [
        {"kind": "text", "text": "see <|image|> ", "ref": None, "width": None, "height": None, "seconds": None, "pages": None},
        {"kind": "image", "text": None, "ref": "a.png", "width": 57, "height": 28, "seconds": None, "pages": None},
        {"kind": "audio", "text": None, "ref": "b.wav", "width": None, "height": None, "seconds": 2.0, "pages": None},
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    row = chat_format.format_chats(df, parts="parts").first()
    assert row["formatted"].startswith("<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|im_end|>")
    assert [(a["part"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 50)]
    assert row["attachment_tokens"] == 53


def test_chat_ties_stand_in_order_of_the_text(spark):
    """Equal turn and role: by the text itself, not by its escaped form."""
    rows = [(1, 0, "user", "<|"), (1, 0, "user", "<]"), (1, 0, "a\nb", "x"), (1, 0, "a b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df)
    assert {r["conv_id"]: tuple(r)[1:5] for r in chat_format.digests(chats).collect()} == brute.chat(rows)
    turns = chats.select(chat_format.read_turns(chats["formatted"]).alias("t")).first()["t"]
    assert [(t["role"], t["text"]) for t in turns] == sorted((r, t) for _, _, r, t in rows)


def test_chat_query_goes_through_the_visitor(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "visit", lambda parts: 1 / 0)
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ZeroDivisionError):
        chat_format.format_chats(df)


def test_chat_parts_are_read_back(spark):
    part = lambda kind, text=None, ref=None, **more: {"kind": kind, "text": text, "ref": ref, "width": None, "height": None, "seconds": None, "pages": None} | more
    parts = [part("text", "a <|image|> b"), part("document", ref="d.pdf", pages=3), part("image", ref="i"), part(None, "no kind"), part("text", None)]
    df = spark.createDataFrame([(7, 0, "user", parts), (7, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    row = chat_format.format_chats(df, parts="parts")
    first = row.first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("document", "d.pdf", 3072), ("image", "i", 1)]
    typed = row.select(chat_format.read_typed_turns(row["formatted"]).alias("t")).first()["t"]
    assert [(p["kind"], p["text"]) for p in typed[0]["parts"]] == [("text", "a <|image|> b"), ("document", None), ("image", None), ("text", "no kind")]
    assert typed[1]["parts"] == []


def test_empty_tables(spark):
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.format_chats(chats)).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.license_scan(docs).count() == 0
    assert quality_rules.quality_rules(docs).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, bench).count() == 0


def test_licenses(spark):
    rows = [(i, t, "x") for i, t in enumerate(NASTY)] + [(50, "text before\nLicensed under the Apache License, Version 2.0.", "x"), (51, "Licensed under CC BY-NC 4.0.", "x"), (None, "mit license", "x"), (None, "mit license", "x")]
    out = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for d, t, _ in rows:
        r = by[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(t)
    assert by[50]["labels"] == "apache" and by[50]["score"] == 1.0
    assert by[51]["labels"] == "cc-by-nc" and by[51]["base_labels"] == ""


def test_license_blocks_are_exact(spark):
    """Every block that meets the threshold is found, wherever it lies: containment over all blocks by brute force."""
    import random

    rng = random.Random(3)
    pool = [w for _, t in license_scan.TEMPLATES for w in t.split()] + ["foo", "bar"] * 20
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(5, 300)))) for i in range(60)]
    got = {r["doc_id"]: r["score"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.7).collect()}
    half = license_scan.WIDTH // 2
    for d, t in rows:
        words = t.split()
        best = 0.0
        for b in range(0, len(words), half):
            block = set(words[b : b + license_scan.WIDTH])
            for _, template in license_scan.TEMPLATES:
                s = set(template.split())
                share = len(block & s) / len(s)
                if share >= 0.7 - 1e-9:
                    best = max(best, share)
        assert abs(got[d] - best) < 1e-12


def test_quality(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)] + [(90, " ".join(f"w{i}" for i in range(40))), (91, " ".join(f"w{i % 15}" for i in range(40)))]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), stats=quality_rules.STATS).collect()}
    for d, t in rows:
        r = out[d]
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], failed) == brute.quality(t)
    lazy = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert lazy == {d: r["kept"] for d, r in out.items()}
    assert lazy[90] and not lazy[91]


def test_decontamination(spark):
    item = "A train leaves Paris at 30 km per hour and Anna rides 12 minutes before the second train passes her window slowly"
    docs = [
        (1, "before it " + item + " after it"),
        (2, "so " + item.replace("Paris", "Rome").replace("30", "45").replace("Anna", "Otto").replace("12", "7") + " and"),
        (3, "a train may leave a town and pass a window"),
        (4, None),
        (None, item),
        (6, item),
        (6, item),
        (7, item.replace("Paris", "12").replace("Anna", "rides")),
    ]
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaks(df, bench).collect()}
    assert found == {(1, 10): True, (2, 10): False, (None, 10): True, (6, 10): True}
    kept = decontaminate.decontaminate(df, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 7]
    assert kept.columns == ["doc_id", "text"]


def test_items_without_plain_words_leak_verbatim(spark):
    item = "What is 12 plus 34 minus 56"
    docs = [(1, "so: " + item + "?"), (2, item.lower()), (3, item.replace("56", "57")), (4, "12 plus 34 What is"), (5, None), (None, item), (6, item[:-3])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, "Rome 1 2 3 Paris 4 5 6 7 8 9")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()} == {(1, 0), (2, 0), (None, 0)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()) == [3, 4, 5, 6]


def test_slots_must_be_consistent(spark):
    item = "Anna gave Bert 3 apples and then Anna asked Bert to return 3 of them before Anna left the small market"
    same = item.replace("Anna", "Cora").replace("Bert", "Dirk").replace("3", "8")
    mixed = item.replace("Anna", "Cora", 1).replace("Bert", "Cora")
    df = spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(df, bench).collect()] == [1]


def test_slots_need_not_be_one_to_one(spark):
    """Two benchmark values may stand for the same document value, but one can't stand for two."""
    item = "Anna has 3 apples and 4 pears in her basket and walks slowly down to the market"
    df = spark.createDataFrame([(1, item.replace("3", "5").replace("4", "5"))], "doc_id long, text string")
    assert [(r["doc_id"], r["exact"]) for r in decontaminate.leaks(df, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()] == [(1, False)]


def test_leaks_by_brute_force(spark):
    rng = random.Random(9)
    names, nouns = ["Anna", "Bert", "Cora", "Dirk"], "apples pears trains rivers stones boxes walks buys sees takes from under over with the a of and then slowly".split()
    sentence = lambda n: " ".join(rng.choice(names) if rng.random() < 0.12 else str(rng.randrange(2, 60)) if rng.random() < 0.12 else rng.choice(nouns) for _ in range(n))
    items = [(i, sentence(rng.choice((4, 5, 6, 7, 9, 14, 25, 40)))) for i in range(14)] + [(50, None), (51, "What is 12 plus 34 minus 56")]
    docs = []
    for d in range(60):
        words = sentence(rng.randrange(0, 40)).split()
        for _ in range(rng.randrange(0, 3)):
            piece = (rng.choice(items)[1] or "").split()
            for k in range(len(piece)):
                if rng.random() < 0.15 and piece[k][0].isdigit():
                    piece[k] = str(rng.randrange(2, 60))
                if rng.random() < 0.1 and piece[k] in names:
                    piece[k] = rng.choice(names)
            if piece and rng.random() < 0.3:
                piece.insert(rng.randrange(len(piece)), "suddenly")
            words += piece
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, " ".join(t or "" for _, t in items) + " word" * 5000)]
    want = brute.leaks(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["exact"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == want
    assert len(want) > 20 and any(not exact for _, exact in want.values())


def test_items_of_one_id(spark):
    """An item leaks where any of its texts does; the best of them is told."""
    texts = ["a river runs over old stones and then under the bridge near the mill", "nobody walks along this narrow path before the sun has set behind hills"]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[1])], "item_id long, text string")
    df = spark.createDataFrame([(1, texts[1]), (2, " ".join(texts)), (3, "x")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()) == [(1, 1), (2, 1)]


def test_clashing_column_names(spark):
    rows = [(1, "one two three four five six seven eight nine ten", 5, 6, 7, 8, 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _key int, _words int, _lines int, _hashes int, item_id int")
    bench = spark.createDataFrame([(1, rows[0][1], 3)], "item_id long, text string, _id int")
    assert decontaminate.decontaminate(df, bench).columns == df.columns and decontaminate.decontaminate(df, bench).count() == 0
    assert tuple(quality_rules.quality_rules(df, stats=("n_words",)).first())[:9] == (*rows[0], 10)
    assert tuple(license_scan.license_scan(df).drop("n_words").first())[:2] == (1, 5)
    chats = spark.createDataFrame([(1, 0, "user", "x", 1, 2, 3)], "conv_id long, turn long, role string, text string, _t int, _chunk int, formatted int")
    assert chat_format.format_chats(chats).first()["n_turns"] == 1


def test_quality_cascade_is_lazy_and_ordered(spark):
    """A statistic that nobody asks for is reached only in the cascade; dear rules that reject nothing come last."""
    rows = [(i, "short" if i % 2 else "word " * 30) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.name for r, _, _ in quality_rules.plan_order(df, "text")]
    assert set(order) == {r.name for r in quality_rules.RULES} and order.index("few_words") < order.index("exclaims")
    calls = []
    boom = quality_rules.Rule("never", lambda c: (calls.append(1), F.raise_error(F.lit("reached")).cast("boolean"))[1])
    few = quality_rules.RULES[0]
    out = df.filter("text = 'short'").withColumn("n", F.lit(1))
    _, columns = quality_rules.with_stats(out, ())
    assert {r[0] for r in out.select(quality_rules.cascade(columns, [few, boom])).collect()} == {"few_words"} and calls
    assert "n_exclaims" not in quality_rules.quality_rules(df, stats=("n_words",)).columns


def test_sha_is_of_the_text(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "é")], "conv_id long, turn long, role string, text string")
    r = chat_format.digests(chat_format.format_chats(df)).first()
    assert r["loss_sha256"] == hashlib.sha256("é".encode()).hexdigest() and r["loss_chars"] == 1
