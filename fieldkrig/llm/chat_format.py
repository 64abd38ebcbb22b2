"""Chat formatting: conversations to one training string, its loss mask and its attachments.

Native: only DataFrame operations.  A turn holds typed content parts; a visitor
flattens them in order: text parts to escaped text, image, audio and document
parts to placeholders ``<|kind|>``, each noted with its reference and the tokens it
expands to.  A plain text column is one text part, and goes through the same visitor.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  Inside texts and
roles every ``<`` + n backslashes + ``|`` gets one backslash more, so no control string
survives; reading takes one off again.  In roles, backslash and newline are written
as two characters, since a newline ends the role.

The loss mask is run-length coded: for each turn ``skip`` characters outside the loss,
``take`` inside, ``tail`` outside again; the runs add up to the formatted string.

Turns are ordered by turn number (null first), then role, then text (or parts), as they are
before escapes; rows that repeat stay repeated.  Null role, text, parts or part: empty.  Rows without a conversation id
form one conversation with a null id.  An empty table gives an empty table; other
columns are ignored.

A conversation may hold a third of all rows: turns are first joined to pieces of
``CHUNK`` turn numbers, and only the pieces meet in a conversation's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
CHUNK = 256
KINDS = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape_role(role: Column) -> Column:
    """The inverse of escape_role: a pair of characters at a time, from the left."""
    pairs = F.regexp_extract_all(unescape(role), F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(pairs, lambda p: F.when(p == "\\\\", "\\").when(p == "\\n", "\n").otherwise(p)), "")


def part_tokens(part: Column, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 1024) -> Column:
    """What a placeholder expands to: image patches, audio frames, tokens by page; at least 1."""
    zero = F.lit(0)
    size = (
        F.when(part["kind"] == "image", F.ceil(F.coalesce(part["width"], zero) / patch) * F.ceil(F.coalesce(part["height"], zero) / patch))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate))
        .otherwise(F.coalesce(part["pages"], zero).cast("long") * page_tokens)
    )
    return F.greatest(size.cast("long"), F.lit(1).cast("long"))


def visit(parts: Column) -> tuple[Column, Column]:
    """(flat text, attachments) of array<PART>; a kind not in KINDS counts as text."""
    other = lambda p: F.coalesce(p["kind"].isin(*KINDS), F.lit(False))
    flat = F.array_join(F.transform(parts, lambda p: F.when(other(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    attached = F.transform(
        F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: other(x["p"])),
        lambda x: F.struct(x["i"].alias("part"), x["p"]["kind"].alias("kind"), x["p"]["ref"].alias("ref"), part_tokens(x["p"]).alias("tokens")),
    )
    return flat, attached


def text_part(text: Column) -> Column:
    """A text as array<PART>."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


ATTACHMENT = "array<struct<turn:bigint,part:int,kind:string,ref:string,tokens:bigint>>"


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_roles=("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_runs, attachments, attachment_tokens.  parts: a column of array<PART> that stands for the text."""
    content = F.coalesce(F.col(text), F.lit("")) if parts is None else F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    rows = df.select(
        F.col(conv_id).alias("conv_id"),
        F.floor(F.col(turn) / CHUNK).cast("long").alias("_chunk"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("content")).alias("_t"),
    )
    chunks = rows.groupBy("conv_id", "_chunk").agg(F.sort_array(F.collect_list("_t")).alias("_t"))

    def visited(t: Column) -> Column:
        flat, attached = visit(text_part(t["content"]) if parts is None else t["content"])
        head = F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
        attached = F.transform(attached, lambda a: F.struct(t["turn"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
        return F.struct(head.alias("head"), flat.alias("flat"), t["role"].isin(*loss_roles).alias("loss"), attached.alias("att"))

    chunks = chunks.select("conv_id", "_chunk", F.transform("_t", visited).alias("_t"))
    n_head, n_flat = (lambda t: F.length(t["head"]).cast("long")), (lambda t: F.length(t["flat"]).cast("long"))
    zero = F.lit(0).cast("long")
    chunks = chunks.select(
        "conv_id",
        F.struct(
            "_chunk",
            F.array_join(F.transform("_t", lambda t: F.concat(t["head"], t["flat"], F.lit(END))), "").alias("formatted"),
            F.transform(
                "_t",
                lambda t: F.struct(
                    F.when(t["loss"], n_head(t)).otherwise(n_head(t) + n_flat(t)).alias("skip"),
                    F.when(t["loss"], n_flat(t)).otherwise(zero).alias("take"),
                    F.lit(len(END)).cast("long").alias("tail"),
                ),
            ).alias("runs"),
            F.flatten(F.transform("_t", lambda t: t["att"])).cast(ATTACHMENT).alias("att"),
        ).alias("_c"),
    )
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("_c")).alias("_c"))
    return whole.select(
        "conv_id",
        F.aggregate("_c", zero, lambda n, c: n + F.size(c["runs"])).alias("n_turns"),
        F.array_join(F.transform("_c", lambda c: c["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("_c", lambda c: c["runs"])).alias("loss_runs"),
        F.flatten(F.transform("_c", lambda c: c["att"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", zero, lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string of text parts."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    cut = lambda b: F.locate("\n", b)
    return F.transform(
        blocks,
        lambda b: F.struct(
            unescape_role(F.substring(b, F.lit(len(START) + 1), cut(b) - len(START) - 1)).alias("role"),
            unescape(F.substring(b, cut(b) + 1, F.length(b))).alias("text"),
        ),
    )


def read_parts(body: Column) -> Column:
    """array<struct<kind, text>> of a turn's text as it stands in the formatted string: placeholders have their kind and no text."""
    ends = "|".join(KINDS)
    pieces = F.filter(F.split(body, rf"(?=<\|)|(?<=<\|(?:{ends})\|>)"), lambda p: p != "")
    kind = lambda p: F.when(p.rlike(rf"^<\|(?:{ends})\|>$"), F.substring(p, F.lit(3), F.length(p) - 4)).otherwise("text")
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("kind"), F.when(kind(p) == "text", unescape(p)).alias("text")))


def read_typed_turns(formatted: Column) -> Column:
    """array<struct<role, parts>>: like read_turns, with placeholders told apart from texts that only look like them."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    cut = lambda b: F.locate("\n", b)
    role = lambda b: unescape_role(F.substring(b, F.lit(len(START) + 1), cut(b) - len(START) - 1))
    return F.transform(blocks, lambda b: F.struct(role(b).alias("role"), read_parts(F.substring(b, cut(b) + 1, F.length(b))).alias("parts")))


def read_loss(formatted: Column, runs: Column) -> Column:
    """The text under the loss mask, unescaped.  Runs are applied turn by turn, so the cost is linear in the length."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    return F.array_join(
        F.zip_with(F.slice(blocks, 1, F.size(runs)), runs, lambda b, r: F.when(r["take"] > 0, unescape(F.substring(b, (r["skip"] + 1).cast("int"), r["take"].cast("int")))).otherwise("")), ""
    )


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, read back from them."""
    read = chats.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("_turns"),
        read_loss(F.col("formatted"), F.col("loss_runs")).alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("_turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
