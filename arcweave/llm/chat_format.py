"""Chat formatting with typed content parts.

A turn is a role and an ordered list of parts of type text, image, audio or
document. A visitor (one SQL expression per part type) flattens the parts: text
is escaped, any other part becomes a placeholder ``<type:turn.index>`` in its
place and is recorded as an attachment with its reference and the number of
tokens that it expands to.

The template of a turn is ``### role: content</turn>\\n``. Inside texts and roles
the characters that control strings are made of are escaped: ``\\`` as ``\\b``,
``#`` as ``\\h``, ``<`` as ``\\l`` (and ``:`` as ``\\c`` in roles). Every backslash
of an escaped text starts an escape, so the mapping is reversible, and a raw
``#`` or ``<`` can only come from the template.

Turns are dealt by conversation once; running lengths give each assistant
content its place in the output, which is the loss mask.

Defined cases: null text, role or part is empty; rows with one turn number are
ordered by role, then content; a null conversation id is a conversation of its
own; repeated rows are turns of their own; texts of any length are escaped by
expressions in one pass, and reading back is linear in the turns; other columns,
whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
END = "</turn>\n"
#: Tokens that a placeholder stands for: image patches of 28 x 28 pixels, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 25, 512
ATTACHED = ("image", "audio", "document")


def escape(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(t, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    t = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(t, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def part_tokens(p: Column) -> Column:
    """Expanded tokens of a part that is not text; unknown extents count as one unit."""
    grid = F.ceil(F.coalesce(p["width"], F.lit(1)) / F.lit(PATCH)) * F.ceil(F.coalesce(p["height"], F.lit(1)) / F.lit(PATCH))
    return (
        F.when(p["type"] == "image", grid)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(1.0)) * FRAMES))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(1)) * PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(p: Column, turn: Column, index: Column) -> Column:
    """The flat form of one part."""
    mark = F.concat(F.lit("<"), p["type"], F.lit(":"), turn.cast("string"), F.lit("."), index.cast("string"), F.lit(">"))
    return F.when(p["type"].isin(*ATTACHED), mark).otherwise(escape(F.coalesce(p["text"], F.lit(""))))


def text_part(text: Column) -> Column:
    """A parts column of one text part."""
    null = lambda t: F.lit(None).cast(t)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss, attachments, placeholder_tokens), one row per conversation.

    A loss span has its start and length in the whole output, and the turn and the place in that turn where it starts.
    """
    none = F.expr(f"cast(array() as {PARTS})")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(parts_col).cast(PARTS), none).alias("parts"))
    order = Window.partitionBy("conv").orderBy("turn", "role", F.to_json("parts"))
    rows = rows.withColumn("n", F.row_number().over(order) - 1)
    head = F.concat(F.lit("### "), escape_role(F.col("role")), F.lit(": "))
    rows = rows.withColumn("head", head).withColumn("body", F.array_join(F.transform("parts", lambda p, i: visit(p, F.col("n"), i)), ""))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head"))
    found = F.transform(
        F.filter(F.transform("parts", lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"]["type"].isin(*ATTACHED)),
        lambda x: F.struct(F.col("n").cast("int").alias("turn"), x["i"].alias("index"), x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), part_tokens(x["p"]).alias("tokens")),
    )
    span = F.when(F.col("role") == loss_role, F.struct(F.col("at").alias("start"), F.char_length("body").cast("long").alias("length"), F.col("n").cast("int").alias("turn"), F.char_length("head").alias("offset")))
    one = F.struct("n", "piece", span.alias("loss"), found.alias("found"))
    grouped = rows.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["found"]))
    return grouped.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["loss"]), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(F.transform(attachments, lambda a: a["tokens"]), F.lit(0).cast("long"), lambda s, x: s + x).alias("placeholder_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation; placeholders stay as written."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        role = F.substring_index(F.substring(p, F.lit(5), F.char_length(p)), ": ", 1)
        body = F.substring(p, F.char_length(role) + 7, F.char_length(p))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, in order, joined without a gap; the output is cut into turns once, as a cut far inside a string walks to its place."""
    cut = lambda turns: F.transform(loss, lambda s: unescape(F.substring(F.get(turns, s["turn"]), s["offset"] + 1, s["length"].cast("int"))))
    return F.array_join(F.element_at(F.transform(F.array(F.split(formatted, END)), cut), 1), "")


def digest_chat(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digest of what is read back from the formatted output."""
    t = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("text", read_loss(F.col("formatted"), F.col("loss")))
    flat = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return t.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.char_length("text").cast("long").alias("loss_chars"),
        F.sha2("text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "placeholder_tokens",
    )
