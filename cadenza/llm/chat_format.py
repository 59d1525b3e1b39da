"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of parts: text, image, audio or document. A visitor renders each part in order:
text as itself, the others as a placeholder such as <|image:0|>, numbered through the conversation,
and records for each placeholder what it stands for and how many tokens it expands to. A turn is

    <|im_start|>role\\n content <|im_end|>\\n        (without the blanks)

Control strings inside texts and roles are escaped reversibly: "<", any number of backslashes and
"|" get one backslash more, so "<|" stands in the output only where the template put it. A role also
has its backslashes doubled and its line ends written as backslash and n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels of a patch's side, tokens of a second of audio and of a document's page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 1024


def escape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<\\")), F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")).otherwise(text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # pairs of backslashes are held apart as line ends, which no escaped role has
    parts = F.split(F.replace(unescape(role), F.lit("\\\\"), F.lit("\n")), "\n")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def text_part(text: Column) -> Column:
    """A turn of one text part."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *none))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; 0 where its extent isn't known, and for text."""
    def patches(side: str) -> Column:
        return F.ceil(F.coalesce(part[side], F.lit(0)) / PATCH)

    return (
        F.when(part["type"] == "image", patches("width") * patches("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * PER_PAGE)
        .otherwise(F.lit(0)).cast("long")
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def render(turns: DataFrame) -> DataFrame:
    """Add to turns (conv_id, turn, role, parts) the columns seq, content, rendered, start and attachments.

    start is the place (from 0, in code points) of the content within the conversation's output.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    media = F.size(F.filter("parts", lambda p: ~_is_text(p)))
    out = turns.withColumn("seq", F.row_number().over(order)).withColumn("base", F.coalesce(F.sum(media).over(before), F.lit(0)))

    def number(i: Column) -> Column:
        return F.col("base") + F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i), lambda p: ~_is_text(p)))

    def visit(p: Column, i: Column) -> Column:
        return F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape_role(p["type"]), F.lit(":"), number(i).cast("string"), F.lit("|>")))

    def attach(p: Column, i: Column) -> Column:
        return F.when(~_is_text(p), F.struct(number(i).cast("long").alias("number"), F.col("seq").alias("seq"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))

    plain = (F.size("parts") == 1) & _is_text(F.col("parts")[0])  # the visitor's result for the usual turn
    out = out.withColumn("content", F.when(plain, escape(F.coalesce(F.col("parts")[0]["text"], F.lit("")))).otherwise(F.array_join(F.transform("parts", visit), "")))
    out = out.withColumn("attachments", F.filter(F.transform("parts", attach), lambda a: a.isNotNull()))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    out = out.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, F.col("content"), F.lit(END)))
    return out.withColumn("start", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)) + F.col("head")).drop("base", "head")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conv_id of turns (conv_id, turn, role, parts, ...; parts as PART, or text, ...).

    Columns: conv_id, formatted, loss_starts and loss_lengths (the spans of assistant contents in
    formatted, in code points), attachments (number, seq, type, ref, tokens) and expanded_tokens.
    Without a column parts, text is the only part. Turns are ordered by turn, then role and content;
    null turns come first. A null role or text is empty; a null type is text. Rows of a null conv_id
    are one conversation. Repeated rows are turns each. Other columns are not read. A conversation is
    one string in the end, so its turns meet in one task.
    """
    parts = F.col("parts") if "parts" in turns.columns else text_part(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(parts, F.array()).cast(f"array<{PART}>").alias("parts"))
    turn = F.struct("seq", "rendered", (F.col("role") == "assistant").alias("loss"), "start", F.length("content").alias("length"), "attachments")
    whole = render(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    loss = F.filter("turns", lambda t: t["loss"])
    attachments = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    return whole.select(
        "conv_id", F.array_join(F.col("turns")["rendered"], "").alias("formatted"),
        F.transform(loss, lambda t: t["start"]).alias("loss_starts"), F.transform(loss, lambda t: t["length"]).alias("loss_lengths"),
        attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an output as array<struct<role, text>>, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
    ))


def read_loss(formatted: Column, starts: Column, lengths: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.zip_with(starts, lengths, lambda a, n: unescape(F.substr(formatted, (a + 1).cast("int"), n))), "")
