r"""Chat formatting in DataFrame functions: typed content parts, a reversible template and a loss mask.

Turns are rows (conv_id, turn, role, parts). A visitor flattens each turn's parts in order: text is
escaped and kept, every image, audio or document part becomes a placeholder, its reference and the
number of tokens it expands to go to ``attachments``. A conversation is ``<s>`` and its turns:

    [INST] user text [/INST]    [ANS] assistant text</s>    [ROLE name] other text [/ROLE]

A control string inside a text gets a backslash after its bracket (one more if it has some), so that
it can neither open nor close a turn, and taking one away restores the text exactly.

Defined results: null text or null parts count as empty text, null role as the role '', null turns
come first; equal turn numbers are ordered by role, then text; repeated rows are repeated turns; a
null conv_id is a conversation of its own; an empty table gives no conversations. A part of unknown
type is kept as text. One conversation is one output row, so it has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: After an opening bracket and backslashes, the rest of each control string.
TAILS = r"/?s>|/?INST\]|ANS\]|ROLE |/ROLE\]|IMG\]|AUD\]|DOC\]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]"}
MARK = "\x01"
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[ANS\] .*?</s>|\[ROLE [^\]]*\] .*? \[/ROLE\]"
PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({TAILS})", "$1$2$3")


def text_part(text: Column) -> Column:
    """A turn's plain text as its only content part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("bigint").alias("pages"),
        )
    ).cast(f"array<{PART}>")


def _is_attachment(p: Column) -> Column:
    return F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False))


def flatten(parts: Column) -> Column:
    """The parts as one escaped text with ordered placeholders.

    Neighbouring texts are one text before they are escaped, so that no control string comes about where parts
    meet. MARK stands for a placeholder while that is done, and for itself with a ``t`` behind it.
    """

    def visit(p):
        out = F.when(p["type"] == "image", MARK + "i").when(p["type"] == "audio", MARK + "a").when(p["type"] == "document", MARK + "d")
        return out.otherwise(F.replace(F.coalesce(p["text"], F.lit("")), F.lit(MARK), F.lit(MARK + "t")))

    text = escape(F.coalesce(F.array_join(F.transform(parts, visit), ""), F.lit("")))
    for kind, placeholder in PLACEHOLDERS.items():
        text = F.replace(text, F.lit(MARK + kind[0]), F.lit(placeholder))
    return F.replace(text, F.lit(MARK + "t"), F.lit(MARK))


def attachments(parts: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """(kind, ref, tokens) of each attachment part in order; missing sizes count as the smallest."""

    def tokens(p):
        tiles = F.ceil(F.greatest(F.coalesce(p["width"], F.lit(1)), F.lit(1)) / patch) * F.ceil(F.greatest(F.coalesce(p["height"], F.lit(1)), F.lit(1)) / patch)
        heard = F.greatest(F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * audio_rate), F.lit(1))
        pages = F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * page_tokens
        return F.when(p["type"] == "image", tiles).when(p["type"] == "audio", heard).otherwise(pages).cast("long")

    got = F.transform(F.filter(parts, _is_attachment), lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return F.coalesce(got, F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>"))


def format_conversations(turns: DataFrame, patch: int = 14, audio_rate: float = 12.5, page_tokens: int = 1024) -> DataFrame:
    """One row per conversation: formatted, loss_spans (byte start and length of each assistant text in it), attachments, expanded_tokens."""
    role = F.coalesce("role", F.lit(""))
    other = F.concat(F.lit("[ROLE "), F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D")), F.lit("] "))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), flatten(F.col("parts")).alias("body"),
        attachments(F.col("parts"), patch, audio_rate, page_tokens).alias("att"),
        F.when(role == "user", "[INST] ").when(role == "assistant", "[ANS] ").otherwise(other).alias("open"),
        F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").otherwise(" [/ROLE]").alias("close"),
    )
    size = F.octet_length("open") + F.octet_length("body") + F.octet_length("close")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", unescape(F.col("body")), "att")
    before = F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("place"), F.concat("open", "body", "close").alias("segment"), "att", (F.col("role") == "assistant").alias("learnt"),
            (3 + before + F.octet_length("open")).cast("int").alias("start"), F.octet_length("body").alias("length"),
        ).alias("t"),
    )
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    got = got.select(
        "conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("t", lambda t: t["segment"]), "")).alias("formatted"),
        F.flatten(F.transform("t", lambda t: t["att"])).alias("attachments"),
        F.transform(F.filter("t", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )
    total = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return got.select("conv_id", "formatted", "loss_spans", "attachments", total.alias("expanded_tokens"))


def read_back(formatted: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """conv_id, the columns in ``keep``, turns (role and unescaped text, parsed from ``formatted`` alone) and loss_text (what the spans cover, unescaped)."""
    named = r"(?s)^\[ROLE ([^\]]*)\] (.*) \[/ROLE\]$"

    def parse(m):
        size = F.char_length(m)
        role = F.when(m.startswith("[INST] "), "user").when(m.startswith("[ANS] "), "assistant")
        text = F.when(m.startswith("[INST] "), F.substr(m, F.lit(8), size - 15)).when(m.startswith("[ANS] "), F.substr(m, F.lit(7), size - 10))
        other = F.replace(F.replace(F.regexp_extract(m, named, 1), F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))
        return F.struct(role.otherwise(other).alias("role"), unescape(text.otherwise(F.regexp_extract(m, named, 2))).alias("text"))

    raw = F.col("formatted").cast("binary")
    covered = F.transform("loss_spans", lambda s: unescape(F.substr(raw, s["start"] + 1, s["length"]).cast("string")))
    return formatted.select(
        "conv_id", *(keep or []),
        F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)), parse).alias("turns"),
        F.array_join(covered, "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
