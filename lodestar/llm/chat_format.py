"""Operator 5, chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts (kind, text, ref, tokens).  A visitor flattens them in order: text parts are escaped; image, audio
and document parts become numbered placeholders and are recorded as attachments with their reference and expanded token count.

Template of a turn: ``<s>`` role `` [INST] `` content `` [/INST]</s>``.  Control strings inside roles and texts get a backslash (and the
backslashes before them are doubled), so no marker of the template can come from a text, and unescaping gives the text back exactly.  The
loss mask is a list of character spans of the formatted string, one for each assistant turn's content.

Defined cases: a null role or text is empty; turns are ordered by (turn, role, text), null turns first; repeated rows are turns of their
own; a null conversation id is a conversation of its own; an empty table gives an empty one.  A conversation is one row: its turns meet in
one task, as the output has to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: The template's control strings, as a pattern.
CONTROL = r"(</?s>|\[/?INST\]|<\|(?:image|audio|document)_[0-9]+\|>)"
#: Tokens of an attachment whose part doesn't say how many it takes.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
PARTS = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def escape(c: Column) -> Column:
    """Backslashes before a control string are doubled and one more is put in."""
    return F.regexp_replace(c, r"(\\*)" + CONTROL, r"$1$1\\$2")


def unescape(c: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(c, r"(\\*)\1\\" + CONTROL, "$1$2")


def text_part(c: Column) -> Column:
    """A single text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _default_tokens(kind: Column) -> Column:
    out = F.lit(0)
    for k, n in DEFAULT_TOKENS.items():
        out = F.when(kind == k, n).otherwise(out)
    return out.cast("bigint")


def conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, parts: Column) -> DataFrame:
    """One row a conversation: conv, turns (role, content, from, media), attachments.  ``from`` is the number of its first attachment."""
    rows = df.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), parts.cast(PARTS).alias("parts")).alias("t"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    media = lambda ps: F.filter(ps, lambda p: p["kind"] != "text")
    start = F.struct(F.array().cast("array<struct<role:string,content:string>>").alias("turns"), F.array().cast("array<struct<kind:string,ref:string,tokens:bigint>>").alias("seen"))

    def visit_part(acc: Column, p: Column) -> Column:
        n = F.size(acc["seen"])
        mark = F.concat(F.lit("<|"), p["kind"], F.lit("_"), n.cast("string"), F.lit("|>"))
        one = F.array(F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], _default_tokens(p["kind"])).alias("tokens")))
        is_text = F.coalesce(p["kind"] == "text", F.lit(True))
        return F.struct(
            F.concat(acc["content"], F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)).alias("content"),
            F.when(is_text, acc["seen"]).otherwise(F.concat(acc["seen"], one)).alias("seen"),
        )

    def visit_turn(acc: Column, t: Column) -> Column:
        inner = F.aggregate(t["parts"], F.struct(F.lit("").alias("content"), acc["seen"].alias("seen")), visit_part)
        done = F.struct(F.concat(acc["turns"], F.array(F.struct(t["role"].alias("role"), inner["content"].alias("content")))).alias("turns"), inner["seen"].alias("seen"))
        return done

    plain = F.forall("ts", lambda t: F.size(media(F.coalesce(t["parts"], F.array().cast(PARTS)))) == 0)
    simple = F.struct(F.transform("ts", lambda t: F.struct(t["role"].alias("role"), F.array_join(F.transform(t["parts"], lambda p: escape(F.coalesce(p["text"], F.lit("")))), "").alias("content"))).alias("turns"), start["seen"].alias("seen"))
    return grouped.withColumn("v", F.when(plain, simple).otherwise(F.aggregate("ts", start, visit_turn))).select("conv", F.col("v.turns").alias("turns"), F.col("v.seen").alias("attachments"))


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text") -> DataFrame:
    """(conv, formatted, loss_mask, attachments, attachment_tokens) for each conversation; the mask's spans are (start, length), from 0."""
    content = parts if parts is not None else text_part(F.col(text_col).cast("string"))
    flat = conversations(df, conv_col, turn_col, role_col, content)
    piece = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<s>"), escape(t["role"]), F.lit(" [INST] ")).alias("head"), t["content"].alias("body"), (t["role"] == "assistant").alias("loss")))
    flat = flat.withColumn("p", piece).withColumn("whole", F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(" [/INST]</s>"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def span(acc: Column, x: Column) -> Column:
        head, body = F.length(x["head"]).cast("long"), F.length(x["body"]).cast("long")
        own = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        return F.struct((acc["at"] + head + body + len(" [/INST]</s>")).alias("at"), F.when(x["loss"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    out = flat.select("conv", F.array_join("whole", "").alias("formatted"), F.aggregate("p", start, span)["spans"].alias("loss_mask"), "attachments")
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string; texts are unescaped."""
    pieces = F.slice(F.split(formatted, r" \[/INST\]</s>", -1), F.lit(1), F.size(F.split(formatted, r" \[/INST\]</s>", -1)) - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, " [INST] ")
        return F.struct(unescape(F.substring(p, F.lit(4), at - 4)).alias("role"), unescape(F.substring(p, at + len(" [INST] "), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all ``conversations`` and conversation -7, and reads the digests back from the output."""
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    table = scratch.load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(more)
    chat = format_chat(table)
    turns = read_turns(F.col("formatted"))
    said_loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = chat.select("conv", "formatted", turns.alias("turns"), F.array_join(said_loss, "").alias("loss"))
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|<\|(?:image|audio|document)_[0-9]+\|>)', '\1\1\\\2', 'g') AS body,
            regexp_replace(role, '(\\*)(</?s>|\[/?INST\]|<\|(?:image|audio|document)_[0-9]+\|>)', '\1\1\\\2', 'g') AS head FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(3 + length(head) + 8 + length(body) + 12)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
