"""Formatting conversations for chat training, in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role merge into a block.  A block is

    <|turn|>ROLE<|text|>TEXT<|more|>TEXT<|end|>

and a line break.  Inside roles and texts a backslash is put between ``<`` and ``|``, after
any that are there, so that no text can hold a control string, and taking one
backslash away gives the text back.  The loss mask is a list of spans of code points: the
assistant's texts, without anything between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"
_BLOCKS = "array<struct<role:string,texts:array<string>>>"
_SPANS = "array<struct<start:int,length:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _split(text: Column, control: str) -> Column:
    return F.split(text, control.replace("|", r"\|"), -1)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """For every conversation: (conv_id, formatted, loss_spans).

    Turns go by turn, then role, then text; null roles and texts count as empty;
    repeated rows are turns of their own; rows with a null id are one
    conversation; a table without rows gives none; other columns are ignored.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chats = turns.select(F.col(id_col).alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))

    def merge(blocks, t):
        last = F.element_at(blocks, -1)
        longer = F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))))
        return F.when((F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"]), longer).otherwise(F.concat(blocks, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))))

    blocks = chats.select("conv_id", F.aggregate("turns", F.array().cast(_BLOCKS), merge).alias("blocks"))

    def piece(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(block):
        own = block["role"] == learn
        texts = F.transform(block["texts"], lambda t, i: F.when(i == 0, F.array(piece(escape(t), own))).otherwise(F.array(piece(F.lit(MORE), F.lit(False)), piece(escape(t), own))))
        head = F.concat(F.lit(TURN), escape(block["role"]), F.lit(TEXT))
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(texts), F.array(piece(F.lit(END), F.lit(False))))

    parts = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("parts"))

    def add(state, p):
        span = F.struct(state["at"].alias("start"), F.length(p["text"]).alias("length"))
        return F.struct((state["at"] + F.length(p["text"])).alias("at"), F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), F.aggregate("parts", start, add)["spans"].alias("loss_spans"))


def read_chats(chats: DataFrame, *more: str) -> DataFrame:
    """What format_chats wrote, read back: (conv_id, turns array of (role, text), loss_text), and more columns as they are.

    Null roles and texts come back as empty; a null id stays null; repeated rows
    are read each; a conversation without learnt turns has an empty loss_text;
    a table without rows gives none; other columns are left out unless named.
    """

    def turns(block):
        halves = _split(block, TEXT)
        role = unescape(F.replace(F.element_at(halves, 1), F.lit(TURN), F.lit("")))
        return F.transform(_split(F.element_at(halves, 2), MORE), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.filter(_split(F.col("formatted"), END), lambda b: b != "")
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return chats.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(loss, "").alias("loss_text"), *more)


ORACLE = r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as escaped, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') as escaped_role,
    role is distinct from lag(role) over (partition by conv_id order by turn, role, text) as starts from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    coalesce(cast(sum(length(text)) filter (where role = 'assistant') as bigint), 0) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(escaped) + case when starts then 24 + length(escaped_role) else 8 end) as bigint) as formatted_chars
from marked group by conv_id
"""
