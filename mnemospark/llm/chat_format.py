r"""Prefix-target chat formatting, with DataFrame functions only.

Every assistant turn becomes one training example: all preceding turns are context and only that
reply is trainable. A conversation whose last turn is not an assistant's also yields one closing
example without a target, so no turn is missing from the output.

Template of a turn: ``<|role|>ROLE<|text|>TEXT<|end|>``. Control strings inside roles and texts
are escaped by a backslash behind their first character (``<\|end|>``, ``<\/s>``, ``[\INST]``);
where backslashes already stand there, one is added. Unescaping takes one away, so the
mapping is one to one for all strings: no escaped text holds a control string, and the strings
that already look escaped come back as they were.

The turns of a conversation meet in one row, as an example is one string by nature; conversations
spread over the tasks by their id. The digests that read the output back group by the same id and
so need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string: ``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``.
_TAIL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_TAIL}", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_TAIL}", "$1$2")


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv_id, target (position of the trainable turn, null in a closing example),
    formatted, loss_start and loss_chars (the trainable span of ``formatted`` in code points; the span
    is the escaped reply) and closing (whether the example holds all the conversation's turns).

    Turns are ordered by turn, then role and text, nulls first, so repeated turns keep a fixed order
    and each counts. Null roles and texts are empty; the empty reply of an assistant is an example
    with an empty span. A null conversation id is a conversation like any other. Other columns are
    ignored; an empty table gives no examples.
    """
    pieces = turns.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(role, F.lit("")).alias("role"),
            F.coalesce(text, F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    head = lambda t: F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT))
    formed = whole.select(
        "conv_id",
        F.size("t").alias("n"),
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("t"),
    )
    examples = formed.withColumn(
        "at",
        F.explode(F.filter(F.sequence(F.lit(1), "n"), lambda i: (F.col("t")[i - 1]["role"] == "assistant") | (i == F.col("n")))),
    )
    last = F.col("t")[F.col("at") - 1]
    context = F.array_join(F.transform(F.slice("t", 1, F.col("at") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    parts = examples.select(
        "conv_id",
        "at",
        (F.col("at") == F.col("n")).alias("closing"),
        (last["role"] == "assistant").alias("trained"),
        F.concat(context, last["head"]).alias("before"),
        last["body"].alias("body"),
    )
    return parts.select(
        "conv_id",
        F.when(F.col("trained"), F.col("at")).alias("target"),
        F.concat("before", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("trained"), F.length("before")).alias("loss_start"),
        F.when(F.col("trained"), F.length("body")).alias("loss_chars"),
        "closing",
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text)."""
    turns = F.slice(F.split(formatted, r"<\|end\|>", -1), 1, F.size(F.split(formatted, r"<\|end\|>", -1)) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring(F.substring_index(t, TEXT, 1), len(ROLE) + 1, 2_000_000_000)).alias("role"),
            unescape(F.substring(t, F.length(F.substring_index(t, TEXT, 1)) + len(TEXT) + 1, F.lit(2_000_000_000))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: the turns and the trainable text read back."""
    loss = F.when(F.col("target").isNotNull(), unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))))
    read = examples.select(
        "conv_id",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("closing"), parse(F.col("formatted"))).alias("turns"),
        F.when(F.col("target").isNotNull(), F.struct("target", loss.alias("text"))).alias("loss"),
    ).select(
        "conv_id",
        "chars",
        "loss",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
    )
    per = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return per.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql("select -7L conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') t(turn, role)")
    return digests(expand(turns.unionByName(own)))


ORACLE_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
pieces as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
    sum(23 + length(role) + length(text)
      + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))
      + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))) over w as upto
  from turns window w as (partition by conv_id order by turn, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (where role = 'assistant' or pos = n)::bigint as formatted_chars
from pieces group by conv_id
"""
