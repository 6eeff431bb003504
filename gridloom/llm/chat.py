"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply under the loss
mask. Turns after the last assistant turn (and conversations without one) close with a context-only example whose mask
is empty, so that nothing of a conversation is lost.

Template: ``<|turn|>role\\ntext<|end|>`` for each turn. Control strings inside roles and texts are escaped reversibly: a
backslash becomes ``\\s``, and the first character of a control string ``\\l`` (for ``<``) or ``\\b`` (for ``[``); a line
break in a role becomes ``\\e``. So a backslash is always followed by one of these letters and no control string is left.

The text of the examples grows with the square of a conversation's turns; that is the method. Conversations are grouped
by id, each a row of its own; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, END = "<|turn|>", "<|end|>"
#: Strings that steer a model and must not stand in a text as they are.
CONTROL_LT = r"<(?=/?s>|\|[a-z_]+\||/?<?/?SYS>>)"
CONTROL_BR = r"\[(?=/?INST\])"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    return F.regexp_replace(F.regexp_replace(c, CONTROL_LT, r"\\l"), CONTROL_BR, r"\\b")


def unescape(c: Column) -> Column:
    for mark, char in (("\\l", "<"), ("\\b", "["), ("\\e", "\n"), ("\\s", "\\")):
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


def expand(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), text, loss_start, loss_end (code points; equal: nothing is trainable).

    Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own; null roles and texts are
    empty; rows without a conv_id form one conversation. Other columns are ignored, whatever their names.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    segment = F.concat(
        F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit("\\e")), F.lit("\n"), escape(text), F.lit(END)
    )
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.col("role"),
            F.col("text"),
            segment.alias("segment"),
            F.length(escape(text)).alias("n"),
            (role == "assistant").alias("answer"),
        ).alias("x"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,stop:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x["segment"])
        end = stop - len(END)
        one = F.array(F.struct((end - x["n"]).alias("start"), end.alias("end"), stop.alias("stop")))
        return F.struct(
            stop.alias("at"), F.when(x["answer"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out")
        )

    def close(acc: Column) -> Column:
        done = F.coalesce(F.try_element_at(acc["out"], F.lit(-1))["stop"], F.lit(0))
        return F.when(
            done < acc["at"],
            F.concat(
                acc["out"], F.array(F.struct(acc["at"].alias("start"), acc["at"].alias("end"), acc["at"].alias("stop")))
            ),
        ).otherwise(acc["out"])

    whole = whole.select(
        "conv_id",
        F.array_join(F.transform("xs", lambda x: x["segment"]), "").alias("all"),
        F.aggregate("xs", zero, step, close).alias("cuts"),
    )
    cut = whole.select("conv_id", "all", F.posexplode("cuts").alias("example", "c"))
    return cut.select(
        "conv_id",
        "example",
        F.substring("all", F.lit(1), F.col("c.stop")).alias("text"),
        F.col("c.start").alias("loss_start"),
        F.col("c.end").alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of an example."""
    parts = F.slice(F.split(text, r"<\|turn\|>", -1), 2, 2_000_000_000)
    body = lambda p: F.substring(p, F.lit(1), F.length(p) - len(END))
    first = lambda p: F.substring_index(body(p), "\n", 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(first(p)).alias("role"),
            unescape(F.substring(body(p), F.length(first(p)) + 2, F.length(p))).alias("text"),
        ),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string"
    )
    examples = expand(given.unionByName(more)).withColumn(
        "loss", unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    )
    per = examples.groupBy("conv_id").agg(
        F.max(F.struct("example", "text"))["text"].alias("last"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    said = F.array_join(
        F.transform(read_turns(F.col("last")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return per.select(
        "conv_id",
        F.size(read_turns(F.col("last"))).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
