"""Preference formatting: common prompt once, chosen and rejected completions with their loss masks.

The chosen and the rejected conversation of a pair are compared turn by turn; the longest common
prefix (same role and text) is rendered once as the prompt.  What follows on each side is rendered
as that side's completion, and its mask lists the character spans that carry loss: the text and end
mark of assistant turns.  User and system turns of a completion are rendered without loss.

Everything is SQL functions.  A pair is one row of the result, so its turns meet in one row; pairs
do not meet each other, whatever openings they share.

Defined results: turns count by number, then role and text (null numbers first); a null role or text
is empty; repeated turns stay.  A side without turns, or all common, has an empty completion and no
spans.  Rows with a null pair id form one pair.  An empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """(start, end) of the trained runs in the rendered turns, by characters from 0."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn["role"]))
        end = start + F.length(turn["text"]) + len(END)
        spans = F.when(turn["role"] == TRAINED, F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, add)["spans"]


def pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans) from two tables of turns."""

    def side(df: DataFrame, name: bool) -> DataFrame:
        blank = F.lit("")
        return df.select(
            F.col(pair).alias("pair_id"),
            F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text")).alias("t"),
            F.lit(name).alias("is_chosen"),
        )

    both = side(chosen, True).unionByName(side(rejected, False))
    lists = both.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_chosen"), F.col("t")))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), F.col("t")))).alias("r")
    )
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    # The first difference ends the prefix; sides of different length differ where the shorter ends.
    lists = lists.withColumn("differs", F.array_position(same, F.lit(False))).withColumn(
        "n", F.when(F.col("differs") > 0, F.col("differs") - 1).otherwise(F.size("c")).cast("int")
    )

    def rest(side_turns: str) -> Column:
        return F.slice(F.col(side_turns), F.col("n") + 1, F.greatest(F.size(side_turns) - F.col("n"), F.lit(0)))

    return lists.withColumn("cc", rest("c")).withColumn("rr", rest("r")).select(
        "pair_id", F.col("n").alias("prompt_turns"), _render(F.slice(F.col("c"), F.lit(1), F.col("n"))).alias("prompt"),
        _render(F.col("cc")).alias("chosen"), _spans(F.col("cc")).alias("chosen_spans"), _render(F.col("rr")).alias("rejected"), _spans(F.col("rr")).alias("rejected_spans"),
    )


def stale_answers(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rejected versions of conversations: the last assistant turn answers with the one before it.

    A conversation with one assistant turn loses that turn; one without any stays as it is.
    """
    c = turns.select(F.col(conversation).alias("pair_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    answer = F.when(F.col("role") == TRAINED, F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))
    # Two largest per conversation: the last answer, and the last of those before it.
    last = c.groupBy("pair_id").agg(F.max(answer).alias("last"))
    joined = c.join(last.withColumnRenamed("pair_id", "p"), F.col("pair_id").eqNullSafe(F.col("p"))).drop("p")
    before = joined.filter((F.col("role") == TRAINED) & (F.struct("turn", F.coalesce("text", F.lit("")).alias("text")) < F.col("last"))).groupBy("pair_id").agg(
        F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("before")
    )
    known = joined.join(before.withColumnRenamed("pair_id", "p"), F.col("pair_id").eqNullSafe(F.col("p")), "left").drop("p")
    is_last = F.coalesce((F.col("role") == TRAINED) & (F.struct("turn", F.coalesce("text", F.lit("")).alias("text")) == F.col("last")), F.lit(False))
    return known.filter(~(is_last & F.col("before").isNull())).select("pair_id", "turn", "role", F.when(is_last, F.col("before")["text"]).otherwise(F.col("text")).alias("text"))
