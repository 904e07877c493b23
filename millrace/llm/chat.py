"""Chat formatting: collapse logged conversation snapshots to the maximal ones, then render them.

Loggers often store a conversation again after each exchange, so a log holds many prefixes of one conversation. Each
turn gets the rolling hash of all turns up to it (the running xor of position-bound turn hashes, two of 64 bits). A
conversation whose last hash is a hash within a longer one is a prefix of that and goes; of equal conversations the one
with the smallest conv_id stays. Only DataFrame functions are used; prefix hashes are aggregated before the anti-join,
so a first turn that a third of all conversations share is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import id_back, id_key, materialise

#: A rendered turn: %1$s is the role, %2$s the text.
TURN = "<|%1$s|>\n%2$s<|end|>\n"


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("at"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("role").isNull(), F.col("text").isNull())


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(key, at, h1, h2): for each turn of (key, turn, role, text) its place from 1 and the hash of all turns up to it.

    Turns are ordered by turn, role and text, a null turn first.
    """
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = turns.select("key", "turn", "role", "text", F.row_number().over(order).alias("at"))
    hashed = numbered.select("key", "at", _turn_hash(1).alias("t1"), _turn_hash(2).alias("t2"))
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("key", "at", F.bit_xor("t1").over(upto).alias("h1"), F.bit_xor("t2").over(upto).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(key, n_turns, copies): the conversations that are no proper prefix of another, one of equal ones."""
    hashes = materialise(prefix_hashes(turns), "chat-prefixes")
    last = hashes.groupBy("key").agg(F.max_by(F.struct("at", "h1", "h2"), "at").alias("e")).select("key", "e.*")
    ends = materialise(last.groupBy("at", "h1", "h2").agg(F.min("key").alias("key"), F.count("*").alias("copies")), "chat-ends")
    inner = hashes.join(ends.select("key", F.col("at").alias("n")), "key").where("at < n").select("at", "h1", "h2").distinct()
    return ends.join(inner, ["at", "h1", "h2"], "left_anti").select("key", F.col("at").cast("long").alias("n_turns"), "copies")


def format_conversations(df: DataFrame, turn_format: str = TURN) -> DataFrame:
    """(conv_id, n_turns, copies, text): maximal conversations of (conv_id, turn, role, text), rendered.

    copies: equal conversations that it stands for, itself included. A null conv_id is a conversation of its own and
    stays null; a null role or text differs from an empty one when conversations are compared and renders as empty;
    turns with equal numbers are ordered by role and text, and repeated turn rows are turns each; an empty table gives
    no rows; other columns are not read.
    """
    turns = df.select(id_key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = materialise(maximal(turns), "chat-kept")
    rows = turns.join(kept.select("key"), "key").select("key", F.struct(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
    line = lambda t: F.format_string(turn_format, F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit("")))
    rendered = rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), line), "").alias("text"))
    return kept.join(rendered, "key").select(id_back(F.col("key")).alias("conv_id"), "n_turns", "copies", "text")
