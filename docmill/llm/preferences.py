"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id long, turns array<struct<turn, role, text>>): turns in order of (turn, role, text); null roles and texts are empty. Rows without conv_id take no part."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("t")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def pair_by_first_turn(convs: DataFrame, levels: int = 4) -> DataFrame:
    """(chosen_id, rejected_id): conversations with equal first turns, two and two; the smaller conv_id counts as chosen.

    Pairs form between neighbours in order of conv_id, first inside blocks of 256 ids; what is
    left over, at most one of each block, is paired inside blocks of 256 such blocks, and so on,
    the last level without blocks. So no window holds more than 256 rows however common a first
    turn is (with 2^32 ids; the last one may then be larger). At most one conversation of each
    first turn stays without a partner: rejected_id is null.
    """
    left = convs.select("conv_id", F.xxhash64(F.element_at("turns", 1)["role"], F.element_at("turns", 1)["text"]).alias("h"))
    out = None
    for level in range(1, levels + 1):
        block = F.expr(f"conv_id div {BLOCK**level}") if level < levels else F.lit(0).cast("long")
        own = Window.partitionBy("h", "block").orderBy("conv_id")
        placed = left.withColumn("block", block).withColumn("n", F.row_number().over(own)).withColumn("next", F.lead("conv_id").over(own))
        pairs = placed.where("n % 2 = 1 and next is not null").select(F.col("conv_id").alias("chosen_id"), F.col("next").alias("rejected_id"))
        out = pairs if out is None else out.unionByName(pairs)
        left = placed.where("n % 2 = 1 and next is null").select("conv_id", "h")
    return out.unionByName(left.select(F.col("conv_id").alias("chosen_id"), F.lit(None).cast("long").alias("rejected_id")))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans of a rendered completion on which the loss falls: text and end mark of the assistant's turns."""
    head = lambda t: F.char_length(t["role"]) + 5
    body = lambda t: F.char_length(t["text"]) + 7

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head(t)
        span = F.array(F.struct(begin.cast("long").alias("start"), (begin + body(t)).cast("long").alias("end")))
        return F.struct((begin + body(t) + 1).cast("int").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return F.aggregate(turns, empty, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Formats pairs of conversations for preference training.

    turns: conv_id, turn, role, text and any further columns, which are not read. pairs:
    chosen_id and rejected_id; without them conversations are paired by their first turn. The
    longest common prefix of turns, equal in role and text, is rendered once as the prompt; what
    follows is rendered as a completion of each side.

    Returns chosen_id, rejected_id, n_common long (turns in the prompt), prompt, chosen,
    rejected string, chosen_mask, rejected_mask array<struct<start, end>>: spans of the
    completion, in code points, that the assistant wrote, end mark included. The prompt is
    never part of the loss.

    Edge cases: conversations that are equal have empty completions; without a partner
    (rejected_id null or unknown) the prompt is empty, the whole conversation is the chosen
    completion and the rejected one is null; a pair whose chosen_id is unknown has no row; an
    empty table gives an empty result.

    Scale: turns are shuffled once into conversations and these twice to their pairs, on ids
    that are unique; common first turns meet only as hashes.
    """
    convs = conversations(turns)
    pairs = pair_by_first_turn(convs) if pairs is None else pairs.select(F.col("chosen_id").cast("long"), F.col("rejected_id").cast("long"))
    left = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    right = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    # Pairs without a partner would all meet on one null key; a second key, which no partner has but 0, spreads them.
    apart = F.when(F.col("rejected_id").isNull(), F.col("chosen_id")).otherwise(F.lit(0).cast("long"))
    right = right.withColumn("_apart", F.pmod(F.col("rejected_id"), F.lit(1).cast("long")))
    both = pairs.join(left, "chosen_id").withColumn("_apart", apart).join(right, ["rejected_id", "_apart"], "left")
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    n = F.when(F.col("b").isNull(), 0).when(first == 0, F.size("a")).otherwise(first - 1).cast("int")
    rest = lambda turns: F.filter(turns, lambda t, i: i >= F.col("n_common"))
    cut = both.withColumn("n_common", n).select("chosen_id", "rejected_id", "n_common", F.filter("a", lambda t, i: i < F.col("n_common")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return cut.select(
        "chosen_id",
        "rejected_id",
        F.col("n_common").cast("long").alias("n_common"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("a")).alias("chosen"),
        _render(F.col("b")).alias("rejected"),
        _mask(F.col("a")).alias("chosen_mask"),
        _mask(F.col("b")).alias("rejected_mask"),
    )
