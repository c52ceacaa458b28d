"""Chat formatting: collapse cumulative snapshots, then render the maximal conversations.

A logged conversation that is a prefix of a longer one (same roles and texts,
turn by turn) is a snapshot of it; of equal conversations the smallest id
stays.  Each turn gets its position in the conversation and the rolling hash of
the turns up to it; a conversation goes when its (length, last hash) occurs as
an inner prefix of another one.  Hashes are rolled with windows: turns are cut
into blocks of ``BLOCK`` positions, so a window never spans more than a block
of one conversation, and block totals are rolled in a second, far thinner
window.  The rows that move carry ids and hashes, never texts; rendering groups
the texts of the kept conversations only.

Defined results: turns are ordered by (turn, md5 of role and text), nulls first; a null
role renders as ``user`` and a null text as empty, and count as such when
compared; rows without a conversation id are left out; repeated rows are turns
of their own; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

BLOCK = 1024


def _turns(conversations: DataFrame) -> DataFrame:
    role = F.coalesce(F.col("role"), F.lit("user"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), text.alias("text"))


def prefix_hashes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, hi, lo): 128-bit rolling hash of the first ``pos`` turns (pos from 1)."""
    # two independent 64-bit halves of an md5 of the turn stand for its role and text
    md5 = F.md5(F.concat(F.col("role"), F.lit("\u0001"), F.col("text")))
    thin = _turns(conversations).select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("_x"), md5.alias("_m"),
        # a null turn comes before every other, as it does when a conversation is rendered
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).alias("_b"))
    # position = rows of earlier blocks + row number inside the block
    per_block = thin.groupBy("conv_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("conv_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per_block = per_block.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    in_block = W.partitionBy("conv_id", "_b").orderBy("turn", "_m", "_x")
    pos = (thin.withColumn("_r", F.row_number().over(in_block)).join(per_block.drop("_n"), ["conv_id", "_b"])
           .withColumn("pos", F.col("_off") + F.col("_r")))
    # the position is mixed into each turn's hash, so the xor of a prefix depends on the order
    pos = pos.withColumn("_hi", F.xxhash64("pos", "_m", "_x")).withColumn("_lo", F.xxhash64("_x", "pos", "_m"))
    roll = W.partitionBy("conv_id", "_b").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    pos = pos.withColumn("_hi", F.bit_xor("_hi").over(roll)).withColumn("_lo", F.bit_xor("_lo").over(roll))
    ends = pos.groupBy("conv_id", "_b").agg(F.max_by("_hi", "pos").alias("_eh"), F.max_by("_lo", "pos").alias("_el"))
    carry = ends.select("conv_id", "_b", F.coalesce(F.bit_xor("_eh").over(before), F.lit(0)).alias("_ch"),
                        F.coalesce(F.bit_xor("_el").over(before), F.lit(0)).alias("_cl"))
    return pos.join(carry, ["conv_id", "_b"]).select(
        "conv_id", "pos", F.col("_hi").bitwiseXOR(F.col("_ch")).alias("hi"),
        F.col("_lo").bitwiseXOR(F.col("_cl")).alias("lo"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer or equal one stands for."""
    pre = stored(prefix_hashes(conversations), "prefixes")
    ends = pre.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    last = (pre.join(ends, "conv_id").where("pos = n_turns")
            .groupBy("n_turns", "hi", "lo").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    inner = (pre.join(ends, "conv_id").where("pos < n_turns")
             .select(F.col("pos").alias("n_turns"), "hi", "lo").distinct())
    return last.join(inner, ["n_turns", "hi", "lo"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, rendered): ``<|role|>\\ntext<|end|>\\n`` for each turn in order, one training text per conversation."""
    turn = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    return _turns(conversations).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "turn", F.md5(F.concat("role", F.lit("\u0001"), "text")).alias("m"), turn.alias("t")))),
            lambda x: x["t"]), "").alias("rendered"))


def chat_format(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    keep = stored(maximal_conversations(conversations), "maximal")
    kept = conversations.join(keep.select("conv_id"), "conv_id", "left_semi")
    return keep.join(render(kept), "conv_id")
