"""Logged conversations: snapshots that only begin a longer one go, the rest is rendered.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.running import sums_before
from shelfmark.operators import stage

SALTS = 16
SEEDS = (3, 11)  # two independent 64-bit hashes


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Per turn: conv_id, at (from 1), role, text, and the rolling hashes p0, p1 of the turns up to it.

    Turns are in the order of turn, role, text; a turn that is logged again, equal
    in all of these, is one turn. A rolling hash is the sum of the
    hashes of (place, role, text), so any number of tasks can share one long
    conversation: sums over the whole sorted table, less what came before the
    conversation. NULL roles and texts differ from empty ones; rows with NULL
    conv_id are one conversation.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    rows = rows.withColumn("row_", F.monotonically_increasing_id())
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text", "row_")]
    placed = stage(sums_before(rows, order, {"rank": F.lit(1).cast("long")}), "turns")
    begins = placed.groupBy("conv_id").agg(F.min("rank").alias("begin"))
    placed = _with_conversation(placed, begins)
    placed = placed.withColumn("at", F.col("rank") - F.col("begin") + 1)
    seen = [F.isnull("role"), F.isnull("text")]
    own = {
        f"h{i}": F.xxhash64(F.lit(seed), "at", "role", "text", *seen).cast("decimal(38,0)")
        for i, seed in enumerate(SEEDS)
    }
    placed = placed.withColumns(own)
    summed = stage(
        sums_before(placed, order, {f"s{i}": F.col(f"h{i}") for i in range(len(SEEDS))}), "turns"
    )
    base = summed.where("at = 1").select("conv_id", *[F.col(f"s{i}").alias(f"b{i}") for i in range(len(SEEDS))])
    rolled = _with_conversation(summed, base)
    return rolled.select(
        "conv_id",
        F.col("at"),
        "role",
        "text",
        *[(F.col(f"s{i}") + F.col(f"h{i}") - F.col(f"b{i}")).alias(f"p{i}") for i in range(len(SEEDS))],
    )


def _with_conversation(turns: DataFrame, per_conversation: DataFrame) -> DataFrame:
    """Join one row per conversation to its turns; salts spread a long conversation."""
    salted = per_conversation.withColumnRenamed("conv_id", "conv_").withColumn(
        "salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    salt = F.pmod(F.xxhash64("role", "text"), F.lit(SALTS)).cast("int")
    if "row_" in turns.columns:
        salt = F.pmod("row_", F.lit(SALTS)).cast("int")
    joined = turns.withColumn("salt", salt).join(
        salted, F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("salt") == F.col("salt_"))
    )
    return joined.drop("salt", "salt_", "conv_")


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no proper prefix of another.

    Of equal conversations the smallest conv_id stays (NULL last). An anti-join
    of whole conversations against all shorter prefixes by length and hash.
    """
    marks = [f"p{i}" for i in range(len(SEEDS))]
    last = F.max(F.struct("at", *marks)).alias("last")
    whole = hashed.groupBy("conv_id").agg(last).select("conv_id", "last.*")
    whole = stage(whole, "conversations").withColumnsRenamed({"at": "n_turns"})
    classes = whole.groupBy("n_turns", *marks).agg(F.min("conv_id").alias("conv_id"))
    lengths = whole.select("conv_id", "n_turns")
    inner = _with_conversation(hashed, lengths).where("at < n_turns").select(
        F.col("at").alias("n_turns"), *marks
    )
    return classes.join(inner.distinct(), ["n_turns", *marks], "left_anti").select("conv_id", "n_turns")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, at, n_turns, rendered: the turns of maximal conversations as chat markup.

    One row per turn, to be joined in the order of ``at``: a conversation may be
    of any length. A NULL role is rendered as ``unknown``, a NULL text as empty.
    Repeated rows count once, so a conversation that was logged twice is still
    one snapshot. An empty table gives an empty one. Other columns are not read.
    """
    hashed = stage(prefix_hashes(turns), "prefixes")
    kept = _with_conversation(hashed, maximal(hashed))
    rendered = F.concat(
        F.lit("<|im_start|>"),
        F.coalesce("role", F.lit("unknown")),
        F.lit("\n"),
        F.coalesce("text", F.lit("")),
        F.lit("<|im_end|>\n"),
    )
    return kept.select("conv_id", "at", "n_turns", rendered.alias("rendered"))
