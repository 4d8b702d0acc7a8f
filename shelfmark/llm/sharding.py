"""Shards along a Hilbert curve through several metadata columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.running import sums_before
from shelfmark.llm.text import without
from shelfmark.operators import stage

BITS = 5  # cells per dimension: 2 ** BITS
SHARDS = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n rows, one column per dimension).

    Works down from the coarsest bit. The state of a row is the frame its
    subcube is walked in: where it is entered, and along which dimension. A
    subcube's place in the walk is the Gray-code rank of its corner, seen in
    that frame.
    """
    n, dims = cells.shape
    mask = (1 << dims) - 1
    index = np.zeros(n, dtype=np.int64)
    entry = np.zeros(n, dtype=np.int64)
    axis = np.zeros(n, dtype=np.int64)

    def turned(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return ((x >> by) | (x << (dims - by))) & mask

    for bit in range(bits - 1, -1, -1):
        corner = np.zeros(n, dtype=np.int64)
        for d in range(dims):
            corner |= ((cells[:, d] >> bit) & 1) << d
        gray = turned(corner ^ entry, (axis + 1) % dims)
        rank = gray.copy()
        for shift in range(1, dims):
            rank ^= gray >> shift
        index = (index << dims) | rank
        # entry corner of the subcube: Gray code of the even number below its rank
        even = np.where(rank > 0, (rank - 1) & ~1, 0)
        start = even ^ (even >> 1)
        entry ^= turned(start, (dims - (axis + 1) % dims) % dims)
        # direction of the walk inside: trailing ones of the odd neighbour
        probe = np.where(rank % 2 == 1, rank, np.maximum(rank - 1, 0))
        ones = np.zeros(n, dtype=np.int64)
        running = np.ones(n, dtype=bool)
        for d in range(dims):
            running = running & (((probe >> d) & 1) == 1)
            ones += running
        axis = (axis + np.where(rank > 0, ones, 0) + 1) % dims
    return index


def _curve(bits: int):
    @F.pandas_udf("long")
    def place(cells: pd.Series) -> pd.Series:
        if not len(cells):
            return pd.Series([], dtype="int64")
        return pd.Series(hilbert_index(np.array(cells.tolist(), dtype=np.int64), bits))

    return place


def cuts(rows: DataFrame, dim: str, bits: int = BITS) -> list:
    """At most 2 ** bits - 1 values of dim that part the rows into about equal shares.

    Exact: from the count of every value and the running sum of the counts. Only
    the cut values come back.
    """
    counts = rows.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    placed = stage(sums_before(counts, [F.col(dim)], {"before": F.col("n")}), "cuts")
    total = placed.agg(F.sum("n")).first()[0] or 0
    cell = F.floor(F.col("before") * (1 << bits) / F.lit(max(total, 1)))
    found = placed.groupBy(cell.alias("cell")).agg(F.min(dim).alias("v")).where("cell > 0")
    return sorted(row["v"] for row in found.collect())


def cell(dim: str, values: Sequence) -> Column:
    """How many cuts a value has reached; NULL counts as below all."""
    if not values:
        return F.lit(0)
    reached = F.filter(F.array(*[F.lit(v) for v in values]), lambda cut: cut <= F.col(dim))
    return F.coalesce(F.size(reached), F.lit(0)).cast("int")


def hilbert_shards(
    rows: DataFrame,
    dims: Sequence[str],
    order: Sequence[str],
    shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """Add ``hilbert``, ``shard`` and ``slot`` to rows.

    Each dimension is quantised into up to 2 ** bits cells of about equal row
    counts. Rows are sorted by the cell's place on the Hilbert curve, then by
    ``order``, and the sorted rows are cut into runs of equal counts (at most
    one apart). Neighbours on the curve are near in all dimensions, so a shard
    spans a narrow range of each, which minimum and maximum statistics can prune.

    NULLs lie below all values. Rows equal in ``order`` are parted by a row
    number, so no key, however frequent, has to fit one task. No rows: no rows.
    """
    rows = stage(rows.withColumn("row_", F.monotonically_increasing_id()), "shards")
    cells = F.array(*[cell(d, cuts(rows, d, bits)) for d in dims])
    placed = rows.withColumn("hilbert", _curve(bits)(cells))
    ranked = sums_before(
        placed, [F.col(c) for c in ("hilbert", *order, "row_")], {"rank_": F.lit(1).cast("long")}
    )
    total = F.lit(max(rows.count(), 1))
    # exact in whole numbers: the first rank of a shard is ceil(shard * total / shards)
    shard = ((F.col("rank_") * shards - F.pmod(F.col("rank_") * shards, total)) / total).cast("int")
    first = F.ceil(F.col("shard") * total / F.lit(shards))
    return (
        ranked.withColumn("shard", shard)
        .withColumn("slot", (F.col("rank_") - first).cast("long"))
        .drop("rank_", "row_")
    )


DIMENSIONS = ("source", "lang", "size")


def _narrow(docs: DataFrame, *kept: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        "lang",
        "source",
        *kept,
    )


def _lawful(sharded: DataFrame, *kept: str) -> DataFrame:
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
        "lang",
        "source",
        *kept,
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is ``rows``: shard counts are at most one apart. Size is the UTF-8
    bytes of the text plus 1; a NULL text counts as empty (crc32 0). Dimensions:
    language, source, size. Copies, also of whole rows, have a slot each. An
    empty table gives an empty one.
    """
    return _lawful(hilbert_shards(_narrow(docs), DIMENSIONS, ["doc_id", "text_crc32"], shards))


def shard_texts(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """As ``shard_documents``, with the text and all other columns of docs.

    Rows are written with a number each; sorting and cutting moves numbers, and
    the texts join them once, row by row. Columns of docs that are named like one
    of the result's are replaced.
    """
    rows = stage(docs.withColumn("number_", F.monotonically_increasing_id()), "numbered", compression="zstd")
    placed = hilbert_shards(_narrow(rows, "number_"), DIMENSIONS, ["doc_id", "text_crc32"], shards)
    placed = _lawful(placed, "number_")
    rest = without(rows, [c for c in placed.columns if c != "number_"])
    return placed.join(rest, "number_").drop("number_")


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder per shard; files hold runs of slots, so the ranges in them are narrow and scans can prune by them.

    A shard is cut into as many files as its rows need, so no task holds a whole one.
    """
    in_order = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    in_order.write.partitionBy("shard").parquet(path)
