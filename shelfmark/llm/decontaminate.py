"""Benchmark passages in documents: a prefix-filtered join of shingles, then exact windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.text import bit_filter, in_filter, run_hashes, slices, small_batches, word_hashes
from shelfmark.operators import stage

WINDOW = 10  # words of an item that make a hit; a shorter item is one window
SHINGLE = 5
LOG_BITS = 23  # the filter of prefix shingles: 1 MB, whatever the size of the benchmark

# A-Z become a-z; digits, a-z and all bytes from 0x80 on are kept; the rest parts words
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def spaced(text: str | None) -> bytes:
    """The text with A-Z lower-cased and all but letters, digits and characters beyond ASCII blank."""
    return text.encode("utf-8").translate(_TABLE) if text else b""


def tokens(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all other characters beyond ASCII; A-Z lower-cased."""
    return spaced(text).split()


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: words, n, items (their ids), and their shingles with places.

    Read by one task per batch of items; an item makes at most as many windows
    as it has words.
    """

    def cut(batches):
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                found = tokens(text)
                if not found:
                    continue
                size = min(window, len(found))
                k = min(SHINGLE, size)
                hashes = run_hashes(word_hashes([spaced(text)])[0], k).view(np.int64)
                for at in range(len(found) - size + 1):
                    text_ = b" ".join(found[at : at + size]).decode("utf-8")
                    rows.append((item, text_, size, k, hashes[at : at + size - k + 1].tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "words", "n", "k", "shingles"])

    ids = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    cuts = ids.mapInPandas(cut, "item_id string, words string, n int, k int, shingles array<long>")
    return cuts.groupBy("words", "n", "k").agg(
        F.first("shingles").alias("shingles"), F.collect_set("item_id").alias("items")
    )


def prefix_tokens(windows: DataFrame) -> DataFrame:
    """The prefix of each window: its rarest shingle, with its place.

    A document that contains a window contains every shingle of it, so of the
    shingles in order of rarity a prefix of one is enough. Rarity is counted
    over the windows; equal counts are ordered by hash.
    """
    each = windows.select("words", "n", "k", "items", F.posexplode("shingles").alias("place", "h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("times")).withColumnRenamed("h", "h_")
    ranked = each.join(counts, F.col("h") == F.col("h_")).groupBy("words", "n", "k", "items").agg(
        F.min(F.struct("times", "h", "place")).alias("rarest")
    )
    return ranked.select("words", "n", "k", "items", "rarest.h", "rarest.place")


def text_hash() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_hash")


def scan(docs: DataFrame, bits: np.ndarray, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, and the places whose shingle may be a prefix.

    A place comes with the words around it, so that windows are compared without
    another look at the text.
    """

    def run(batches):
        kind = pa.list_(
            pa.struct([("h", pa.int64()), ("k", pa.int32()), ("at", pa.int32()), ("begin", pa.int32()), ("around", pa.string())])
        )
        for batch in slices(batches):
            texts = [spaced(text) for text in batch.column("text").to_pylist()]
            sizes_of, rows = [], []
            for text, hashes in zip(texts, word_hashes(texts), strict=True):
                hits, found = [], None
                for k in sizes:
                    h = run_hashes(hashes, k)
                    for at in np.flatnonzero(in_filter(h, bits)).tolist():
                        found = text.split() if found is None else found
                        begin = max(0, at - (window - k))
                        around = b" ".join(found[begin : at + window]).decode("utf-8")
                        number = int(h[at : at + 1].view(np.int64)[0])
                        hits.append({"h": number, "k": k, "at": at, "begin": begin, "around": around})
                sizes_of.append(len(hashes))
                rows.append(hits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes_of, pa.int64()), pa.array(rows, kind)],
                ["doc_id", "text_hash", "n_words", "hits"],
            )

    schema = (
        "doc_id long, text_hash string, n_words long, "
        "hits array<struct<h: long, k: int, at: int, begin: int, around: string>>"
    )
    return docs.select("doc_id", "text", text_hash()).mapInArrow(run, schema)


def _covered(spans: Column) -> Column:
    """Words inside any of the spans (start, stop), given sorted by start."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("total"),
            F.greatest(acc["upto"], s["stop"]).alias("upto"),
        ),
        lambda acc: acc["total"],
    )
    return F.coalesce(step, F.lit(0)).cast("long")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and text_hash per document.

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window, one without words or text none. A document's words inside any
    occurrence of a window are hit. Places whose shingle passes the filter meet
    the prefix shingles in an exact join; the window must begin and end inside
    the document (position and length bound) and equal its words there.

    NULL and empty texts have no words. Repeated rows, and rows with NULL
    doc_id, have a result each. An item with a NULL item_id hits like any other
    but has no id to count or list, so n_items may be 0 beside hits. Repeated
    items count once. With no items nothing is hit; no documents give no rows. Equal windows of
    many items are one window, and all their ids are found. Other columns of
    both tables are not read.
    """
    small_batches(docs.sparkSession)
    windows = stage(item_windows(items, window), "windows")
    prefixes = stage(prefix_tokens(windows), "prefixes")
    sizes = sorted(r[0] for r in prefixes.select("k").distinct().collect())  # 1 to 5
    scanned = scan(docs, bit_filter(prefixes, LOG_BITS), sizes, window)
    scanned = stage(scanned.withColumn("row_", F.monotonically_increasing_id()), "scanned")

    places = scanned.where(F.size("hits") > 0).select("row_", "n_words", F.explode("hits").alias("hit"))
    places = places.select("row_", "n_words", "hit.*")
    start = F.col("at") - F.col("place")
    met = places.join(prefixes, ["h", "k"]).withColumn("start", start)
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    there = F.slice(F.split("around", " "), F.col("start") - F.col("begin") + 1, F.col("n"))
    met = met.where(F.array_join(there, " ") == F.col("words"))
    met = stage(met.select("row_", "start", (F.col("start") + F.col("n")).alias("stop"), "items"), "met")
    spans = met.groupBy("row_").agg(
        _covered(F.sort_array(F.collect_set(F.struct("start", "stop")))).alias("n_hit")
    )
    ids = F.array_sort(F.collect_set("item"))
    found = met.select("row_", F.explode("items").alias("item")).groupBy("row_").agg(ids.alias("ids"))
    out = scanned.drop("hits").join(spans, "row_", "left").join(found, "row_", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "text_hash",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, with their columns."""
    bad = contamination(docs, items, window).where("contaminated").select(
        F.col("doc_id").alias("doc_"), F.col("text_hash").alias("text_")
    )
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    digest = F.md5(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary"))
    clean = named.withColumn("digest", digest).join(
        bad, F.col("doc.doc_id").eqNullSafe(F.col("doc_")) & (F.col("digest") == F.col("text_")), "left_anti"
    )
    return clean.select("doc.*")
