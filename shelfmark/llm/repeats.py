"""Byte strings that repeat across documents, removed from all but the first.

Sampled suffixes, named by sorting, and induction of the rest from them, level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.text import bit_filter, drop_tables, eights, filter_bits, in_filter, mixed, release, slices, small_batches
from shelfmark.operators import stage

LENGTH = 50  # bytes of a repeated string
GRAM = 20  # bytes of the suffix prefix that samples are chosen by
REACH = LENGTH - GRAM + 1  # a string of LENGTH bytes has this many grams, one sample at least
HEAVY = 10_000  # contents of one key from which on its windows go through a shuffle of their own
RECORD = np.dtype(
    [("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("place", "<i8"), ("near", "u1"), ("far", "u1"), ("around", "u1", 80)]
)
LOG_BITS = 26  # filters of 8 MB, whatever is in them
SHARED_BITS = 27  # and of 16 MB
RUN = 2_000_000  # grams that a task sorts at once
RECORDS = 100_000  # and records
CHUNK = 1 << 16  # bytes that a task lays end to end: arrays that stay in the processor's cache
PIECE = 1 << 20  # longer texts are cut, with overlaps
PLACE_BITS = 22  # enough for a place in a chunk, of one piece at least
SALTS = 16
ALWAYS = 0x5EED5EED5EED  # mark of rows that the filter of first copies passes
NONE = np.uint64(2**64 - 1)
_MUL = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _gram_hash(words: np.ndarray, at: np.ndarray | slice, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes from each place."""
    steps = [*range(0, length - 8, 8), length - 8]
    if isinstance(at, slice):
        found = [words[at.start + s : at.stop + s] for s in steps]
    else:
        found = [words[at + s] for s in steps]
    h = np.full(len(found[0]), (length * 2 + 1) * (seed * 2 + 0x51ED27), dtype=np.uint64)
    for i, word in enumerate(found):
        h = mixed(h ^ (word * _MUL[i % 3]))
    return h


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of ``width`` values, in log(width) steps."""
    size = 1
    while size * 2 <= width:
        values = op(values[:-size], values[size:])
        size *= 2
    return op(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Chunk:
    """Texts, or overlapping pieces of long ones, laid end to end, with their sampled suffixes.

    Each window of LENGTH bytes samples the suffix among its REACH grams that
    hashes lowest, the first of equals. That depends on the window's bytes
    alone, so equal windows sample at the same distance. Windows that share a
    sample are neighbours: ``first`` to ``last`` of the sample at ``at``.
    """

    def __init__(self, pieces: Sequence[tuple[int, int, int, bytes]]):
        # (document, tag, offset of the piece in its text, bytes)
        self.doc = np.array([p[0] for p in pieces], dtype=np.int64)
        self.tag = np.array([p[1] for p in pieces], dtype=np.int64)
        self.offset = np.array([p[2] for p in pieces], dtype=np.int64)
        sizes = np.array([len(p[3]) for p in pieces])
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        data = np.frombuffer(b"".join(p[3] for p in pieces) + bytes(2 * LENGTH), dtype=np.uint8)
        self.eights, self.data = eights(data), np.append(np.zeros(REACH - 1, dtype=np.uint8), data)
        total = int(ends[-1])
        grams = _gram_hash(self.eights, slice(0, total), GRAM)
        low_bits = np.uint64((1 << PLACE_BITS) - 1)
        placed = (grams & ~low_bits) | np.arange(total, dtype=np.uint64)
        lowest = _sliding(np.append(placed, np.full(REACH - 1, NONE)), REACH, np.minimum)
        sampled = (lowest & low_bits).astype(np.int64)
        # windows that end inside their piece
        windows = np.flatnonzero(np.repeat(ends, sizes) - np.arange(total) >= LENGTH)
        sampled = sampled[windows]
        begins = np.flatnonzero(np.append(True, sampled[1:] != sampled[:-1])[: len(sampled)])
        stops = np.append(begins[1:], len(sampled)) if len(begins) else begins
        self.at, self.first, self.last = sampled[begins], windows[begins], windows[stops - 1]
        self.piece = np.searchsorted(ends, self.at, side="right")
        self.key = mixed(grams[self.at] * _MUL[2])  # sampled hashes are low ones; keys are spread evenly

    def content(self) -> np.ndarray:
        """Hash of all bytes of each sample's windows, and of where they are about it."""
        whole = _gram_hash(self.eights, self.first, LENGTH, 1) * _MUL[0]
        whole = mixed(whole ^ _gram_hash(self.eights, self.last, LENGTH, 2))
        shape = ((self.at - self.first) * 64 + (self.last - self.first)).astype(np.uint64)
        return mixed(whole ^ (shape * _MUL[1]))

    def places(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Places in the texts."""
        return at - self.starts[self.piece[of]] + self.offset[self.piece[of]]

    def marks(self) -> np.ndarray:
        return _mark(self.key, self.content(), self.doc[self.piece])

    def only(self, some: np.ndarray) -> None:
        """Forget all other samples."""
        self.at, self.first, self.last = self.at[some], self.first[some], self.last[some]
        self.piece, self.key = self.piece[some], self.key[some]

    def records(self) -> np.ndarray:
        """Each sample with the bytes that its windows may take."""
        out = np.zeros(len(self.at), dtype=RECORD)
        out["key"], out["doc"] = self.key, self.doc[self.piece]
        out["tag"], out["place"] = self.tag[self.piece], self.places(self.at, np.arange(len(self.at)))
        out["near"], out["far"] = self.at - self.last, self.at - self.first
        out["around"] = self.data[self.at[:, None] + np.arange(REACH - 1 + LENGTH)[None, :]]
        return out

def _mark(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Filter hash of one document's unit. Spark builds the filters, with the same steps."""
    return mixed(key ^ (content * _MUL[0]) ^ (doc.astype(np.int64).view(np.uint64) * _MUL[1]))


def _pieces(batch: pa.RecordBatch, firsts: np.ndarray) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """The batch's first copies in lists of about CHUNK bytes."""
    hashes = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
    batch = batch.filter(pa.array(in_filter(hashes, firsts)))
    out, size = [], 0
    for doc, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
        data = text.encode("utf-8")
        for begin in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
            out.append((doc, tag, begin, data[begin : begin + PIECE + LENGTH - 1]))
            size += len(out[-1][3])
            if size >= CHUNK:
                yield out
                out, size = [], 0
    if out:
        yield out


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def _log_buckets(spark: SparkSession) -> int:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(max(9, (16 * partitions - 1).bit_length()), SHARED_BITS - 6)


def _packed(rows: np.ndarray, keys: np.ndarray, log_buckets: int) -> pa.RecordBatch:
    """Rows that are sorted by key, as one value of bytes per bucket of the keys' order."""
    edges = np.arange(1, 1 << log_buckets, dtype=np.uint64) << np.uint64(64 - log_buckets)
    ends = np.append(np.searchsorted(keys, edges), len(keys))
    offsets = pa.py_buffer((np.append(0, ends) * rows.dtype.itemsize).astype(np.int32).tobytes())
    blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(rows.tobytes())])
    some = np.flatnonzero(np.diff(np.append(0, ends)))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), blobs.take(pa.array(some))], ["bucket", "packed"])


def shared_samples(texts: DataFrame, firsts: np.ndarray) -> np.ndarray:
    """A filter of the grams of sampled suffixes that several documents have.

    A task sorts its grams, each once per document, marks those it has seen
    twice in the lowest bit, and sends them as one row per bucket of the order.
    A bucket is sorted once more and gives its stretch of the filter. Buckets
    follow the shuffle partitions; a frequent gram comes once per task's run.
    """
    log_buckets = _log_buckets(texts.sparkSession)
    one = np.uint64(1)

    def packed(keys: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(keys) & ~one, return_counts=True)
        return _packed(found | (times > 1).astype(np.uint64), found, log_buckets)

    def send(batches):
        keys, size = [], 0
        for batch in slices(batches):
            for pieces in _pieces(batch, firsts):
                chunk = Chunk(pieces)
                own = mixed(chunk.key ^ (chunk.doc[chunk.piece].view(np.uint64) * _MUL[0]))
                keys.append(chunk.key[np.unique(own, return_index=True)[1]])
                size += len(keys[-1])
                if size >= RUN:
                    yield packed(keys)
                    keys, size = [], 0
        if keys:
            yield packed(keys)

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = np.sort(np.frombuffer(b"".join(table.column("packed").to_pylist()), dtype=np.uint64))
        plain = keys & ~one
        shared = np.append(plain[1:][plain[1:] == plain[:-1]], plain[(keys & one) == 1])
        bits = np.zeros(1 << (SHARED_BITS - log_buckets), dtype=bool)
        for place in filter_bits(shared, SHARED_BITS):
            bits[place.astype(np.int64) - bucket * len(bits)] = True
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    stretches = (
        texts.mapInArrow(send, "bucket int, packed binary").groupBy("bucket").applyInArrow(meet, "bucket int, bits binary")
    ).toArrow()
    out = np.zeros((1 << log_buckets, (1 << (SHARED_BITS - log_buckets)) // 8), dtype=np.uint8)
    for bucket, bits in zip(stretches.column("bucket").to_pylist(), stretches.column("bits").to_pylist(), strict=True):
        out[bucket] = np.frombuffer(bits, dtype=np.uint8)
    return out.reshape(-1).view(np.uint64)


def units(texts: DataFrame, firsts: np.ndarray, shared: np.ndarray) -> DataFrame:
    """key, content, doc, tag, place: the samples whose key several documents may have, with their windows.

    Place packs the first window and the number of windows.
    """

    def run(batches):
        for batch in slices(batches):
            for pieces in _pieces(batch, firsts):
                chunk = Chunk(pieces)
                chunk.only(in_filter(chunk.key, shared))
                first = chunk.places(chunk.first, np.arange(len(chunk.at)))
                place = (first << 5) | (chunk.last - chunk.first)
                yield pa.RecordBatch.from_arrays(
                    _longs(chunk.key, chunk.content(), chunk.doc[chunk.piece], chunk.tag[chunk.piece], place),
                    ["key", "content", "doc", "tag", "place"],
                )

    return texts.mapInArrow(run, "key long, content long, doc long, tag long, place long")


def _repeating(records: np.ndarray) -> np.ndarray:
    """Per record and distance to the sample, whether a smaller document has the window. Compares bytes."""
    out = np.zeros((len(records), REACH), dtype=bool)
    padded = np.zeros((len(records), 56), dtype=np.uint8)
    for distance in range(REACH):
        mine = np.flatnonzero((records["near"] <= distance) & (distance <= records["far"]))
        if len(mine) < 2:
            continue
        window = padded[: len(mine)]
        window[:, :LENGTH] = records["around"][mine, REACH - 1 - distance :][:, :LENGTH]
        words = window.view("<u8")
        h = words[:, 0] * _MUL[1]
        for i in range(1, words.shape[1]):
            h = mixed(h ^ words[:, i] * _MUL[i % 3])
        doc = records["doc"][mine]
        order = np.lexsort((doc, h))
        words, doc = words[order], doc[order]
        starts = np.append(True, (words[1:] != words[:-1]).any(axis=1))
        first = doc[starts][np.cumsum(starts) - 1]
        out[mine[order], distance] = doc > first
    return out


def open_spans(texts: DataFrame, firsts: np.ndarray, shared: np.ndarray, open_: np.ndarray) -> DataFrame:
    """Spans within the open samples: windows that a smaller document has.

    Samples that pass the filter go, with the bytes about them, to the bucket of
    their key, where windows are sorted distance by distance.
    """
    log_buckets = _log_buckets(texts.sparkSession)

    def packed(records: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(records)
        rows = rows[np.argsort(rows["key"], kind="stable")]
        return _packed(rows, rows["key"], log_buckets)

    def send(batches):
        records, size = [], 0
        for batch in slices(batches):
            for pieces in _pieces(batch, firsts):
                chunk = Chunk(pieces)
                chunk.only(in_filter(chunk.key, shared))
                chunk.only(in_filter(chunk.marks(), open_))
                records.append(chunk.records())
                size += len(records[-1])
                if size >= RECORDS:
                    yield packed(records)
                    records, size = [], 0
        if records:
            yield packed(records)

    def meet(table: pa.Table) -> pa.Table:
        records = np.frombuffer(b"".join(table.column("packed").to_pylist()), dtype=RECORD)
        found = _repeating(records)
        edge = np.zeros((len(records), 1), dtype=np.int8)
        steps = np.diff(np.hstack([edge, found.view(np.int8), edge]), axis=1)
        row, near = np.nonzero(steps == 1)
        far = np.nonzero(steps == -1)[1] - 1
        begin = records["place"][row] - far
        return pa.table(
            _longs(records["doc"][row], records["tag"][row], begin, far - near + LENGTH),
            names=["doc", "tag", "begin", "length"],
        )

    sent = texts.mapInArrow(send, "bucket int, packed binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc long, tag long, begin long, length long")


def heavy_spans(texts: DataFrame, firsts: np.ndarray, shared: np.ndarray, open_: np.ndarray) -> DataFrame:
    """The same for samples of keys with very many contents, as rows: one per window, and a join."""

    def run(batches):
        for batch in slices(batches):
            for pieces in _pieces(batch, firsts):
                chunk = Chunk(pieces)
                chunk.only(in_filter(chunk.key, shared))
                chunk.only(in_filter(chunk.marks(), open_))
                times = chunk.last - chunk.first + 1
                of = np.repeat(np.arange(len(times)), times)
                window = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + chunk.first[of]
                one, two = (_gram_hash(chunk.eights, window, LENGTH, seed) for seed in (1, 2))
                columns = (one, two, chunk.doc[chunk.piece[of]], chunk.tag[chunk.piece[of]], chunk.places(window, of))
                yield pa.RecordBatch.from_arrays(_longs(*columns), ["one", "two", "doc", "tag", "begin"])

    windows = stage(texts.mapInArrow(run, "one long, two long, doc long, tag long, begin long"), "windows")
    least = windows.groupBy("one", "two").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    spans = windows.join(least, ["one", "two"]).where("doc > lo")
    return spans.select("doc", "tag", "begin", F.lit(LENGTH).cast("long").alias("length"))


def _first_marks(rows: DataFrame) -> DataFrame:
    """h: ``_mark`` of (key, content, lo)."""

    def run(batches):
        for batch in batches:
            key, content, lo = (
                batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for c in ("key", "content", "lo")
            )
            yield pa.RecordBatch.from_arrays(_longs(_mark(key, content, lo.view(np.int64))), ["h"])

    return rows.select("key", "content", "lo").mapInArrow(run, "h long")


def resolve(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is decided, and what has to be looked at window by window.

    Decided: samples whose content a smaller document has (all their windows
    repeat). Open: per content its first document, where one key has several
    contents, which may share some windows; with the number of contents. A key
    with a single content shares no window with anything else.
    """
    named = found.groupBy("key", "content").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    named = stage(named, "named")
    copied = named.where("lo < hi").select("key", "content", "lo")
    spans = found.join(copied, ["key", "content"]).where("doc > lo").select(
        "doc",
        "tag",
        F.shiftright("place", 5).alias("begin"),
        F.expr("(place & 31) + 50").alias("length"),
    )
    ragged = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("contents"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    ragged = ragged.where("contents > 1 AND lo < hi").select("key", "contents")
    spans = stage(spans, "spans")
    return spans, stage(named.join(ragged, "key").select("key", "content", "lo", "contents"), "open")


def _once(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row of each text whose mark is in ``repeated``.

    Rows that a filter of the marks lets through are grouped; a task keeps one
    text of each before anything is sent, so a row on a third of the table costs
    one text a task.
    """
    bits = bit_filter(repeated.select(F.col("mark").alias("h")), LOG_BITS)

    def run(batches):
        for batch in batches:
            hashes = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(in_filter(hashes, bits)))

    may = texts.mapInArrow(run, texts.schema)
    groups = may.groupBy("doc_id", "tag", "mark").agg(F.first("text").alias("text"))
    return groups.join(repeated.select("mark"), "mark", "left_semi").select(*texts.columns)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, tag, begin, length of byte spans whose windows occur in a document with a smaller doc_id.

    One set of spans per doc_id and text (``tag`` tells texts of one doc_id
    apart, by 64 bits), however many rows repeat it. Rows without a doc_id, and
    texts that are NULL or under 50 bytes, have no spans and give none to others.
    Spans of one text may overlap. Texts are cut into pieces with overlaps, so
    their length is not bounded. An empty table has none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where("doc_id IS NOT NULL AND octet_length(text) >= 50").select(
        "doc_id", "text", text_tag(F.col("text")).alias("tag"), F.xxhash64("doc_id", "text").alias("mark")
    )
    digest = F.md5(F.col("text").cast("binary")).alias("digest")
    whole = stage(
        texts.select("doc_id", "tag", "mark", digest, F.octet_length("text").alias("n"))
        .groupBy("doc_id", "tag", "mark", "digest", "n")
        .agg(F.count(F.lit(1)).alias("times")),
        "texts",
    )
    first = F.min_by(F.struct("mark", "times"), "doc_id")
    classes = whole.groupBy("digest", "n").agg(
        first.alias("first"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")
    )
    classes = stage(classes.select("digest", "n", "first.*", "lo", "hi"), "classes")
    repeated = classes.where("times > 1")
    marks = classes.where("times = 1").select(F.col("mark").alias("h"))
    if not repeated.isEmpty():
        one = stage(_once(texts, repeated), "once")
        always = F.lit(ALWAYS).cast("long")
        texts = texts.union(one.withColumn("mark", always))
        marks = marks.union(one.select(always.alias("h")).limit(1))
    firsts = bit_filter(marks, LOG_BITS)
    salted = classes.where("lo < hi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = whole.withColumn("salt", F.pmod("mark", F.lit(SALTS)).cast("int")).join(
        salted.select("digest", "n", "salt", "lo"), ["digest", "n", "salt"]
    )
    copies = copies.where("doc_id > lo").select(
        F.col("doc_id").alias("doc"), "tag", F.lit(0).cast("long").alias("begin"), F.col("n").cast("long").alias("length")
    )
    found = [stage(copies, "spans")]
    shared = shared_samples(texts, firsts)
    release(spark)
    sampled = stage(units(texts, firsts, shared), "units")
    spans, left = resolve(sampled)
    found.append(spans)
    drop_tables(spark, [sampled])
    release(spark)

    def marks(where: str) -> np.ndarray:
        return bit_filter(_first_marks(left.where(where)), LOG_BITS)

    found.append(stage(open_spans(texts, firsts, shared, marks(f"contents < {HEAVY}")), "spans"))
    if not left.where(f"contents >= {HEAVY}").isEmpty():
        found.append(stage(heavy_spans(texts, firsts, shared, marks(f"contents >= {HEAVY}")), "spans"))
    release(spark)
    out = found[0]
    for spans in found[1:]:
        out = out.union(spans.select(*out.columns))
    return out


def text_tag(text: Column) -> Column:
    """64 bits that tell texts of one doc_id apart."""
    return F.xxhash64(text, F.lit(7))


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes) per row of docs.

    A byte goes if a 50-byte string that covers it also starts in a document
    with a smaller doc_id; strings do not cross documents. ``n_spans`` counts
    maximal removed runs. A NULL text is empty. Rows with a NULL doc_id keep all
    bytes. Repeated rows have equal results; different texts under one doc_id
    are compared with smaller doc_ids only, not with each other. An empty table
    gives an empty one. Other columns are not read.
    """
    spans = repeated_spans(docs).groupBy(F.col("doc").alias("doc_"), F.col("tag").alias("tag_")).agg(
        F.sort_array(F.collect_list(F.struct("begin", "length"))).alias("spans")
    )

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = (text or "").encode("utf-8")
                kept, upto, runs, removed = [], 0, 0, 0
                begin = end = -1
                for cut in [*(cuts or []), None]:
                    if cut is not None and cut["begin"] <= end:
                        end = max(end, cut["begin"] + cut["length"])
                        continue
                    if end > begin >= 0:
                        kept.append(data[upto:begin])
                        upto, runs, removed = end, runs + 1, removed + end - begin
                    if cut is not None:
                        begin, end = cut["begin"], cut["begin"] + cut["length"]
                kept.append(data[upto:])
                rest = b"".join(kept)
                out.append((len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest if texts else None))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    rows = docs.select("doc_id", "text", text_tag(F.col("text")).alias("tag"))
    met = rows.join(spans, (F.col("doc_id") == F.col("doc_")) & (F.col("tag") == F.col("tag_")), "left")
    out = met.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out if texts else out.drop("kept")
