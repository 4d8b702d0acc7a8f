"""Words and small column helpers shared by the operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ASCII white space that separates words.
BLANKS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for NULL."""
    none = F.array().cast("array<string>")
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(trimmed, lambda t: F.when(t == "", none).otherwise(F.split(t, f"{SPACE}+")))


def window_hashes(tokens: Column, k: int) -> Column:
    """64-bit hash of every run of k tokens, in order."""

    def over(found: Column) -> Column:
        starts = F.slice(found, 1, F.greatest(F.size(found) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.xxhash64(F.slice(found, i + 1, k)))

    return let(tokens, over)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df but for columns of these names, in any case."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros beyond the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    out = np.empty(n, dtype=np.uint64)
    for r in range(8):
        m = (n - r + 7) // 8
        out[r::8] = padded[r : r + 8 * m].view("<u8")[:m]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    words_ = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=1)  # a view: the eight bytes from every place on
    out = mixed(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rest, done = np.flatnonzero(sizes > 0), 0
    while len(rest):
        left = np.minimum(sizes[rest] - done, 8).astype(np.uint64)
        cut = np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left)
        word = words_[starts[rest] + done] & cut
        out[rest] = mixed(out[rest] ^ (word * np.uint64(0xC2B2AE3D27D4EB4F)))
        done += 8
        rest = rest[sizes[rest] > done]
    return out


def _hashed(texts: Sequence[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    blank = np.zeros(256, dtype=bool)
    blank[list(BLANKS.encode())] = True
    edges = np.flatnonzero(np.diff(np.append(True, blank[data]).view(np.int8)))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    out = span_hashes(data, starts, sizes)
    ends = np.cumsum([len(x) + 1 for x in texts])
    return np.split(out, np.searchsorted(starts, ends[:-1]))


def word_hashes(texts: Sequence[bytes], at_once: int = 1 << 16) -> list[np.ndarray]:
    """64-bit hash of every word (parted by ASCII white space) of each text, some bytes of text at once."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= at_once:
            out += _hashed(part)
            part, size = [], 0
    return out + _hashed(part) if part else out


def slices(batches: Iterable[pa.RecordBatch], at_once: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so many bytes of text, so that a task's memory does not follow the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(sizes.astype(np.int64) + 64) // at_once
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin or len(sizes) == 0:
                yield batch.slice(begin, end - begin)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64, dtype=np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def bit_filter(hashes: DataFrame, log_bits: int) -> np.ndarray:
    """Two bits per hash (column ``h``), both in the word that its top bits name.

    2 ** (log_bits - 6) rows at most come back, whatever is in it.
    """
    bit = F.shiftrightunsigned("h", 64 - log_bits)
    rows = hashes.select("h", bit.alias("bit")).select(
        F.shiftright("bit", 6).alias("word"),
        F.expr("shiftleft(1L, CAST(bit & 63 AS INT)) | shiftleft(1L, CAST(shiftrightunsigned(h, 7) & 63 AS INT))").alias(
            "mask"
        ),
    )
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (log_bits - 6), dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return out.view(np.uint64)


def filter_bits(hashes: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the two bits of each hash (unsigned)."""
    first = hashes >> np.uint64(64 - log_bits)
    return first, (first & ~np.uint64(63)) | ((hashes >> np.uint64(7)) & np.uint64(63))


def in_filter(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) may be in the filter."""
    first, second = filter_bits(hashes, len(bits).bit_length() + 5)
    word = bits[(first >> np.uint64(6)).astype(np.int64)]
    return (word >> (first & np.uint64(63))) & (word >> (second & np.uint64(63))) & np.uint64(1) == 1


def long_lists(arrays: Sequence[np.ndarray]) -> pa.Array:
    """An Arrow list of 64-bit numbers per array."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([*arrays, np.empty(0, dtype=np.int64)] if not arrays else arrays).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of plans that are no longer referred to."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def drop_tables(spark: SparkSession, frames: Iterable[DataFrame]) -> None:
    """Remove staged tables that nothing reads any more."""
    for frame in frames:
        for file in frame.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand texts to Python in batches of at most so many rows, for this session.

    The default of 10,000 rows is meant for narrow rows; as texts they take
    buffers of up to 100 MB on either side of every task. A smaller setting stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
