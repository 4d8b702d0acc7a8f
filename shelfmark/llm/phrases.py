"""Collocations: phrases that are grown from their first and last words, the most promising words first."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.text import bit_filter, in_filter, mixed, release, slices, small_batches, span_hashes
from shelfmark.operators import stage, staging_root

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a phrase
BEST = 2_000  # phrases of a language
# What ends a piece of text, and what parts its words.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
NO_LANGUAGE = "und"
# Words of a language join the frontier by rising frequency, up to these shares of all its words.
FRONTIER = (1 / 4, 1)
COUNTS = "lang string, phrase string, n long"
PHRASES = f"{COUNTS}, k int"
LOG_BITS = 23  # filters of 1 MB, whatever is in them
AT_ONCE = 1 << 18  # bytes of text that a task parts into words at once: arrays that stay in the processor's cache
TOGETHER = 1 << 22  # bytes of text whose phrases a task counts before it hands them on
_MUL = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
# The texts as the operator reads them: A-Z lower-cased, blanks and breaks one byte each. No text keeps a _BETWEEN.
_BLANK, _BREAK, _BETWEEN = b" \n\r"
_READ = bytes.maketrans(
    bytes(range(65, 91)) + BLANKS.encode() + BREAKS.encode(),
    bytes(range(97, 123)) + bytes([_BLANK] * len(BLANKS) + [_BREAK] * len(BREAKS)),
)


def _plain(text: bytes) -> bytes:
    text = text.translate(_READ)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class Words:
    """The words of some texts, end to end; those of a piece are one blank apart.

    ``h`` is a hash of word and language, ``piece`` rises from piece to piece.
    """

    def __init__(self, langs: Sequence[str], texts: Sequence[bytes]):
        plain = [_plain(t) for t in texts]
        between = bytes([_BETWEEN])
        self.data = between + between.join(plain) + between
        data = np.frombuffer(self.data, dtype=np.uint8)
        parted = (data == _BLANK) | (data == _BREAK) | (data == _BETWEEN)
        edges = np.flatnonzero(parted[1:] != parted[:-1]) + 1
        self.starts, self.ends = edges[::2].copy(), edges[1::2].copy()
        # between two words: a gap longer than a byte has a break in it
        broken = (self.starts[1:] - self.ends[:-1] > 1) | (data[self.ends[:-1]] != _BLANK)
        self.piece = np.cumsum(np.append(True, broken)[: len(self.starts)], dtype=np.int32)
        upto = np.searchsorted(self.starts, np.cumsum([len(t) + 1 for t in plain], dtype=np.int64))
        self.text = np.repeat(np.arange(len(plain), dtype=np.int32), np.diff(upto, prepend=0))
        self.langs = list(dict.fromkeys(langs))
        code = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.array([code[lang] for lang in langs], dtype=np.int32)[self.text]  # place in ``langs``, by word
        of = span_hashes(*_bytes(self.langs)) * _MUL[0]
        self.h = mixed(span_hashes(data, self.starts, self.ends - self.starts) ^ of[self.lang])

    def phrases(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, wherever they end."""
        n = max(len(self.h) - k + 1, 0)
        out = self.h[:n].copy()
        for i in range(1, k):
            out = mixed(out * _MUL[0] ^ self.h[i : i + n])
        return out


def _bytes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    encoded = [t.encode("utf-8") for t in texts]
    sizes = np.array([len(t) for t in encoded], dtype=np.int64)
    return np.frombuffer(b"".join(encoded), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _words(batch: pa.RecordBatch, text: str = "text") -> Words:
    langs = [NO_LANGUAGE if x is None else x for x in batch.column("lang").to_pylist()]
    return Words(langs, [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()])


def _spans(data: bytes, begins: np.ndarray, ends: np.ndarray, k: int) -> pa.Array:
    """The spans as strings. They come in k equal shares, and in each they rise without touching."""
    whole, out = pa.py_buffer(data), []
    for share in np.array_split(np.stack([begins, ends], axis=1).astype(np.int32), k):
        # every other string is what lies between two spans
        both = pa.StringArray.from_buffers(max(share.size - 1, 0), pa.py_buffer(share.ravel()), whole)
        out.append(both.take(pa.array(np.arange(0, len(both), 2))))
    return pa.concat_arrays(out)


@dataclass(frozen=True)
class Band:
    """What a step of the frontier lets through, as filters of phrases with their language."""

    frequent: np.ndarray  # words with enough occurrences
    new: np.ndarray  # words that join the frontier now
    before: np.ndarray | None  # words that joined earlier


def _phrase_filter(spark: SparkSession, phrases: DataFrame) -> np.ndarray:
    """A filter of the table's phrases, hashed as in ``Words.phrases``."""

    def run(batches):
        for batch in batches:
            out = []
            words = _words(batch, "phrase")
            sizes = np.bincount(words.text, minlength=batch.num_rows)
            firsts = np.cumsum(sizes) - sizes
            for k in np.unique(sizes).tolist():
                out.append(words.phrases(k)[firsts[sizes == k]])
            h = np.concatenate([*out, np.empty(0, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return bit_filter(phrases.select("lang", "phrase").mapInArrow(run, "h long"), LOG_BITS)


def _counted(parts: Sequence[tuple[Words, np.ndarray]], k: int) -> pa.RecordBatch:
    """lang, phrase, n: the k words from each part's places on, each phrase once."""
    sizes = [len(words.data) for words, _ in parts]
    moved = list(zip(parts, np.cumsum(sizes) - sizes, strict=True))
    langs = list(dict.fromkeys(lang for words, _ in parts for lang in words.langs))
    code = {lang: i for i, lang in enumerate(langs)}
    h = np.concatenate([words.phrases(k)[at] for words, at in parts])
    order = np.argsort(h)
    first = np.flatnonzero(np.append(True, np.diff(h[order]) != 0)[: len(h)])
    n = np.diff(np.append(first, len(h)))
    one = order[first]  # any of equal ones
    by_place = np.argsort(one)
    by_place = np.concatenate([by_place[i::k] for i in range(k)])  # k words on, the next phrase has begun behind this one
    one, n = one[by_place], n[by_place]
    begins = np.concatenate([words.starts[at] + start for (words, at), start in moved])[one]
    ends = np.concatenate([words.ends[at + k - 1] + start for (words, at), start in moved])[one]
    lang = np.concatenate([np.array([code[x] for x in words.langs], dtype=np.int32)[words.lang[at]] for words, at in parts])[one]
    found = _spans(b"".join(words.data for words, _ in parts), begins, ends, k)
    columns = [pa.array(langs, pa.string()).take(pa.array(lang)), found, pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "n"])


def _counts(batches: Iterable[pa.RecordBatch], k: int, places: Callable[[Words], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, n: the k words from ``places`` on, each phrase once in TOGETHER bytes of text."""
    parts, size = [], 0
    for batch in slices(batches, AT_ONCE):
        words = _words(batch)
        at = places(words)
        if len(at):
            parts.append((words, at))
            size += len(words.data)
        if size >= TOGETHER:
            yield _counted(parts, k)
            parts, size = [], 0
    if parts:
        yield _counted(parts, k)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, n of all single words."""

    def run(batches):
        yield from _counts(batches, 1, lambda words: np.arange(len(words.h)))

    each = docs.select("lang", "text").mapInArrow(run, COUNTS)
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def grown(docs: DataFrame, k: int, band: Band, shorter: np.ndarray | None, least: int) -> DataFrame:
    """lang, phrase, n of the frequent phrases of k words that a band adds.

    A phrase of frequent words is counted if its first or its last word joins
    now and neither did earlier; from three words on, if the frequent phrases of
    k - 1 words (``shorter``) have its beginning, where its first word joins, and
    its end, where its last word does. Filters may pass more, all of it or
    none of a phrase's occurrences, so counts are exact.
    """
    # plain arrays: tasks need no copy of this package to read them
    sent = docs.sparkSession.sparkContext.broadcast((band.frequent, band.new, band.before, shorter))

    def places(words: Words) -> np.ndarray:
        frequent_, new_, before_, shorter_ = sent.value
        n = max(len(words.h) - k + 1, 0)
        last = slice(k - 1, k - 1 + n)
        ok = words.piece[:n] == words.piece[last]
        frequent = in_filter(words.h, frequent_)
        for i in range(k):
            ok &= frequent[i : i + n]
        new = in_filter(words.h, new_)
        ok &= new[:n] | new[last]
        if before_ is not None:
            old = in_filter(words.h, before_)
            ok &= ~(old[:n] | old[last])
        if shorter_ is not None:
            known = in_filter(words.phrases(k - 1), shorter_)
            ok &= (known[:n] | ~new[:n]) & (known[1 : 1 + n] | ~new[last])
        return np.flatnonzero(ok)

    def run(batches):
        yield from _counts(batches, k, places)

    each = docs.select("lang", "text").mapInArrow(run, COUNTS)
    counts = each.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least).withColumn("k", F.lit(k))


def _limits(words: DataFrame, single: DataFrame, share: float) -> DataFrame:
    """lang, total of all words, ``upto``: frequent words of so many occurrences make up the share, ``top``: the most frequent.

    By bins of frequencies, some 2,000 a language at most.
    """
    edge = F.expr("n - n % shiftleft(1L, greatest(length(bin(n)) - 6, 0))")
    bins = single.withColumn("edge", edge).groupBy("lang", "edge").agg(F.sum("n").alias("m"), F.max("n").alias("high"))
    by_edge = Window.partitionBy("lang").orderBy("edge")
    bins = bins.withColumns({"below": F.sum("m").over(by_edge), "all": F.sum("m").over(Window.partitionBy("lang"))})
    fits = F.col("below") <= F.lit(share) * F.col("all")
    limits = bins.groupBy("lang").agg(F.max(F.when(fits, F.col("high"))).alias("upto"), F.max("high").alias("top"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    return totals.join(limits, "lang", "left").withColumns({c: F.coalesce(c, zero) for c in ("upto", "top")})


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def scored(phrases: DataFrame, limits: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases on the frontier, without those that a longer one holds.

    ``phrases``: lang, phrase, n, k of single words and all that is grown. The score
    is that of the lowest cut. A phrase goes if one of a word more, to either
    side, occurs as often: any longer one as frequent would imply such a one.
    """
    parts = F.split("phrase", " ")
    size = F.size(parts)
    piece = lambda begin, n: F.array_join(F.slice(parts, begin, n), " ")
    counts = phrases.select("lang", "phrase", "n")
    rows = phrases.where(f"k BETWEEN 2 AND {longest}")
    inside = F.explode(F.array(piece(F.lit(1), size - 1), piece(F.lit(2), size - 1)))
    held = rows.where("k > 2").select("lang", inside.alias("phrase"), "n").distinct()
    rows = rows.join(held, ["lang", "phrase", "n"], "left_anti")
    cut = rows.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cut = cut.withColumns({"left": piece(F.lit(1), F.col("cut")), "right": piece(F.col("cut") + 1, size - F.col("cut"))})
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    # the cuts behind the first and before the last word tell whether both words are on the frontier
    cut = cut.join(limits.select("lang", "total", "upto"), "lang")
    over = F.lit(1000).cast("decimal(4,0)") * (_exact("a") * _exact("total"))
    score = F.call_function("div", over, _exact("l") * _exact("r"))
    return (
        cut.withColumn("score", score)
        .groupBy("lang", "phrase", "a", F.col("total").alias("n"))
        .agg(
            F.min(F.struct("score", "cut", "l", "r")).alias("low"),
            F.max(F.when(F.col("cut") == 1, F.col("l") <= F.col("upto"))).alias("first"),
            F.max(F.when(F.col("cut") == size - 1, F.col("r") <= F.col("upto"))).alias("last"),
        )
        .where("first AND last")
        .select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    )


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``best`` phrases.

    Texts (A-Z lower-cased) fall into pieces at BREAKS, pieces into words at
    BLANKS. Candidates are phrases of 2 to ``longest`` words with ``a >= least``
    occurrences in pieces. Cut behind its k-th word, a phrase scores
    ``floor(1000 * a * n / (l * r))`` by the occurrences of both parts and of all
    the language's words; its lowest cut counts. Phrases inside a longer
    candidate with as many occurrences go. Order: score and a, falling, phrase.

    A phrase that begins or ends with a word of f occurrences scores at most
    ``1000 * n / f``, as no phrase is more frequent than its parts. So words join
    the frontier by rising frequency. Phrases grow from words of the frontier,
    forwards by beginnings and backwards by ends, one word longer per pass over
    the texts, and only through frequent ones. A language is settled as soon as
    its ``best``-th score is above the bound of the first word that is left, so
    ties are in; the last step of the frontier has all words. Counts cover all texts.

    NULL texts are empty, a NULL language is ``und`` (with the rows that say so).
    Repeated rows count again. Phrases are grouped as strings; hashes (64 bits)
    only tell phrases of some megabytes of text apart before that, and fill filters. An empty table, or no
    frequent phrase, gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = stage(word_counts(docs), "words")
    single = words.where(F.col("n") >= least)
    frequent = _phrase_filter(spark, single)
    # all that is counted goes to one folder: one scan, however many steps it took
    known = f"{staging_root(spark)}/phrases-{uuid.uuid4().hex}"
    single.withColumn("k", F.lit(1)).write.parquet(known)
    phrases = spark.read.schema(PHRASES).parquet
    before = waiting = joined = None
    for share in FRONTIER:
        limits = stage(_limits(words, single, share), "limits")
        on = single.join(limits, "lang").where("n <= upto").select("lang", "phrase", "n")
        if joined is not None:
            # settled languages stay as they are
            on = on.join(waiting, "lang", "left_semi").union(joined.join(waiting, "lang", "left_anti"))
        joined = stage(on, "frontier")
        band = Band(frequent, _phrase_filter(spark, joined), before)
        shorter = None
        for k in range(2, longest + 1):
            grown(docs, k, band, shorter, least).write.mode("append").parquet(known)
            if k < longest:
                shorter = _phrase_filter(spark, phrases(known).where(F.col("k") == k))
        reached = joined.groupBy("lang").agg(F.max("n").alias("upto"))
        limits = limits.drop("upto").join(reached, "lang", "left")
        limits = stage(limits.withColumn("upto", F.coalesce("upto", F.lit(0).cast("long"))), "limits")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = scored(phrases(known), limits, longest).withColumn("rank", F.row_number().over(order).cast("long"))
        ranked = stage(ranked.where(F.col("rank") <= best), "ranked")
        last = ranked.where(F.col("rank") == best).select("lang", F.col("score").alias("last"))
        bound = F.expr("1000 * total div (upto + 1)")
        settled = (F.col("upto") >= F.col("top")) | F.coalesce(F.col("last") > bound, F.lit(False))
        waiting = stage(limits.join(last, "lang", "left").where(~settled).select("lang"), "waiting")
        if waiting.isEmpty():
            break
        before = band.new
        release(spark)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
