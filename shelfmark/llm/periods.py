"""Periodic runs of words: found on lag diagonals, word by word, and collapsed to their first period."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.text import let, slices, small_batches, without, words

LEAST = 24  # words of a run
PERIODS = 3  # and periods of a run, at least
AT_ONCE = 1 << 16  # words that a task lays end to end; a longer text goes alone


def word_runs(ids: np.ndarray, text_no: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; starts count from the first word of ``ids``.

    ``ids`` are numbers of words, texts laid end to end, ``text_no`` the (rising)
    number of each word's text; no run crosses texts.

    A run of period q shows on the diagonal of lag q: word after word equals the
    one q before. Every word advances the match length of a diagonal that one of
    its earlier occurrences lies on, and a diagonal that ends emits its run if
    it is long enough. Which earlier occurrence matters is what keeps this
    sparse: with the k words up to a word as its context, the nearest earlier
    occurrence of that context names the only lag in (k/2, k] that a run of
    ``periods`` >= 3 can have there. (Inside a run of smallest period q <= k the
    context holds a whole period, and a primitive word meets itself only at
    multiples of its length; a run of 3 q words has room for k + q of them, as
    k < 2 q. A lag that is not the smallest period never is the nearest.) So the
    contexts 1, 2, 4, ... words cover all lags with one active diagonal each, a
    word that is repeated m times costs no m * m steps, and contexts found only
    once leave: in prose three or four rounds do.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not covered")
    n = len(ids)
    found = []
    place = np.arange(n)
    _, name = np.unique(ids, return_inverse=True)
    key = name + text_no * (int(name.max()) + 1 if n else 1)
    k = 1
    while len(place):
        order = np.argsort(key, kind="stable")
        again = key[order][1:] == key[order][:-1]
        at, before = place[order][1:][again], place[order][:-1][again]
        lag = at - before
        on = (lag * 2 > k) & (lag <= k)
        found.append(_ended(at[on], lag[on], k, least, periods))
        # contexts of twice the length, from those found twice or more
        number = np.cumsum(np.append(True, ~again)) if n else order
        several = np.append(again, False) | np.append(False, again)
        known = np.full(n, -1, dtype=np.int64)
        known[place[order][several]] = number[several]
        place = np.flatnonzero(known >= 0)
        place = place[place >= k]
        place = place[(known[place - k] >= 0) & (text_no[place - k] == text_no[place])]
        key = known[place] * (len(known) + 1) + known[place - k]
        k *= 2
    runs = np.concatenate([*found, np.empty((0, 3), dtype=np.int64)])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _ended(at: np.ndarray, lag: np.ndarray, k: int, least: int, periods: int) -> np.ndarray:
    """Runs of the diagonals that words ``at`` advance, in word order: one ends where the next word is not on it."""
    order = np.argsort(at, kind="stable")
    at, lag = at[order], lag[order]
    starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1]))[: len(at)])
    ends = np.append(starts[1:], len(at)) - 1 if len(starts) else starts
    period = lag[starts]
    first = at[starts] - k + 1 - period
    length = at[ends] + 1 - first
    long_enough = length >= np.maximum(least, periods * period)
    return np.stack([first, length, period], axis=1)[long_enough]


def _texts(tokens: Sequence[list[bytes]], least: int, periods: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs and the collapsed text of each list of words."""
    names: dict[bytes, int] = {}
    sizes = [len(t) for t in tokens]
    ids = np.array([names.setdefault(w, len(names)) for t in tokens for w in t], dtype=np.int64)
    runs = word_runs(ids, np.repeat(np.arange(len(tokens)), sizes), least, periods)
    begins = np.cumsum([0, *sizes])
    cuts = np.searchsorted(runs[:, 0], begins)
    for i, own in enumerate(tokens):
        mine = runs[cuts[i] : cuts[i + 1]] - np.array([begins[i], 0, 0])
        if len(mine):
            edge = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
            np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
            own = [own[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        yield mine, b" ".join(own)


def _in_parts(texts: Sequence[str | None]) -> Iterator[list[list[bytes]]]:
    part, size = [], 0
    for text in texts:
        part.append((text or "").encode("utf-8").split())  # bytes are split at ASCII white space
        size += len(part[-1])
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """docs with ``runs`` (start, length, period in words) and ``collapsed`` (replacing columns of these names).

    A run is a stretch of words with smallest period q (words q apart are equal)
    of ``max(least, periods * q)`` words or more that no neighbouring word
    extends. ``collapsed`` holds the words, joined by one space, but those that lie
    in some run after its first q words. Words are parted by ASCII white space.

    Texts are looked at one by one, whole: no shuffle, and time in proportion to
    n log n words of a text whatever it repeats. NULL, empty and blank texts have
    no runs and an empty ``collapsed``. Repeated rows have equal results. An
    empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    kept = without(docs, ("runs", "collapsed"))
    schema = T.StructType([T.StructField("doc", kept.schema), *T._parse_datatype_string(f"runs {RUNS}, collapsed string")])
    kinds = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def run(batches):
        for batch in slices(batches):
            offsets, rows, out = [0], [], []
            for part in _in_parts(batch.column("text").to_pylist()):
                for mine, rest in _texts(part, least, periods):
                    offsets.append(offsets[-1] + len(mine))
                    rows.append(mine)
                    out.append(rest.decode("utf-8"))
            flat = np.concatenate([*rows, np.empty((0, 3), dtype=np.int64)])
            fields = [pa.array(flat[:, i]) for i in range(3)]
            values = pa.StructArray.from_arrays(fields, fields=[pa.field(*kind) for kind in kinds])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), lists, pa.array(out, pa.string())], schema.names)

    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("doc"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, schema).select("doc.*", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where texts of a tenth of all ids (crc32 of the decimal doc_id) turn periodic from some word on."""
    crc = F.crc32(F.col("doc_id").cast("string"))

    def periodic(found: Column) -> Column:
        n, g = F.size(found).cast("long"), F.floor(crc / 10).cast("long")
        a = F.pmod(g, n)
        parts = 3 + F.pmod(g, F.lit(8))
        p = 1 + ((n - a - F.pmod(n - a, parts)) / parts).cast("long")
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        source = F.transform(place, lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        joined = F.array_join(F.transform(source, lambda i: F.get(found, i.cast("int"))), " ")
        return F.when(n > 0, joined).otherwise("")

    text = F.when(F.pmod(crc, F.lit(10)) == 0, let(words(F.col("text")), periodic)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period, and SHA-256 of all runs and of the collapsed text.

    Rows with a NULL doc_id or text are as ``planted`` leaves them: unchanged.
    """
    found = periodic_runs(planted(docs))
    # runs come by start and period, so the first of equals stays
    best = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda top, x: F.when(x["length"] * top["period"] > top["length"] * x["period"], x).otherwise(top),
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
