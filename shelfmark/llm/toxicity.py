"""Toxicity scores that do not move when a group's name is swapped for another's."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.decontaminate import tokens
from shelfmark.llm.text import small_batches
from shelfmark.operators import stage

PER_CLASS = 6_000  # labelled documents of each class to fit on, the first by a hash of doc_id
FEATURES = 2_048  # at most, of those with a standard score of MIN_Z or more in either direction
MIN_Z = 3.5
MIN_COUNT = 4
PREFIXES = (4, 5, 6, 7, 8)  # beside whole words, their first so many letters

# Names of groups that may stand for each other, by kind and language.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]  # at most FEATURES entries


def _words(text: str | None) -> list[str]:
    return b" ".join(tokens(text)).decode("utf-8").split(" ") if text else []


def _features(word: str) -> list[str]:
    return [f"={word}", *[word[:n] for n in PREFIXES if len(word) >= n]]


def _feature_set(found: Iterable[str]) -> set[str]:
    return {f for w in set(found) if w for f in _features(w)}


def counterfactuals(found: Sequence[str], identity: Sequence[Sequence[str]] = IDENTITY) -> list[list[str]]:
    """The words with every identity term replaced by another of its kind; none without such a term.

    Two versions: the next term of each kind, and the one before.
    """
    out = []
    for step in (1, -1):
        swap = {t: kind[(i + step) % len(kind)] for kind in identity for i, t in enumerate(kind)}
        if any(w in swap for w in found):
            out.append([swap.get(w, w) for w in found])
    return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(toxic, text) of at most per_class documents per class, none of them held out.

    A document with several labels is toxic if any says so; NULL labels say
    nothing. Of several texts of one doc_id the smallest is used.
    """
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(~is_held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.max("toxic").alias("toxic"))
    )

    def first(toxic: int) -> DataFrame:
        return known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("labelled"), "labelled").limit(per_class)

    chosen = F.broadcast(first(1).union(first(0)))  # 2 * per_class rows
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("labelled"))
    return rows.groupBy("labelled").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))


def vocabulary(rows: DataFrame, size: int = FEATURES) -> list[str]:
    """Features whose share differs most between the classes, by standard score of the log odds."""

    def count(batches):
        for pdf in batches:
            seen = {0: Counter(), 1: Counter()}
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                seen[int(toxic)].update(_feature_set(_words(text)))
            names = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame(
                {"feature": names, "a": [seen[1][n] for n in names], "b": [seen[0][n] for n in names]}
            )

    totals = rows.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    if not totals["a"] or not totals["b"]:
        return []
    counts = (
        rows.select("toxic", "text")
        .mapInPandas(count, "feature string, a long, b long")
        .groupBy("feature")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .where(F.col("a") + F.col("b") >= MIN_COUNT)
    )
    half = F.lit(0.5)
    a, b = F.col("a") + half, F.col("b") + half
    odds = F.log(a / (totals["a"] + 1 - a)) - F.log(b / (totals["b"] + 1 - b))
    z = F.abs(odds) / F.sqrt(1 / a + 1 / b)
    top = counts.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(size)
    return [r["feature"] for r in top.collect()]


def fit(
    x: tuple[np.ndarray, np.ndarray],
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray],
    y: np.ndarray,
    weight: np.ndarray,
    size: int,
    swap_penalty: float,
    ridge: float = 1e-4,
    steps: int = 400,
) -> tuple[float, np.ndarray]:
    """Logistic regression with a penalty on squared changes of the score under swaps.

    ``x``: row and feature numbers of the ones. ``pairs``: pair number, feature
    number and sign of the differences between a text and its swapped version.
    Gradient steps with Adam's step sizes over all rows.
    """
    rows, cols = x
    pair, pair_cols, sign = pairs
    n, n_pairs = len(y), int(pair.max()) + 1 if len(pair) else 0
    total = weight.sum()
    w = np.zeros(size + 1)
    share = (weight * y).sum() / total
    w[size] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        score = w[size] + np.bincount(rows, w[cols], n)
        error = weight * (1 / (1 + np.exp(-score)) - y) / total
        grad = np.append(np.bincount(cols, error[rows], size) + ridge * w[:size], error.sum())
        if n_pairs:
            change = np.bincount(pair, sign * w[pair_cols], n_pairs)
            grad[:size] += swap_penalty * np.bincount(pair_cols, sign * change[pair], size) / n_pairs
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(w[size]), w[:size]


def train(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    swap_penalty: float = 10.0,
    identity: Sequence[Sequence[str]] = IDENTITY,
) -> Model:
    """Fit on a bounded sample of labelled rows: 2 * per_class documents.

    Features are whole words and word beginnings that are present in a text.
    Where a text names a group, its score is also computed with other groups in
    their place, and the squared difference is penalised, so group names cannot
    carry weight. Classes count by their shares among all labels. Without
    labels of both classes every score is 0.
    """
    small_batches(docs.sparkSession)
    rows = stage(training_rows(docs, labels, per_class), "labelled")
    names = vocabulary(rows)
    if not names:
        return Model(-50.0, {})
    shares = {
        r["toxic"]: r["n"]
        for r in labels.where("toxic IS NOT NULL")
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("toxic")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    number = {f: i for i, f in enumerate(names)}

    def encode(batches):
        for pdf in batches:
            out = []
            for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
                found = _words(text)
                own = sorted(number[f] for f in _feature_set(found) if f in number)
                gone, come = [], []
                for other in counterfactuals(found, identity):
                    swapped = {number[f] for f in _feature_set(other) if f in number}
                    gone.append(sorted(set(own) - swapped))
                    come.append(sorted(swapped - set(own)))
                out.append((int(toxic), own, gone, come))
            yield pd.DataFrame(out, columns=["toxic", "own", "gone", "come"])

    def solve(batches):
        data = pd.concat([*batches, pd.DataFrame(columns=["toxic", "own", "gone", "come"])])
        y = data["toxic"].to_numpy(dtype=float)
        lengths = data["own"].map(len).to_numpy(dtype=int)
        rows_ = np.repeat(np.arange(len(y)), lengths)
        cols = np.concatenate([*data["own"], []]).astype(np.int64)
        pair, pair_cols, sign, at = [], [], [], 0
        for gone, come in zip(data["gone"], data["come"], strict=True):
            for g, c in zip(gone, come, strict=True):
                pair += [at] * (len(g) + len(c))
                pair_cols += [*g, *c]
                sign += [1.0] * len(g) + [-1.0] * len(c)
                at += 1
        share = np.array([shares.get(k, 0) / max((y == k).sum(), 1) for k in (0, 1)])
        pairs = (np.array(pair, dtype=np.int64), np.array(pair_cols, dtype=np.int64), np.array(sign))
        bias, w = fit((rows_, cols), pairs, y, share[y.astype(int)], len(names), swap_penalty)
        yield pd.DataFrame({"i": np.arange(-1, len(names)), "w": np.append(bias, w)})

    encoded = rows.select("toxic", "text").mapInPandas(
        encode, "toxic int, own array<int>, gone array<array<int>>, come array<array<int>>"
    )
    # at most 2 * per_class rows of feature numbers
    solved = {r["i"]: r["w"] for r in encoded.repartition(1).mapInPandas(solve, "i int, w double").collect()}
    return Model(solved[-1], {f: solved[i] for f, i in number.items()})


def score(text: Column, model: Model) -> Column:
    """Toxicity from 0 to 1 of whole texts; NULL and empty ones have no features."""
    weights, bias = model.weights, model.bias

    class Known(dict):
        def __missing__(self, word):
            if len(self) >= 400_000:
                self.clear()
            out = self[word] = tuple(f for f in _features(word) if f in weights) if word else ()
            return out

    known = Known()

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = []
        for value in texts:
            features = set()
            for word in set(_words(value)):
                features.update(known[word])
            out.append(bias + sum(sorted(weights[f] for f in features)))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -50, 50)))) if out else pd.Series([], dtype=float)

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs; repeated rows are scored alike.

    Held out are documents whose crc32 of doc_id as text is divisible by 5; their
    labels are not used (a NULL doc_id is never labelled). Scores read the text alone.
    """
    model = train(docs, labels, **options)
    scored = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
