"""Periodic runs against a search of all lags."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import periods


def brute_runs(words, least=24, times=3):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            begin = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            if length < max(least, times * q):
                continue
            smallest = next(p for p in range(1, q + 1) if all(words[j] == words[j - p] for j in range(start + p, i)))
            if smallest == q:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    rest = " ".join(x for i, x in enumerate(w) if i not in gone)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, rest)]
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, *digests)


def _pieces():
    letters = st.sampled_from("abc")
    word = st.lists(letters, min_size=1, max_size=9)
    periodic = st.builds(lambda u, n: (u * n)[: len(u) * n - n % 3], word, st.integers(1, 12))
    return st.lists(st.one_of(word, periodic), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(_pieces(), min_size=1, max_size=3), st.integers(4, 24))
def test_runs_of_small_alphabets_equal_a_search_of_all_lags(texts, least):
    texts = [[w for piece in text for w in piece] for text in texts]
    flat = [ord(w) for t in texts for w in t]
    found = periods.word_runs(
        np.array(flat, dtype=np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), least
    )
    expected, at = [], 0
    for t in texts:
        expected += [(s + at, length, q) for s, length, q in brute_runs(t, least)]
        at += len(t)
    assert [tuple(r) for r in found.tolist()] == expected


def test_nested_runs_and_runs_in_the_tail_of_another():
    inner = list("aaaaaaaaab")
    text = inner * 5 + list("xyz") + list("ab") * 40 + list("c") + list("ababababc") * 4
    found = periods.word_runs(np.array([ord(c) for c in text]), np.zeros(len(text), dtype=np.int64), 6)
    assert [tuple(r) for r in found.tolist()] == brute_runs(text, 6)


def test_one_word_a_million_times():
    found = periods.word_runs(np.zeros(1_000_000, dtype=np.int64), np.zeros(1_000_000, dtype=np.int64))
    assert found.tolist() == [[0, 1_000_000, 1]]


def test_digests_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b " * 30, "x " * 24, "x " * 23, "é ü\x0bz\x85 " * 20]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = rng.choices("abcdefgh", k=rng.randint(1, 30))
            parts += (unit * rng.randint(1, 9))[: rng.randint(5, 120)]
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
    texts.append(" ".join(rng.choices(["p", "q", "r"], k=1_500)))
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(None, "k l " * 20, 2, "c"), (5, "a b " * 30, 3, None)]
    rows += [rows[6], rows[6]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").repartition(3)
    key = repr
    found = sorted((tuple(r) for r in periods.run_digests(docs).collect()), key=key)
    assert found == sorted((brute_digest(r[0], r[1]) for r in rows), key=key)
    assert sum(r[1] for r in found) > 50
    out = periods.periodic_runs(docs)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    whole = {r.doc_id: r for r in out.collect()}
    assert [tuple(r) for r in whole[4].runs] == [(0, 60, 2)] and whole[4].collapsed == "a b"
    assert periods.run_digests(docs.limit(0)).count() == 0
