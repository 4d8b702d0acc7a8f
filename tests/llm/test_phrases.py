"""Collocations against a count of everything."""

from __future__ import annotations

import random
import re
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import phrases


def brute(rows, best, least):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in frequent.items():
            longer = (q for q, b in frequent.items() if len(q) > len(p) and b >= a)
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            n = totals[lang]
            cuts = [(1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]], n))
        found.sort()
        for rank, (score, a, phrase, left, right, n) in enumerate(found[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def _rows():
    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(12)], [f"rare{i}" for i in range(60)]
    fixed = ["New York City", "ad hoc", "x y x y x", "a\tb  c", "the end, of it", "é-ü Ä\x85b"]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(1, 25)):
            parts += rng.choices([rng.choice(common), rng.choice(rare), rng.choice(fixed)], weights=[6, 2, 2])
            parts.append(rng.choice([" ", "  ", "\t", ". ", "\n", "\x0b"]))
        rows.append((i, rng.choice(["en", "en", "fr", None, "und", ""]), "".join(x if x.isspace() else x + " " for x in parts)))
    rows += [(200, "de", None), (201, "de", ""), (202, None, " .. "), (203, "en", "c1 " * 3_000)]
    return rows + [rows[3]] * 3


@pytest.mark.parametrize(("best", "least", "frontier"), [(2_000, 3, phrases.FRONTIER), (5, 3, (1 / 16, 1 / 4, 1)), (1, 20, (1,))])
def test_collocations_equal_a_count_of_everything(spark, monkeypatch, best, least, frontier):
    monkeypatch.setattr(phrases, "FRONTIER", frontier)
    rows = _rows()
    docs = spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows], "doc_id long, lang string, text string, k int, phrase string, n int"
    ).repartition(4)
    found = phrases.collocations(docs, best, least)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute([r[1:] for r in rows], best, least)
    assert sorted(map(tuple, found.collect())) == expected
    assert len({e[0] for e in expected}) >= (4 if least == 3 else 2)


def test_products_beyond_64_bits_stay_exact(spark):
    a, n = 2**40 + 1, 2**43 + 7
    rows = [("x", "p q", a, 2), ("x", "p", a + 3, 1), ("x", "q", a + 9, 1)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, n long, k int")
    limits = spark.createDataFrame([("x", n, 2**62)], "lang string, total long, upto long")
    row = phrases.scored(frame, limits, 5).first()
    assert row.score == 1000 * a * n // ((a + 3) * (a + 9))


def test_no_rows_and_nothing_frequent(spark):
    docs = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def _handed_on(batches, *, k=1):
    """What a task hands on of all phrases of k words, for batches of (lang, text) rows."""
    docs = MagicMock()
    if k == 1:
        phrases.word_counts(docs)
    else:
        every = np.full(1 << (phrases.LOG_BITS - 6), 2**64 - 1, dtype=np.uint64)
        docs.sparkSession.sparkContext.broadcast = lambda value: MagicMock(value=value)
        phrases.grown(docs, k, phrases.Band(every, every, None), None, 1)
    run = docs.select.return_value.mapInArrow.call_args.args[0]
    found = pa.Table.from_batches(run(pa.RecordBatch.from_pylist(b, pa.schema({"lang": "string", "text": "string"})) for b in batches))
    found.validate(full=True)
    return found.to_pylist()


def test_a_task_hands_a_phrase_on_once_for_megabytes_of_text(spark):
    batches = [[{"lang": lang, "text": f"lorem ipsum{i} " * 1_000} for i in range(20) for lang in ("en", "la")] for _ in range(5)]
    assert sum(len(r["text"]) for b in batches for r in b) > 2 * phrases.AT_ONCE
    assert len(_handed_on(batches)) == 2 * 21
    assert len(_handed_on(batches, k=2)) == 2 * 40


def test_counts_of_odd_texts(spark, monkeypatch):
    rng = random.Random(7)
    bits = ["a", "B", "Ab", "a word of more than", "eighteen-letters-long", "é", "日本語", "\x85", "\x00", "\x0e\x1f", " ", "\ufeff"]
    bits += [" ", "\t", "  ", " \t ", " " * 40, ".", " .", ". ", " . ", "..", "\r\n", "\x0b", "?!"]
    rows = [(rng.choice(["en", "", None, "und", "日"]), "".join(rng.choices(bits, k=rng.randint(0, 60)))) for _ in range(400)]
    rows += [("en", None), ("en", ""), ("en", " "), ("en", "."), ("en", "a"), ("xx", " b"), ("xx", "c ")]
    batches = [[{"lang": lang, "text": text} for lang, text in rows[i : i + 37]] for i in range(0, len(rows), 37)]
    monkeypatch.setattr(phrases, "AT_ONCE", 2_000)
    for together in (1, 5_000, 1 << 22):
        monkeypatch.setattr(phrases, "TOGETHER", together)
        for k in (1, 2, 3, 5):
            expected, got = Counter(), Counter()
            for lang, text in rows:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
                for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    expected.update(("und" if lang is None else lang, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
            for r in _handed_on(batches, k=k):
                got[r["lang"], r["phrase"]] += r["n"]
            assert got == expected
