"""Fingerprints and their components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from shelfmark.llm import simhash
from shelfmark.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Label per fingerprint: the smallest one reachable."""
    fps = sorted(set(fps))
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            for y in fps:
                if (x ^ y).bit_count() <= 4 and label[y] < label[x]:
                    label[x], changed = label[y], True
    return label


def _fps(seed, n=150):
    """Clusters around random centres, chains that pass them on, and strangers."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(n // 6):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.add(x)
        for _ in range(6):
            for b in rng.sample(range(64), rng.choice([3, 4, 4, 5])):
                centre ^= 1 << b
            out.add(centre)
    out |= {rng.getrandbits(64) for _ in range(n // 3)}
    return sorted(out)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("longest", "seed"), [(1_024, 1), (12, 2), (3, 3), (1, 4)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, longest, seed):
    monkeypatch.setattr(simhash, "LIST", longest)  # 1 and 3: lists are split up to the midpoints
    fps = _fps(seed)
    frame = spark.createDataFrame([(_signed(f),) for f in fps], "fp long").repartition(3)
    links = simhash.fingerprint_links(frame)
    for a, b in links.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    found = {r.id: r.label for r in components(links).collect()}
    groups = {}
    for f, label in brute_components(fps).items():
        groups.setdefault(label, []).append(_signed(f))
    assert {f: found.get(f, f) for g in groups.values() for f in g} == {f: min(g) for g in groups.values() for f in g}
    assert max(map(len, groups.values())) > 5


def test_two_parts_of_any_four_positions_are_listed_together():
    from itertools import combinations

    for four in combinations(range(8), 4):
        assert any(len(set(four) & set(part)) > 1 for part in simhash.PARTS)


def test_documents_against_brute_force(spark):
    rng = random.Random(8)
    base = rng.choices([f"w{i}" for i in range(300)], k=400)
    texts = [None, "", " \n", "one", "ONE", "one two three", "A b c d", "é Ü x y z \U0001f600 q", "a\x85b c d e"]
    for _ in range(40):
        other = list(base)
        for at in rng.sample(range(400), rng.randint(0, 4)):
            other[at] = "changed"
        texts.append(" ".join(other))
    texts += [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(20)]
    texts.append(" ".join(rng.choices(["p", "q", "r", "s"], k=40_000)))
    rows = [(100 - i, t, 1, "x", 2) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, texts[10], 1, "x", 2), (None, "nobody else says this here", 1, "x", 2), (7, texts[12], 1, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, fingerprint string, salt int").repartition(3)
    label = brute_components([brute_fingerprint(r[1]) for r in rows])
    least = {}
    for r in rows:
        of = label[brute_fingerprint(r[1])]
        least[of] = min([x for x in (least.get(of), r[0]) if x is not None], default=None)
    expected = [(r[0], f"{brute_fingerprint(r[1]):016x}", least[label[brute_fingerprint(r[1])]]) for r in rows]
    found = simhash.near_fingerprints(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
    assert len({e[2] for e in expected}) < len(expected) - 10
    assert simhash.near_fingerprints(docs.limit(0)).count() == 0


def test_bits_are_counted_in_parts(monkeypatch):
    text = " ".join(np.random.default_rng(1).choice(list("abcdef"), 300)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())
