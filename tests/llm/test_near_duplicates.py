from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from strandline.llm import ngram_join
from strandline.llm.common import arrow_limits, only
from strandline.llm.components import components

from .conftest import ODD


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(rows, k, percent):
    sets = sets_of(rows, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def made(n, seed=3):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 30, 60, 150]))] for _ in range(25)]
    passage = [rng.choice(words) for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            j = rng.randrange(len(w))
            w[j : j + 1] = rng.choice([[], [rng.choice(words)], [w[j], rng.choice(words)]]) if len(w) > 1 else w[j : j + 1]
        rows.append((i, " ".join(w + passage if i % 5 == 0 else w)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_against_all_pairs(spark, frame, k, percent):
    arrow_limits(spark)
    rows = made(350)
    df = only(frame(rows), doc_id="long", text="string")
    assert {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(df, k, percent).collect()} == brute(rows, k, percent)


@pytest.mark.parametrize("ones", [0, 2, 4, 8])
@pytest.mark.parametrize("load", [0.1, 1.5, 4, 20])
def test_every_allocation_finds_every_pair(ones, load):
    """The pigeonhole argument, for forced segments with one-deletion neighbourhoods; a high load leaves many sets short."""
    percent = 80
    rng = random.Random(ones)
    sets = []
    for _ in range(120):
        base = [rng.getrandbits(64) for _ in range(rng.randint(3, 60))]
        sets.append(set(base))
        for _ in range(3):
            sets.append({x for x in base if rng.random() > 0.1} | {rng.getrandbits(64) for _ in range(rng.randint(0, 3))} or set(base))
    bands = ngram_join.bands(max(map(len, sets)))
    schemes = [ngram_join.Scheme(low, high, 100 * high // percent, max(1, round(low / load)), ones) for low, high in bands]
    tokens = np.concatenate([np.unique(np.array(sorted(s), np.uint64)) for s in sets])
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    key, doc = ngram_join.index_keys(tokens, at, schemes, percent)
    keys = [set() for _ in sets]
    for a, b in zip(key.tolist(), doc.tolist()):
        keys[b].add(a)
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            assert keys[a] & keys[b], (len(sets[a]), len(sets[b]))


def test_long_texts_with_a_passage_in_common_make_few_pairs(spark, frame, monkeypatch):
    """Of sets with more tokens than a short sketch has bits, the comparison within keys passes on no pairs that are far apart."""
    arrow_limits(spark)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(700))
    rows = [(i, passage + " " + " ".join(f"w{rng.getrandbits(60)}" for _ in range(1000))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(3)]
    made, write = [], ngram_join.cut_lineage

    def counted(df, **more):
        out = write(df, **more)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "cut_lineage", counted)
    found = ngram_join.near_duplicates(only(frame(rows), doc_id="long", text="string"), 5, 80).collect()
    assert {r[0]: r[2] for r in found} == {i: i % 100 for i, _ in rows}
    assert 0 < max(made) < 4 * len(rows), made


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for width in (1, 3, 5, 8):
        x = rng.integers(0, 1 << (8 * width - 1), 100).astype(np.uint64)
        assert (ngram_join.unplaned(ngram_join.planes(x, width), width) == x).all()


def test_odd_rows(spark, frame):
    arrow_limits(spark)
    got = ngram_join.near_duplicates(only(frame(ODD), doc_id="long", text="string")).collect()
    assert len(got) == len(ODD)
    found = {r[0]: (r[1], r[2]) for r in got}
    assert found[900] == (0, 900) and found[901] == (0, 901) and found[902] == (0, 902) and found[905] == (1, 905)
    assert found[903] == (1, 903) and found[904] == (2, 904) and found[None][1] is None
    assert ngram_join.near_duplicates(only(frame([]), doc_id="long", text="string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(edges.limit(0)).count() == 0
