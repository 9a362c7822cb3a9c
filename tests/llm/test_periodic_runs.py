"""Periodic runs against their definition."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from test_text_operators import docs_of, plain

from fieldlark.llm.periodic_runs import SuffixAutomaton, find_runs, periodic_runs, segments


def brute(w, least=12):
    """Every maximal stretch per period whose smallest period that is."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            part = w[i : i + size]
            if size >= max(least, 2 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([2, 4, 12]))
def test_runs_of_few_words(w, least):
    assert find_runs(np.array(w, dtype=np.int64), least) == brute(w, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=6), st.integers(1, 7)), max_size=6), st.sampled_from([3, 12]))
def test_stretches_hold_all_runs(parts, least):
    w = [x for p, k in parts for x in p * k]
    h = np.array([x * 7919 + 13 for x in w], dtype=np.uint64)
    got = [(a + s, n, q) for a, b in segments(h, np.zeros(len(w), dtype=np.int64), least) for s, n, q in find_runs(h[a:b], least)]
    assert sorted(got, key=lambda r: (r[0], r[2])) == brute(w, least)


def test_the_automaton_finds_neighbours_of_phrases():
    w = [1, 2, 3, 1, 2, 3, 9, 1, 2, 3]
    near = set(SuffixAutomaton(w).neighbours(2))
    assert (2, 3, 3) in near and (5, 4, 3) not in near and not any(size < 2 or d > size for _, d, size in near)
    assert len(SuffixAutomaton(list(range(50))).length) == 51


def rows_of(rng):
    texts = []
    for k in range(60):
        p = [f"w{rng.randint(0, 6)}é" for _ in range(rng.randint(1, 9))]
        q = [f"v{rng.randint(0, 300)}" for _ in range(rng.randint(0, 40))]
        texts.append(rng.choice([" ", "\n ", "\t\x0b"]).join([*q, *p * rng.randint(1, 6), *q, *p[:3] * 5][: rng.randint(0, 120)]))
    texts += [None, "", " \n ", "a " * 11, "a " * 12, " a" * 5000, "same line of words here\n" * 700, texts[3], texts[3], "a b " * 6 + "c", "Aa aA " * 6, "x" * 200_000]
    long = [f"u{rng.randint(0, 5000)}" for _ in range(20_000)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[5]), (500, " ".join(long)), (501, " ".join([*long[:50], *long[100:3100], *long[100:3100], *long[100:130]]))]


def test_runs_of_documents(spark):
    rows = rows_of(random.Random(8))
    got = periodic_runs(docs_of(spark, rows)).collect()
    have = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got), key=str)
    want = []
    for i, t in rows:
        w = plain(t)
        runs = brute(w) if len(w) < 3000 else [] if i == 500 else None
        if i == 501:
            runs = [(50, 6030, 3000)]
        if runs is None:
            runs = [(0, len(w), 1 if w[0] == "a" else 5)]
        want.append((i, len(w), runs, collapsed(w, runs)))
    assert have == sorted(want, key=str) and sum(len(r[2]) for r in have) > 50


def test_runs_of_nothing_and_of_other_ids(spark):
    named = spark.createDataFrame([("x", 1.5, "a b " * 9)], "doc_id string, text double, body string")
    r = periodic_runs(named, text_col="body").first()
    assert (r.doc_id, [tuple(x) for x in r.runs], r.text) == ("x", [(0, 18, 2)], "a b")
    assert periodic_runs(named.where("false"), text_col="body").count() == 0
