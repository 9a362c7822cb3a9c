"""HyperMinHash sketches, and components against all pairs."""

import random

import numpy as np
import pytest
from test_text_operators import FOLD, docs_of, plain

from fieldlark.llm import hyperminhash
from fieldlark.llm.hyperminhash import BANDS, EMPTY, REGISTERS, ROWS, chance, estimate, near_duplicate_components, promising, sketches


def shingles(text):
    w = plain((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def expected(rows):
    """(n_shingles, component of row numbers) per row."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in enumerate(sets):
        for b in range(a):
            if x and sets[b] and 100 * len(x & sets[b]) >= 85 * len(x | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], len(s), least[find(k)], r[0] == least[find(k)]) for k, (r, s) in enumerate(zip(rows, sets))), key=str)


def corpus(rng):
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.5:
            w = plain(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"edit{rng.randint(0, 99)}"
        else:
            w = [f"w{rng.randint(0, 2000)}é" for _ in range(rng.choice([1, 2, 3, 6, 9, 30, 150, 400]))]
        rows.append((i, " ".join(w)))
    base = [f"b{k}" for k in range(200)]
    for i in range(90):  # a large group, part of it linked by chains only, in which classes also stay apart
        w = list(base)
        for _ in range(rng.choice([0, 2, 4, 6, 8, 20])):
            w[rng.randrange(200)] = f"x{rng.randint(0, 10**6)}"
        rows.append((1000 + i, (" ".join(w).upper() if i % 2 else "\n".join(w))))
    seven = "a b c d e f g h i"
    rows += [(2000, None), (2001, ""), (2002, " \t "), (2003, "two words"), (2004, "Two  WORDS"), (2005, "two"), (2006, rows[3][1]), (2007, " ".join(base * 60)), (2008, seven), (2009, seven + " j"), (2010, "z " + seven)]
    rows += [(None, rows[70][1]), (None, " ".join(base[:199] + ["odd"])), (None, "nobody else says this at all"), (None, "nobody else says this at all"), (None, None), (5, "an id twice here and now"), (5, rows[90][1])]
    return rows


@pytest.mark.parametrize("pairwise, block", [(16, None), (3, 6000), (2, 100_000)])
def test_components_against_all_pairs(spark, monkeypatch, pairwise, block):
    if block:
        monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rows = corpus(random.Random(12))
    got = near_duplicate_components(docs_of(spark, rows), pairwise=pairwise).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_large_group_without_links(spark):
    """Every two share a bucket, none is linked: all classes stay apart."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in rng.sample(range(0, 300, 3), 18):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    got = near_duplicate_components(docs_of(spark, rows), pairwise=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_ids_of_strings_and_empty_tables(spark):
    named = spark.createDataFrame([("b", "one two three four"), ("a", "One two three  four"), (None, "one two three four"), ("c", None)], "doc_id string, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicate_components(named).collect()}
    assert got == {("b", "a", False), ("a", "a", True), (None, "a", False), ("c", "c", True)}
    assert near_duplicate_components(named.where("false")).count() == 0


def test_registers_hold_zeros_and_mantissa():
    x = np.arange(1, 40, dtype=np.uint64)
    one = sketches(x, np.zeros(39, dtype=np.int64), 1)
    v = hyperminhash.mix(x ^ np.uint64(0x9E6C63D0876A9A47)) >> np.uint64(11)
    y = hyperminhash.mix(x ^ np.uint64(0x2545F4914F6CDD1D))
    least = {}
    for bucket, value in zip((int(b) * REGISTERS >> 32 for b in y >> np.uint64(32)), v.tolist()):
        least[bucket] = min(value, least.get(bucket, 1 << 53))
    for k in range(REGISTERS):
        if k not in least:
            assert one[0, k] == EMPTY
        else:
            bits = f"{least[k]:053b}"
            zeros = len(bits) - len(bits.lstrip("0"))
            assert one[0, k] == (zeros << 26) | int((bits[zeros + 1 :] + "0" * 26)[:26], 2)
    assert REGISTERS == BANDS * ROWS and (sketches(x, np.zeros(39, dtype=np.int64), 3)[1:] == EMPTY).all()


@pytest.mark.parametrize("mantissa", [1, 4, 26])
def test_estimates_are_corrected_for_collisions(mantissa):
    rng = np.random.default_rng(5)
    errors, raw, hits = [], [], 0
    for t in range(300):
        n, shared = 2000, 600 if t % 2 else 0
        x = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        sets = x[:n], x[n - shared :]
        a, b = (sketches(s, np.zeros(n, dtype=np.int64), 1, mantissa) for s in sets)
        j, used = estimate(a, b, np.array([n]), np.array([n]), mantissa)
        true = shared / (2 * n - shared)
        errors.append(j[0] - true)
        raw.append((a == b).mean() - true)
        hits += int(promising(j, used, 0.85)[0])
    assert abs(np.mean(errors)) < 0.012 and hits == 0
    if mantissa == 1:
        assert np.mean(raw) > 10 * abs(np.mean(errors))
    assert 0 < chance(np.array([2000]), np.array([2000]), mantissa)[0] < 1
