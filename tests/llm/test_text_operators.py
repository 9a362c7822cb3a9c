"""Each operator against a brute-force version, on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from fieldlark.llm import decontaminate, line_dedup, mixing, near_dup, substring_dedup
from fieldlark.llm.common import uniform

DOC = "doc_id bigint, text string, source string, id string, words int, grp int"
FOLD = {i: i + 32 for i in range(65, 91)}


def docs_of(spark, rows):
    """(doc_id, text[, source]) with columns whose names operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "a", "x", 1, 2) for r in rows], DOC).repartition(3)


def plain(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def some_texts(seed, n, words=120, vocab=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.4:
            base = list(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = f"edit{rng.randint(0, 9)}"
            out.append(base)
        else:
            out.append([f"w{rng.randint(0, vocab)}é" for _ in range(rng.randint(words // 2, words))])
    return [" ".join(w) for w in out]


# line dedup


def lines_expected(rows, least):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    seen = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            seen.setdefault(key(line), set()).add(i)
    bad = {k for k, d in seen.items() if k and len(d) >= least}
    out = []
    for i, t, *_ in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in bad]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rows = [(i, f"Common LINE \nown {i}\n\n  common line\t\nÉté {i % 2}") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, "common line"), (24, " \x0b "), (25, "x" * 100_000 + "\ncommon line"), (3, "again\ncommon line")]
    got = line_dedup.drop_common_lines(docs_of(spark, rows), min_docs=6)
    assert sorted([tuple(r) for r in got.collect()], key=str) == lines_expected(rows, 6)


def test_line_dedup_counts_a_document_once(spark):
    rows = [(1, "a\na\na"), (1, "a"), (2, "b")]
    got = {(r.doc_id, r.n_dropped) for r in line_dedup.drop_common_lines(docs_of(spark, rows), min_docs=2).collect()}
    assert got == {(1, 0), (2, 0)}


def test_line_dedup_of_one_id_many_times(spark):
    """10^5 rows of one id, and as many of none, each with lines of its own: no row carries those of others."""
    many = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, 1).cast("bigint").alias("doc_id"), F.concat(F.lit("shared\nown "), F.col("id").cast("string")).alias("text"))
    few = spark.range(2, 12).select(F.col("id").alias("doc_id"), F.lit("shared\nx").alias("text"))
    got = line_dedup.drop_common_lines(many.unionByName(few)).groupBy("n_dropped", F.col("text").startswith("own ")).count().collect()
    assert {tuple(r) for r in got} == {(1, True, 100_000), (2, False, 10)}


def test_line_dedup_rows_without_id_are_one_document(spark):
    named = spark.createDataFrame([("null", "a"), (None, "a"), (None, "a\nb"), ("x", "b")], "doc_id string, text string")
    got = [(r.doc_id, r.text) for r in line_dedup.drop_common_lines(named, min_docs=2).collect()]
    assert sorted(got, key=str) == sorted([("null", ""), (None, ""), (None, ""), ("x", "")], key=str)
    got = [(r.doc_id, r.text) for r in line_dedup.drop_common_lines(named, min_docs=3).collect()]
    assert sorted(got, key=str) == sorted([("null", "a"), (None, "a"), (None, "a\nb"), ("x", "b")], key=str)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert line_dedup.drop_common_lines(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert near_dup.near_duplicates(none)[0].count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs_of(spark, [(1, "a b")]), bench).first().n_hit == 0


# benchmark decontamination


def hits_expected(rows, items, size=13):
    wins = {}
    for item, text in items:
        w = folded(text)
        for i in range(max(0, len(w) - size) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for i, t, *_ in rows:
        w, hit, found = folded(t), set(), set()
        for length in {len(k) for k in wins}:
            for k in range(len(w) - length + 1):
                got = wins.get(tuple(w[k : k + length]))
                if got:
                    found |= got
                    hit.update(range(k, k + length))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [None, 40])
def test_decontamination(spark, monkeypatch, limit):
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randint(0, 30)}" for _ in range(n)]
    items = [(k, " ".join(words(rng.randint(14, 30)))) for k in range(8)] + [(50, "One two THREE"), (51, ""), (52, None), (53, "!?"), (54, "solo"), (50, "Another, short one"), (None, "nameless item here")]
    rows = []
    for i in range(40):
        w = words(rng.randint(0, 60))
        if i % 3 == 0:
            w += folded(items[i % 8][1])[rng.randint(0, 3) :] + words(5)
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else ", ".join(w)))
    rows += [(90, None), (91, ""), (92, "one, two... three"), (93, "solo"), (94, "solo " * 3000 + "nameless item here"), (3, rows[3][1]), (95, "one two two three")]
    if limit:
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", limit)
        monkeypatch.setattr(decontaminate, "PIECE", 5)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_contamination(docs_of(spark, rows), bench).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got], key=str) == hits_expected(rows, items)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


# mixing


def test_mixing_targets_and_sizes(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 80)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for i in range(3000)]
    rows += [(5000, None, "s0"), (5001, "", "empty"), (5002, "a b\tc\x0bd", None), (5002, "a b\tc\x0bd", None)]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(plain(t))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(size.values())), list(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.remove(s)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 80
    again = mixing.mix_sources(docs_of(spark, list(reversed(rows)))).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_mixing_draws_in_pareto_order(spark):
    """Copies against the definition: whole copies, then the odds of a uniform number over the inclusion odds, in order."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * (rng.choice([1, 2, 4, 900]) if i % 50 == 0 else rng.randint(1, 60))), f"s{i % 7 % 3}") for i in range(2500)] + [(9000 + i, "w w", "tiny") for i in range(3)]
    df = docs_of(spark, rows)
    got = {r.doc_id: r for r in mixing.mix_sources(df).collect()}
    u = {r.doc_id: r.u for r in df.select("doc_id", uniform(F.col("doc_id"), mixing.word_count(F.col("text")), seed=7).alias("u")).collect()}
    size = {i: len(t.split()) for i, t, _ in rows}
    for source in ("s0", "s1", "s2", "tiny"):
        mine = [i for i, _, s in rows if s == source]
        target, lo, hi = got[mine[0]].target, 0.0, 10.0
        for _ in range(200):  # expected copies are min(3, c * root of size), their words the target
            c = (lo + hi) / 2
            lo, hi = (c, hi) if sum(min(3, c * size[i] ** 0.5) * size[i] for i in mine) < target else (lo, c)
        e = {i: min(3.0, hi * size[i] ** 0.5) for i in mine}
        whole = {i: int(e[i] + 1e-9) for i in mine}
        room = target - sum(whole[i] * size[i] for i in mine)
        p = {i: max(e[i] - whole[i], 0.0) for i in mine}
        ranked = sorted((u[i] / (1 - u[i]) / (p[i] / (1 - p[i])), i) for i in mine if p[i] > 1e-9)
        drawn, run = set(), 0
        for _, i in ranked:
            if run + size[i] / 2 > room:
                break
            drawn.add(i)
            run += size[i]
        want = {i: whole[i] + (i in drawn) for i in mine}
        assert sum(got[i].copies != want[i] for i in mine) <= 1  # a draw on the edge of the last place
        assert [i for i in mine if got[i].copies not in (whole[i], whole[i] + 1)] == []


def test_mixing_without_words(spark):
    assert [r.taken for r in mixing.mix_sources(docs_of(spark, [(1, None), (2, "  ")])).collect()] == [0, 0]


def test_mixing_many_sources_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 50}") for i in range(400)]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    assert len(got) == 400 and sum(r.taken for r in got) == pytest.approx(sum(i % 7 + 1 for i in range(400)), rel=0.1)


# substring dedup


def repeats_expected(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = plain(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = plain(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [6, 10, 50])
def test_substring_dedup(spark, window):
    texts = some_texts(window, 60, words=150, vocab=400)
    rows = [(i * 7 % 61, t) for i, t in enumerate(texts)]
    passage = " ".join(f"p{k}" for k in range(70))
    rows += [(100 + i, f"head{i} {passage} tail{i}") for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, passage), (204, "same " * 500), (205, "same " * 400), (203, passage), (206, "é x " * 80)]
    got = substring_dedup.remove_repeats(docs_of(spark, rows), window=window).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got], key=str) == repeats_expected(rows, window)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_dedup_in_any_row_order():
    """The passes of a group agree although its rows come in another order each time, as from several executors."""
    rng, window, parts = random.Random(12), 10, 5
    texts = some_texts(3, 80, words=90, vocab=300)
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[3]), (7, None), (7, texts[60]), (90, None), (91, "")]
    groups = {g: [r for r in rows if r[0] % 3 == g] for g in range(3)}

    def table(g):
        mine = rng.sample(groups[g], len(groups[g]))
        return pa.table({"grp": pa.array([g] * len(mine)), "id": pa.array([i for i, _ in mine], pa.int64()), "text": pa.array([t for _, t in mine], pa.string())})

    def exchanged(tables, step):
        sent = pa.concat_tables(tables)
        sent = sent.take(pa.array(rng.sample(range(sent.num_rows), sent.num_rows))).sort_by([("part", "ascending"), ("kind", "ascending")])
        return pa.Table.from_batches(list(step(iter(sent.to_batches()))))

    def to(told, g):
        return told.filter(pc.equal(told.column("grp"), g))

    key = lambda g: (pa.scalar(g),)
    hits = exchanged([substring_dedup._send(parts, window)(key(g), table(g)) for g in groups], substring_dedup._probe)
    later = exchanged([substring_dedup._extend(parts, window)(key(g), table(g), to(hits, g)) for g in groups], substring_dedup._compare)
    got = pa.concat_tables([substring_dedup._remove(parts, window)(key(g), table(g), to(later, g)) for g in groups]).to_pylist()
    want = repeats_expected(rows, window)
    assert sorted([(r["id"], r["n_words"], r["n_removed"], r["text"]) for r in got], key=str) == want and sum(w[2] for w in want) > 500


def test_substring_dedup_keeps_rows_without_id(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"a {passage}"), (2, f"{passage} b"), (None, f" c\t{passage}  é"), (None, passage), (None, passage), (None, None), (None, " \n")]
    got = substring_dedup.remove_repeats(docs_of(spark, rows)).collect()
    want = [(1, 61, 0, f"a {passage}"), (2, 61, 60, "b"), (None, 62, 0, f"c {passage} é"), (None, 60, 0, passage), (None, 60, 0, passage), (None, 0, 0, ""), (None, 0, 0, "")]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got], key=str) == sorted(want, key=str)
    assert all(r.spans == [] for r in got if r.doc_id is None)
    # a table without any ids
    assert substring_dedup.remove_repeats(docs_of(spark, rows[2:])).count() == 5


# near duplicates


def grams(text, size=5):
    w = folded(text)
    return {tuple(w[k : k + size]) for k in range(max(0, len(w) - size) + 1)} if w else set()


def classes_expected(rows, threshold):
    sets = {}
    for i, t, *_ in rows:
        sets[i] = frozenset(grams(t))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize("pairwise", [2, 16])
def test_near_duplicates(spark, pairwise):
    rows = list(enumerate(some_texts(9, 80, words=200, vocab=3000)))
    rng = random.Random(2)
    base = [f"b{k}" for k in range(150)]
    for i in range(120):  # a large group of copies that differ, some by much
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(w).upper() if i % 2 else " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "..."), (2003, "two words"), (2004, "Two, words!"), (2005, rows[3][1]), (2006, rows[3][1] + "!"), (2007, " ".join(base * 40))]
    got, links = near_dup.near_duplicates(docs_of(spark, rows), pairwise=pairwise)
    want, sets = classes_expected(rows, 0.8)
    assert {r.doc_id: r.class_id for r in got.collect()} == want
    for r in links.collect():
        assert r.j == pytest.approx(len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) and r.j >= 0.8


def test_links_of_small_groups_are_counted(spark):
    base = [f"b{k}" for k in range(100)]
    rows = [(i, " ".join(base[:50] + [f"n{i}"] + base[51:])) for i in range(4)] + [(10, " ".join(base[:50] + ["n0"] + base[51:]))]
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in near_dup.near_duplicates(docs_of(spark, rows))[0].collect()}
    assert got == {0: (0, 0, 3), 1: (1, 0, 3), 2: (2, 0, 3), 3: (3, 0, 3), 10: (0, 0, 3)}


@pytest.mark.parametrize("pairwise, block_grams", [(16, None), (16, 3000), (2, 900)])
def test_links_of_large_groups_are_counted(spark, monkeypatch, pairwise, block_grams):
    if block_grams:
        monkeypatch.setattr(near_dup, "LEAST_GRAMS", block_grams)
        monkeypatch.setattr(near_dup, "MOST_GRAMS", block_grams)
    rng, rows = random.Random(8), []
    for group, n, edits in ((0, 90, 2), (1, 60, 7), (2, 3, 1)):  # two groups above PAIRWISE, one of them on the threshold, and a small one
        base = [f"g{group}w{k}" for k in range(150)]
        for i in range(n):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
            rows.append((1000 * group + i, " ".join(w)))
    rows += [(5000, rows[7][1]), (5001, rows[100][1]), (5002, None), (5003, "nothing like it")]
    want, sets = classes_expected(rows, 0.8)
    copy = {i: min(k for k in sets if sets[k] == sets[i]) if sets[i] else i for i in sets}
    texts = sorted(i for i in sets if sets[i] and copy[i] == i)
    near = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    links_of = Counter(i for pair in near for i in pair)
    got, links = near_dup.near_duplicates(docs_of(spark, rows), pairwise=pairwise)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.collect()} == {i: (copy[want[copy[i]]], links_of[copy[i]]) for i in sets}
    listed = [(r.a, r.b) for r in links.collect()]
    assert len(listed) == len(set(listed)) and set(listed) == near


def test_near_duplicates_that_share_an_id(spark):
    """Every row is judged by its own text."""
    one, two, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, one), (1, two), (1, two), (2, one + " more"), (3, two + " more"), (4, other), (None, two), (None, other + " more"), (0, one.upper())]
    got, links = near_dup.near_duplicates(docs_of(spark, rows))
    want = [(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 0, 1), (3, 1, 1), (4, 4, 1), (None, 1, 1), (None, 4, 1), (0, 0, 1)]
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in got.collect()], key=str) == sorted(want, key=str)
    assert {(r.a, r.b) for r in links.collect()} == {(0, 2), (1, 3), (4, None)}


@pytest.mark.parametrize("pairwise", [2, 16])
def test_near_duplicates_without_ids(spark, pairwise):
    """Rows without an id are linked as all others are; a class of none but such has no id."""
    rng = random.Random(6)
    base, lone = [f"b{k}" for k in range(100)], [f"n{k}" for k in range(100)]
    edited = lambda w, n: " ".join([*w[: (at := rng.randrange(90))], f"x{rng.random()}", *w[at + n :]])
    rows = [(None, edited(base, 1)) for _ in range(12)] + [(7, edited(base, 1)), (5, edited(base, 1))] + [(None, edited(lone, 1)) for _ in range(6)] + [(None, None), (None, rows_text := edited(lone, 1)), (None, rows_text)]
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    got = sorted(((r.class_id, r.n_links) for r in near_dup.near_duplicates(docs_of(spark, rows), pairwise=pairwise)[0].collect()), key=str)
    plain = near_dup.near_duplicates(docs_of(spark, numbered), pairwise=pairwise)[0].collect()
    want = sorted(((5 if r.class_id == 0 else None, r.n_links) for r in plain), key=str)
    assert got == want and sum(c == 5 for c, _ in got) == 14


def test_ids_of_strings(spark):
    text = " ".join(f"w{k}" for k in range(40))
    named = spark.createDataFrame([("b2", text), ("a1", text + " more"), ("c3", "other")], "doc_id string, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in near_dup.near_duplicates(named)[0].collect()}
    assert got == {("b2", "a1", 1), ("a1", "a1", 1), ("c3", "c3", 0)}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        substring_dedup.remove_repeats(named).collect()
    assert line_dedup.drop_common_lines(named).where("doc_id = 'a1'").count() == mixing.mix_sources(named.withColumn("source", F.lit("s"))).where("doc_id = 'a1'").count() == 1


def test_band_plan():
    bands, rows = near_dup.plan_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


def test_digest_columns(spark):
    assert hashlib.sha256(b"").hexdigest() == docs_of(spark, [(1, "")]).selectExpr("sha2(text, 256) h").first().h
