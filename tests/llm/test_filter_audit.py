"""The filter audit against a replay in plain Python."""

import random
from itertools import permutations

from test_text_operators import docs_of, plain

from fieldlark.llm.filter_audit import audit_filters


def expected(rows, labels):
    out, per = {}, []
    for i, t, s in rows:
        t = t or ""
        w = plain(t)
        same = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": same}
        q, tox = any(x[0] == i and x[1] == 1 for x in labels if i is not None), any(x[0] == i and x[2] == 1 for x in labels if i is not None)
        per.append((s or "", {k for k in fails if fails[k]}, q, tox))
    for part in {p[0] for p in per}:
        mine = [p for p in per if p[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = list(mine)
            for k, x in enumerate(o):
                gone = [p for p in left if x in p[1]]
                before = [p for p in mine if x in p[1] and not any(p is y for y in left)]
                left = [p for p in left if x not in p[1]]
                total[x] += len(gone)
                out[part, "".join(o), k + 1] = [len(left), len(gone), len(before), sum(p[1] == {x} for p in mine), sum(p[2] for p in gone), sum(p[3] for p in gone), x]
        for key, v in out.items():
            if key[0] == part and isinstance(v[-1], str):
                v[-1] = total[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_against_replay(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "gämma", "DELTA", "x#y", "one", "two"]) + str(rng.randint(0, 400))
    rows = []
    for i in range(90):
        n = rng.choice([0, 5, 199, 200, 300])
        t = rng.choice([" ", "\n", "\x0b\t"]).join(rng.choice([word, lambda: "same", lambda: f"w{rng.randint(0, 999)}"])() for _ in range(n))
        rows.append((i, rng.choice([t, t, rows[-1][1] if rows else t]), rng.choice(["a", "b", None, ""])))
    long = " ".join(f"w{k}" for k in range(250))
    rows += [(None, long, "a"), (None, long, "a"), (100, long, "b"), (100, long, "b"), (101, long, "c"), (102, None, "c"), (103, "", "c"), (104, " \t\n", None), (105, "  " + "é" * 50_000 + " ", "d"), (106, "x " * 100_000, "d")]
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 107, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None), (999, 1, 1)]
    judged = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert got(audit_filters(docs_of(spark, rows), judged)) == expected(rows, labels)


def test_audit_of_strings_and_of_nothing(spark):
    named = spark.createDataFrame([("b", "t", "s"), ("a", "t", "s"), ("c", "u", "s")], "doc_id string, text string, source string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    out = got(audit_filters(named, labels))
    assert len(out) == 600 and out["s", "EABCD", 1][:5] == (2, 1, 0, 0, 1) and out["s", "AEBCD", 2][:3] == (0, 0, 1)
    assert audit_filters(named.where("false"), labels).count() == 0
