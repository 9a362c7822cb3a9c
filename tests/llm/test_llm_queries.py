"""The registered text queries against their DuckDB twins, and the pipeline against brute force."""

import os
import random
from collections import Counter

import pytest
from test_text_operators import classes_expected, folded, hits_expected, lines_expected, plain

from fieldlark.llm.quality import classify
from fieldlark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, _row string, `my.own col` string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def made_corpus():
    rng = random.Random(31)
    prose = lambda n: " ".join(f"{rng.choice('bdgklmnprst')}{rng.choice('aeiou')}{rng.choice('lnrs')}{rng.choice(['', 'ta', 'ro', 'mi', 'su'])}" for _ in range(n))
    passage = prose(40)
    rows = []
    for i in range(160):
        t = prose(rng.randint(20, 120))
        if i % 6 == 0:
            t = " ".join(w + rng.choice(["###", "%%%"]) for w in t.split())
        if i % 5 == 1:
            t = f"{t}\nShared FOOTER line\n\n  shared footer line "
        if i % 9 == 2 and i > 9:
            w = plain(rows[-3][1] or "x")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        if i % 16 == 5:
            t = f"{t} {passage.upper() if i % 32 == 5 else ', '.join(passage.split())}"
        rows.append((i, t))
    rows += [(None, prose(50)), (None, rows[4][1]), (7, prose(60)), (7, rows[7][1]), (900, None), (901, ""), (902, "shared footer line"), (903, prose(20_000))]
    return [(i, t, "en", None if k % 11 == 0 else f"s{k % 4}", len(t) if t is not None else None, 5, "mine", "too") for k, (i, t) in enumerate(rows)], passage


def key(rows):
    return Counter((r[0], r[1], r[2], r[3]) for r in rows)


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, passage = made_corpus()
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i, *_ in rows if i is not None and i % 2], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "!")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/stage{k}")
        left.append((before.collect(), docs.collect()))
        assert k == 4 or docs.columns == before.columns
        assert {(r._row, r["my.own col"]) for r in left[-1][1]} == {("mine", "too")}
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]

    # quality: exactly the rows that the classifier keeps, by text, for rows that share an id have their own
    given, got = left[0]
    keep = Counter((r.doc_id, r.keep) for r in classify(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect())
    assert Counter((r.doc_id, True) for r in got) == Counter({k: n for k, n in keep.items() if k[1]}) and not key(got) - key(given)
    assert not [r for r in got if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 6 == 0 and "###" in r.text and "%%%" in r.text]

    # lines: brute force per row; rows of which blanks are left go if they lost a line
    given, got = left[1]
    marked = [((i, k), r.text) for k, (i, r) in enumerate((r.doc_id, r) for r in given)]
    seen = {}
    for (i, _), t in marked:
        for line in (t or "").split("\n"):
            seen.setdefault(line.strip(" \t\n\x0b\x0c\r").lower(), set()).add(i)
    bad = {k for k, ids in seen.items() if k and len(ids) >= 10}
    want = Counter()
    for r in given:
        lines = (r.text or "").split("\n")
        kept = "\n".join(x for x in lines if x.strip(" \t\n\x0b\x0c\r").lower() not in bad)
        changed = len(kept.split("\n")) < len(lines) or kept != (r.text or "")
        if not changed or plain(kept):
            want[r.doc_id, kept if r.text is not None else None, len(kept) if changed else r.n_chars] += 1
    assert bad == {"shared footer line"} and Counter((r.doc_id, r.text, r.n_chars) for r in got) == want
    assert lines_expected([(r.doc_id, r.text) for r in given], 10)  # the operator's own brute force agrees on the count
    # near copies: of each class the row of least id stays
    given, got = left[2]
    classes, _ = classes_expected([(k, r.text) for k, r in enumerate(given)], 0.8)
    groups = {}
    for k, r in enumerate(given):
        groups.setdefault(classes[k], []).append(r)
    assert len(got) == len(groups) < len(given)
    stay = Counter(min(((r.doc_id is None, r.doc_id or 0) for r in g)) for g in groups.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == stay and not key(got) - key(given)

    # decontamination
    given, got = left[3]
    hit = {k for k, n, h, _ in hits_expected([(k, r.text) for k, r in enumerate(given)], [(1, passage)]) if h and 20 * h >= n}
    assert key(got) == key([r for k, r in enumerate(given) if k not in hit]) and hit
    assert not any(" ".join(folded(passage)[:13]) in " ".join(folded(r.text)) for r in got if len(folded(r.text)) < 260)

    # mixing: its own columns stand in place of those of the same name
    given, got = left[4]
    assert not key(got) - key(given) and all(r.taken == r.copies * r["size"] > 0 and r["size"] == len(plain(r.text)) and r.copies <= 3 for r in got)
    taken, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    longest = max(len(plain(r.text)) for r in given)
    assert all(abs(taken[s] - target[s]) <= longest for s in target)


def test_pipeline_of_empty_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns) and out.count() == 0
