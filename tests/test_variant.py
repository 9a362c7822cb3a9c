"""Free-form properties as VARIANT, and faults counted in one pass."""

import json

from pyspark.sql import functions as F

from fieldlark.functions import predicates as V
from fieldlark.functions import variant
from fieldlark.operators.lineage import Rounds
from fieldlark.operators.quarantine import split_once

TEXTS = ['{"k": 1}', '{"k": 1.5, "deep": {"list": [1, {"x": "y"}]}}', '{"k": "text"}', "[1, 2]", "7", "null", "", '{"k": ', None, '{"k": null, "é": "ü\\"q"}']


def test_properties(spark, tmp_path):
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(TEXTS)], "i int, props string, grp int").withColumn("v", variant.parsed(F.col("props")))
    df.write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    got = {r.i: r for r in back.select("i", variant.document(F.col("v")).alias("doc"), variant.field(F.col("v"), "$.k", "double").alias("k"), variant.field(F.col("v"), "$.deep.list[1].x", "string").alias("x")).collect()}
    for i, t in enumerate(TEXTS):
        try:
            want = json.loads(t)
        except (TypeError, ValueError):
            want = None
        assert (None if got[i].doc is None else json.loads(got[i].doc)) == want
    assert [got[i].k for i in (0, 1, 2, 3, 9)] == [1.0, 1.5, None, None, None] and got[1].x == "y" and got[0].x is None
    kinds = {r.grp: r.schema for r in variant.schemas(back.where("i < 2"), "v", ["grp"]).collect()}
    assert kinds[0] == "OBJECT<k: DECIMAL(1,0)>" and kinds[1].startswith("OBJECT<deep: OBJECT<list: ARRAY<")


def test_faults_are_counted_once(spark):
    passes = spark.sparkContext.accumulator(0)

    def seen(x):
        passes.add(1)
        return x

    rows = [("a", 1.0, [1.0], [1.0]), ("", 1.0, [1.0], [1.0]), ("b", None, [1.0], [1.0]), ("c", 1.0, [], []), ("d", 1.0, [1.0, float("inf")], [1.0, 2.0]), ("e", 1.0, [1.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "link_id string, ts double, amplitude array<double>, phase array<double>").withColumn("link_id", F.udf(seen)("link_id"))
    sound, faulty, counts = split_once(df, V.frame_faults(), Rounds(spark))
    assert [r.link_id for r in sound.collect()] == ["a"] and "fault" not in sound.columns and passes.value == len(rows)
    by = {r.fault: r["count"] for r in faulty.groupBy("fault").count().collect()}
    assert {k: n for k, n in counts.items() if n and k != "sound"} == by and counts["sound"] == 1 and sum(counts.values()) == len(rows)
    assert split_once(df.where("false"), V.frame_faults(), Rounds(spark))[2]["sound"] == 0
