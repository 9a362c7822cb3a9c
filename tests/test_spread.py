"""Few small rows that become many: their work is spread over tasks before it grows."""

from pyspark.sql import functions as F

from fieldlark.operators import fusion
from fieldlark.sources import tables


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count > 0").count()


def test_ticks_are_fused_and_held_in_many_tasks(spark):
    rows = [(float(t), f"link_{k}", 0.5, 0.9, 0.8) for t in range(40) for k in range(3)]
    found = spark.createDataFrame(rows, "ts double, link_id string, activity double, health_score double, confidence double").groupBy("ts", "link_id").agg(*[F.avg(n).alias(n) for n in ("activity", "health_score", "confidence")])
    field = fusion.fuse(tables.default_links(spark), tables.grid(spark), found)
    assert field.count() == 40 * 1600 and tasks(field) > 1
    assert tasks(fusion.persist(field)) > 1


def test_ticks_without_known_links_and_evidence_without_a_number(spark):
    rows = [(0.0, "x", 1.0, 1.0, 1.0), (1.0, "link_0", 0.0, 1.0, 1.0), (2.0, "link_0", None, 1.0, 1.0), (2.0, "link_1", 0.5, 1.0, 1.0)]
    found = spark.createDataFrame(rows, "ts double, link_id string, activity double, health_score double, confidence double")
    got = fusion.fuse(tables.default_links(spark), tables.grid(spark), found).groupBy("ts").agg(F.count("*"), F.max("n_active"), F.max("value")).orderBy("ts").collect()
    assert [tuple(r)[:3] for r in got] == [(0.0, 1600, 0), (1.0, 1600, 0), (2.0, 1600, 1)] and got[0][3] == got[1][3] == 0 < got[2][3]
