"""Messages are written exactly once, whatever fails on the way."""

import json

import pytest
from pyspark.sql import functions as F

from fieldlark.streaming import sink


def test_a_failed_epoch_is_written_once(spark, tmp_path):
    sink.register(spark)
    inbox, out, marks, flag = (str(tmp_path / n) for n in ("in", "out", "marks", "fail"))
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(2).write.mode("append").parquet(inbox)
    open(flag, "w").close()

    @F.udf("string")
    def message(i):
        import os

        if i == 17 and os.path.exists(flag):
            raise RuntimeError("a lost executor")
        return json.dumps({"id": i, "text": 'é "quoted"'})

    def run():
        rows = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(inbox)
        q = rows.select(message("id").alias("message")).writeStream.format(sink.FORMAT).option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="a lost executor"):
        run()
    before = sink.committed(spark, out).count()
    assert 0 < before < 30
    (tmp_path / "fail").unlink()
    run()
    got = sorted(json.loads(r.message)["id"] for r in sink.committed(spark, out).collect())
    assert got == list(range(30))


def test_an_epoch_that_comes_again_changes_nothing(spark, tmp_path):
    writer = sink.MessageWriter(f"file://{tmp_path}/out")
    row = spark.createDataFrame([("a",)], "message string").first()
    assert sink.committed(spark, f"file://{tmp_path}/out").count() == 0
    writer.commit([writer.write(iter([row, row])), writer.write(iter([])), None], 0)
    again = [writer.write(iter([row]))]
    writer.commit(again, 0)
    writer.abort([writer.write(iter([row]))], 1)
    writer.commit([writer.write(iter([row]))], 1)
    assert [r.message for r in sink.committed(spark, f"file://{tmp_path}/out").collect()] == ["a"] * 3
    assert len(list((tmp_path / "out/messages").iterdir())) == 2  # nothing is left of what was not committed
