"""Filter interaction audit: every document replayed through every order of the filters (SQL functions only)."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.llm.common import cut

#: `[\x20\x09-\x0D]`: what parts words.
BLANK = "[\\x20\\x09-\\x0D]"
FILTERS = "ABCDE"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Per filter that looks at one text alone: does the text, of these words, fail it?"""
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * different.cast("bigint") < 50 * n.cast("bigint"),
        "C": 100 * capitals.cast("bigint") > 2 * F.char_length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def filter_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One narrow row per document: id, ``part``, ``fails`` (bit k set: fails filter k of ``FILTERS``), ``good``, ``toxic``.

    Whether a text repeats one of a smaller id is found by the 256-bit hash of whole texts.
    Plan: texts are read once, to a table of hashes and flags in the shared folder; the least
    id of each repeated text is found with map-side minima and joined back from a table,
    where AQE can split the copies of a hot text, as are the labels.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("words", F.array_remove(F.split("text", f"{BLANK}+"), ""))
    fails = sum((f.cast("int") * (1 << k) for k, f in enumerate(text_failures(F.col("text"), F.col("words")).values())), F.lit(0))
    seen = cut(base.select("id", "part", fails.alias("alone"), F.unhex(F.sha2("text", 256)).alias("h")))
    firsts = cut(seen.where("id is not null").groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "first"))
    judged = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    judged = cut(judged.agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t")))
    repeats = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    known = seen.join(firsts, "h", "left").select("id", "part", (F.col("alone") + repeats).alias("fails")).join(judged, "id", "left")
    return known.select("id", "part", "fails", (F.coalesce("q", F.lit(0)) == 1).alias("good"), (F.coalesce("t", F.lit(0)) == 1).alias("toxic"))


def audit_orders(flags: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) per document -> one row per part, order of the filters and step.

    Every document meets the 120 orders, which are broadcast, and each pair is exploded to its
    five steps.  The first step whose filter the document fails is where it is removed;
    counts per (part, order, step) are summed in every task before they are shuffled.
    """
    spark = flags.sparkSession
    orders = [("".join(o), [1 << FILTERS.index(x) for x in o]) for o in permutations(FILTERS)]
    orders = spark.createDataFrame([(k, name, bits) for k, (name, bits) in enumerate(orders)], "k int, filter_order string, bits array<int>").coalesce(1)
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(F.col("fails").bitwiseAND(F.col("bits")[k]) != 0, k + 1).otherwise(first)
    replayed = flags.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(orders.select("k", "bits"))).withColumn("first", first)
    steps = replayed.select("part", "k", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
    step, failing = F.col("at") + 1, F.col("fails").bitwiseAND(F.col("bit")) != 0
    removed = F.col("first") == step
    n = lambda when: F.sum(when.cast("bigint"))
    counted = steps.groupBy("part", "k", "at").agg(
        n(F.col("first") > step).alias("kept"),
        n(removed).alias("removed"),
        n(failing & (F.col("first") < step)).alias("redundant"),
        n(F.col("fails") == F.col("bit")).alias("unique_fails"),
        n(removed & F.col("good")).alias("good_lost"),
        n(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # 600 rows per part from here on
    named = counted.join(F.broadcast(orders.select("k", "filter_order")), "k").withColumn("filter", F.substring("filter_order", F.col("at") + 1, F.lit(1)))
    named = named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return named.select("part", "filter_order", (F.col("at") + 1).alias("step"), "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """How five filters interact: what each removes at each step of each of the 120 orders, per part.

    A fails texts under 200 words (`[^\\x20\\x09-\\x0D]+`), B texts with fewer than half of
    their words different, C texts with more than 2 % of `[A-Z]`, D texts with any of
    `#$%&*|`, E texts identical to that of a smaller id anywhere.  Per part, order and step
    (1-5): documents kept after it, removed by it, failing it but removed before, failing it
    alone, removed by it though labelled good or toxic, and ``shapley``, what the filter
    removes over all orders.

    Edge cases: a null text is an empty one, and fails A only; a null part is the empty
    string; a row without an id repeats nothing, is repeated by nothing and has no label;
    rows that share an id and a text do not repeat each other; an id with several labels is
    good (toxic) if any says so; parts without a removal have rows of zeros; an empty table
    gives an empty table; other columns are ignored.

    Plan: see ``filter_flags`` and ``audit_orders``; the result has 600 rows per part, its
    partial counts at most as many per part and task, so a hot part meets in no task.
    """
    return audit_orders(filter_flags(docs, labels, id_col, text_col, part_col))
