"""Line dedup: drop lines whose key occurs in many documents (SQL functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def _keys(text: Column, min_chars: int) -> Column:
    """Per line of ``text``: the 128-bit hash of its key, null for keys too short to count."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(BLANKS))
        return F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g")))

    return F.transform(F.split(F.translate(text, UPPER, LOWER), "\n"), key)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, row_col: str | None = None) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents.

    A text is split at each newline; a key is the line with blanks stripped at both
    ends and A-Z lower-cased.  Returns one row per input row: ``id_col``, ``text``
    (kept lines joined by a newline), ``n_lines`` (before dropping), ``n_dropped``, and
    ``row_col`` of the row, if given.

    Edge cases: a null or empty text is one empty line; an empty key is never
    dropped (``min_chars`` >= 1); a line repeated inside a document counts that
    document once, as do rows that share an id; rows with a null id are one document
    together, for counting; an empty table gives an empty table; other columns are ignored.

    Plan: texts are read once for the hashes of each document's lines, a narrow table in the
    shared folder.  They are counted with map-side aggregation, the common ones joined
    back by hash, where AQE can split a hot line, and each document gets its own short
    list of common hashes by one join on the 128-bit hash of its text, so rows that share an id,
    or have none, do not meet.  Keys are compared by 128-bit hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    prints = F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), prints.alias("print"), *([F.col(row_col).alias("row")] if row_col else []))
    keyed = cut(base.select("id", "print", F.explode(F.array_compact(F.array_distinct(_keys(F.col("text"), max(1, min_chars))))).alias("k")).select("id", "print", "k.h", "k.g"))
    nameless = F.coalesce(F.max(F.col("id").isNull().cast("int")), F.lit(0))
    common = cut(keyed.groupBy("h", "g").agg((F.count_distinct("id") + nameless).alias("n")).where(F.col("n") >= min_docs).select("h", "g"))
    # what a text loses is its own, whatever its id and however many rows have it
    per_text = cut(keyed.join(common, ["h", "g"], "left_semi").groupBy(F.col("print").alias("of")).agg(F.collect_set(F.struct("h", "g")).alias("bad")))
    found = base.join(per_text, F.col("print") == F.col("of"), "left").drop("of", "print")
    lines = F.split("text", "\n")
    flags = F.transform(_keys(F.col("text"), max(1, min_chars)), lambda h: F.coalesce(F.array_contains(F.col("bad"), h), F.lit(False)))
    flagged = found.withColumn("flags", F.when(F.col("bad").isNotNull(), flags))
    # pairwise, not by index: a filter on the result makes Catalyst put the flags in place of their name
    kept = F.array_join(F.zip_with(lines, "flags", lambda line, bad: F.when(~bad, line)), "\n")
    return flagged.select(
        F.col("id").alias(id_col),
        F.when(F.col("flags").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.when(F.col("flags").isNull(), F.lit(0)).otherwise(F.size(F.filter("flags", lambda x: x))).cast("bigint").alias("n_dropped"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )
