"""From raw documents to a training mix: each stage applies one operator to all that the one before kept.

Every row has its own decision: columns come along through the operators, or rows are joined
by a number written at the start of a stage, never by doc_id, which may be null or repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.llm.common import table
from fieldlark.llm.decontaminate import contaminated, find_contamination
from fieldlark.llm.line_dedup import drop_common_lines
from fieldlark.llm.mixing import mix_sources
from fieldlark.llm.near_dup import near_duplicates
from fieldlark.llm.quality import classify
from fieldlark.operators.lineage import Rounds


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _columns(docs: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``docs`` by their plain names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in but]


def _whole(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row): every row with all its columns in one, to come along through an operator."""
    return docs.select("doc_id", "text", F.struct(*_columns(docs)).alias("_row"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for every row, written once so that it stays, and the number's name."""
    row = _free(docs, "_row")
    return Rounds(docs.sparkSession).cut(docs.withColumn(row, F.monotonically_increasing_id())), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as junk or toxic go.

    Texts without words (null, empty, blank) are junk and go; texts of any length are scored
    whole; equal rows, and rows that share an id or have none, are judged each by their own
    text; an empty table stays empty; all columns come along, whatever their names.
    """
    scored = classify(_whole(docs), table(spark, sf_dir, "labels"), row_col="_row")
    return scored.where("keep").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go; so do documents that lost a line and of which nothing but blanks is left.

    A null text stays null, an empty one empty; ``n_chars`` is counted anew where a line
    went; rows that share an id count as one document for a line, rows without an id as one
    together, and each keeps its own text; an empty table stays empty; all other columns
    come along, whatever their names.
    """
    bare = _free(docs, "_no_text")
    kept = drop_common_lines(docs.select("doc_id", "text", F.struct(*_columns(docs, ("text",)), F.col("text").isNull().alias(bare)).alias("_row")), row_col="_row")
    changed = F.col("n_dropped") > 0
    out = kept.where(~changed | (F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != ""))
    new = {"text": F.when(~F.col(f"_row.{bare}"), F.col("text")), "n_chars": F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("_row.n_chars"))}
    return out.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, one without an id only where none has one.

    Texts without words are no copies of each other and all stay; of equal rows one stays;
    rows that share an id are judged each by their own text; an empty table stays empty; all
    columns come along, whatever their names.
    """
    keyed, row = _keyed(docs)
    classes, _ = near_duplicates(keyed, id_col=row)
    # classes of one row need no judging but are judged alike
    named = classes.select(row, "class_id").join(keyed.select(row, "doc_id"), row)
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))).alias("least"))
    return keyed.join(first.select(F.col("least.row").alias(row)), row, "left_semi").select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go.

    Texts without words have no hits and stay; texts of any length are searched whole; equal
    rows, and rows that share an id or have none, are judged each by their own text; an
    empty benchmark takes nothing, an empty table stays empty; all columns come along,
    whatever their names.
    """
    found = find_contamination(_whole(docs), table(spark, sf_dir, "benchmark"), id_col="_row")
    return found.where(~contaminated()).select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document that the mix takes, with its copies.

    Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; columns of these names
    that the documents have give way to them.  Texts without words are never taken; a null
    source is a source of its own; equal rows are documents of their own; an empty table
    stays empty; all other columns come along.
    """
    keyed, row = _keyed(docs)
    extra = ("size", "source_size", "target", "copies", "taken")
    mixed = mix_sources(keyed, row_col=row).where("copies > 0").select(row, *extra)
    return keyed.select(row, *_columns(docs, extra)).join(mixed, row).drop(row)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: The classifier is trained and the mix is drawn by hashes that SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    tables, docs = Rounds(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        read, docs = docs, tables.cut(stage(spark, docs, sf_dir))
        tables.drop(read)
    return docs
