"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlark.llm.chat import END, START, format_chats, parse, rows_as_events, unescape
from fieldlark.llm.common import table
from fieldlark.llm.decontaminate import contaminated, find_contamination
from fieldlark.llm.filter_audit import audit_filters
from fieldlark.llm.html_extract import extract_text
from fieldlark.llm.hyperminhash import near_duplicate_components
from fieldlark.llm.line_dedup import drop_common_lines
from fieldlark.llm.mixing import mix_sources
from fieldlark.llm.near_dup import near_duplicates
from fieldlark.llm.periodic_runs import periodic_runs
from fieldlark.llm.quality import classify
from fieldlark.llm.sql import ORACLE_SQL
from fieldlark.llm.substring_dedup import remove_repeats
from fieldlark.llm.token_counts import count_tokens, read_vocabulary
from fieldlark.llm.topk_search import top_k

#: A vocabulary file of the box; a parameter of the operator, never part of this repository.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary(VOCABULARY))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "n_links")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _read_back(batches):
    """Digests of what a formatted conversation says, from the format alone."""
    import hashlib

    import pyarrow as pa

    for b in batches:
        cols = b.to_pydict()
        turns, losses, chars, sizes = [], [], [], []
        for text, spans in zip(cols["formatted"], cols["loss"]):
            turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parse(text)).encode()).hexdigest())
            trained = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            losses.append(hashlib.sha256(trained.encode()).hexdigest())
            chars.append(len(trained))
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(turns), pa.array(chars, pa.int64()), pa.array(losses), pa.array(sizes, pa.int64())],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(rows_as_events(rows))
    return chats.mapInArrow(_read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    n, g = F.size("w").cast("bigint"), F.floor(F.col("h") / 10)
    docs = docs.withColumn("planted", (F.col("h") % 10 == 0) & (n > 0)).withColumn("a", F.when(F.col("planted"), g % n))
    docs = docs.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    first = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.when(F.col("planted"), F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get("w", first(i).cast("int"))), " ")).otherwise(F.array_join("w", " "))
    found = periodic_runs(docs.select("doc_id", text.alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n", "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_benchmark_decontamination,
        op3_token_counts,
        op4_source_mixing,
        op5_near_duplicates,
        op6_substring_dedup,
        op7_quality_classifier,
        op8_chat_formatting,
        op9_line_dedup,
        op10_exact_top_k,
        op11_filter_audit,
        op12_periodic_runs,
        op13_hyperminhash_near_dedup,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
