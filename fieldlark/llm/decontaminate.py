"""Benchmark decontamination with an FM-index per shard of training documents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import released, returns
from fieldlark.llm.fm_index import FMIndex
from fieldlark.operators.lineage import Rounds

#: Windows that one pass over the documents searches for (held by the driver and broadcast, some
#: 50 MB); a larger benchmark takes more passes.  Windows of an item that stay together.
BLOCK_WINDOWS, PIECE = 200_000, 1024
#: Text of the documents that share one index.
SHARD_BYTES = 8 << 20
FOUND = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start:int,end:int>>"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, in UTF-8."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


class Patterns(NamedTuple):
    """Distinct windows of one length, and the items that have each: those of window k are
    ``items[first[k] : first[k + 1]]``."""

    rows: np.ndarray
    first: np.ndarray
    items: np.ndarray


class Phrases(NamedTuple):
    """The test phrases as symbol sequences, by length."""

    vocab: dict[bytes, int]
    patterns: dict[int, Patterns]
    names: list[str]

    @classmethod
    def of(cls, benchmark: list[tuple[str, str | None]], size: int) -> Phrases:
        vocab: dict[bytes, int] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        names = sorted({i for i, _ in benchmark})
        number = {n: k for k, n in enumerate(names)}
        for item, text in benchmark:
            w = np.array([vocab.setdefault(x, len(vocab) + 1) for x in words_of(text)], dtype=np.int32)
            if len(w):
                length = min(size, len(w))
                found.setdefault(length, []).append((np.lib.stride_tricks.sliding_window_view(w, length), number[item]))
        patterns = {}
        for length, parts in found.items():
            rows, inverse = np.unique(np.concatenate([r for r, _ in parts]), axis=0, return_inverse=True)
            owners = np.repeat([k for _, k in parts], [len(r) for r, _ in parts])
            pair = np.unique(inverse.ravel() * np.int64(len(names)) + owners)
            patterns[length] = Patterns(rows, np.searchsorted(pair, np.arange(len(rows) + 1) * np.int64(len(names))), (pair % len(names)).astype(np.int32))
        return cls(vocab, patterns, names)


def _search(phrases: Phrases, symbols: list[np.ndarray]) -> list[tuple[np.ndarray, list[int]]]:
    """Per document (its words as symbols, 0 for words of no phrase): hit flags and items.

    The index holds the runs of phrase words that are at least as long as the shortest
    phrase - no occurrence can lie elsewhere - and each distinct run once.
    """
    results = [(np.zeros(len(s), dtype=bool), []) for s in symbols]
    if not phrases.patterns:
        return results
    shortest = min(phrases.patterns)
    runs: dict[bytes, list[tuple[int, int]]] = {}
    for d, s in enumerate(symbols):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (s > 0).astype(np.int8), [0]))))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= shortest:
                runs.setdefault(s[a:b].tobytes(), []).append((d, int(a)))
    if not runs:
        return results
    parts, begins, at = [], [], 0
    for key in runs:
        part = np.frombuffer(key, dtype=np.int32)
        begins.append(at)
        parts += [part, np.zeros(1, dtype=np.int32)]
        at += len(part) + 1
    index = FMIndex(np.concatenate(parts), len(phrases.vocab))
    begins, where = np.array(begins), list(runs.values())
    for length, (patterns, first, items) in phrases.patterns.items():
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        sizes = (hi - lo)[hit]
        rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        places, which = index.locate(rows), np.repeat(hit, sizes)
        run = np.searchsorted(begins, places, "right") - 1
        for r, offset, p in zip(run.tolist(), (places - begins[run]).tolist(), which.tolist()):
            for d, a in where[r]:
                results[d][0][a + offset : a + offset + length] = True
                results[d][1].extend(items[first[p] : first[p + 1]].tolist())
    return results


def _spans(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of about SHARD_BYTES of text."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(ids):
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + SHARD_BYTES, "right")))
            yield ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)
            lo = hi


def _scan(docs: DataFrame, shared: Broadcast) -> DataFrame:
    def run(batches):
        p = shared.value
        get = p.vocab.get
        for ids, texts in _shards(batches):
            symbols, counts = [], []
            for t in texts:
                w = words_of(t.as_py())
                counts.append(len(w))
                symbols.append(np.fromiter((get(x, 0) for x in w), dtype=np.int32, count=len(w)))
            found = _search(p, symbols)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(counts, pa.int64()),
                    pa.array([int(f.sum()) for f, _ in found], pa.int64()),
                    pa.array([sorted({p.names[k] for k in items}) for _, items in found], pa.list_(pa.string())),
                    pa.array([_spans(f) for f, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return docs.mapInArrow(released(run), returns(FOUND, id=docs.schema["id"].dataType))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", phrase_col: str = "text", size: int = 13
) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    A window is ``size`` consecutive words of an item; a shorter item that has words is
    one window.  Per shard of documents an FM-index is built over the words; windows
    are backward-searched through wavelet-tree ranks, occurrences located from sampled
    suffix positions, and overlapping ones merged to removal spans.

    Returns one row per document: id, ``n_words``, ``n_hit``, ``item_ids`` (sorted, as
    strings), ``spans`` (word positions, end excluded).

    Edge cases: null and empty texts have no words and no hits; an item without words
    has no window; items that share an id are one item; a null item id is listed as an
    empty string; empty tables give no hits or no rows; rows with equal ids stay separate
    rows; other columns are ignored.

    Plan: no shuffle for a benchmark of up to BLOCK_WINDOWS windows.  A larger one is cut into
    pieces that overlap by a window, and searched block by block: the driver holds one
    block at a time, a pass writes the rows that it hits to the shared folder, and these
    are joined to their documents by id and hash of the text.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = _pieces(benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(phrase_col).alias("text")), size)
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    blocks = max(1, int(-(-total // BLOCK_WINDOWS)))
    sc, tables = docs.sparkSession.sparkContext, None

    def block(k: int) -> Broadcast:
        mine = pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else pieces
        return sc.broadcast(Phrases.of([(r.item, r.text) for r in mine.select("item", "text").collect()], size))

    if blocks == 1:
        return _scan(d, block(0)).withColumnRenamed("id", id_col)
    tables = Rounds(docs.sparkSession)
    pieces = tables.cut(pieces)
    keyed = d.select(F.struct("id", F.xxhash64("text").alias("print")).alias("id"), "text")
    for k in range(1, blocks):
        shared = block(k)
        tables.add("hits", _scan(keyed, shared).where("n_hit > 0").select("id", "item_ids", "spans"))
        shared.destroy()
    more = tables.read("hits").groupBy("id").agg(F.flatten(F.collect_list("item_ids")).alias("more_items"), F.flatten(F.collect_list("spans")).alias("more_spans"))
    first = _scan(keyed, block(0))
    both = first.join(more.withColumnRenamed("id", "of"), F.col("id.id").eqNullSafe(F.col("of.id")) & F.col("id.print").eqNullSafe(F.col("of.print")), "left")
    items = F.array_sort(F.array_distinct(F.concat("item_ids", F.coalesce("more_items", F.expr("cast(array() as array<string>)")))))
    spans = _merged(F.array_sort(F.concat("spans", F.coalesce("more_spans", F.expr(_NO_SPANS)))))
    both = both.select(F.col("id.id").alias(id_col), "n_words", items.alias("item_ids"), spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + (s["end"] - s["start"]))
    return both.select(id_col, "n_words", n_hit.alias("n_hit"), "item_ids", "spans")


_NO_SPANS = "cast(array() as array<struct<start:int,end:int>>)"


def _merged(spans: Column) -> Column:
    """Sorted spans with those that meet made one."""

    def widen(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (last["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.expr(_NO_SPANS), widen)


def _pieces(items: DataFrame, size: int) -> DataFrame:
    """(item, text, windows): the words of items in pieces of up to PIECE windows, each once."""
    words = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    w = items.where("text is not null").select("item", words.alias("w")).where("size(w) > 0").withColumn("length", F.least(F.lit(size), F.size("w")))
    w = w.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"), F.lit(PIECE))))
    w = w.withColumn("w", F.slice("w", F.col("at") + 1, F.col("length") + PIECE - 1))
    return w.select("item", F.array_join("w", " ").alias("text"), (F.size("w") - F.col("length") + 1).alias("windows")).distinct()


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The rule: at least one hit word, and at least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
