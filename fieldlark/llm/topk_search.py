"""Exact top-k inner-product search with the threshold algorithm over sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.operators.lineage import Rounds

#: Queries that one pass over the candidates answers, and candidates whose lists one task sorts at a time.
QUERY_BLOCK, SHARD = 4096, 1 << 15
FIRST_DEPTH = 16


def threshold_top_k(lists: np.ndarray, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows for one query, ties to the smaller id.

    ``lists[:, j]`` are the rows in rising order of component j; a list is read from the
    end that helps the query.  Sorted access goes down all lists together, every row
    met is scored in full once, and the search stops when the score of the frontier -
    no unseen row can have more - is below the kth score.  A frontier that ties goes
    on, for the unseen row may have the smaller id.
    """
    n = len(ids)
    used = np.flatnonzero(query)
    if not len(used):  # all scores are 0
        best = np.sort(ids[ids != own])[:k]
        return best, np.zeros(len(best), dtype=vectors.dtype)
    down = query[used] > 0
    q, seen = query[used], np.zeros(n, dtype=bool)
    top_ids, top_scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=vectors.dtype)
    depth, step = 0, FIRST_DEPTH
    while depth < n:
        upto = min(n, depth + step)
        block = np.where(down, lists[n - upto : n - depth, used][::-1], lists[depth:upto, used])
        before = seen.copy()
        seen[block.ravel()] = True
        new = np.flatnonzero(seen & ~before)
        new = new[ids[new] != own]
        top_ids = np.concatenate((top_ids, ids[new]))
        top_scores = np.concatenate((top_scores, _long(vectors[new] @ query)))
        order = np.lexsort((top_ids, -top_scores))[:k]
        top_ids, top_scores = top_ids[order], top_scores[order]
        frontier = _long((vectors[block[-1], used] * q).sum())
        depth, step = upto, step * 2
        if len(top_ids) == k and frontier < top_scores[-1]:
            break
    return top_ids, top_scores


def _long(x):
    """Sums beyond a long count as its bounds; only those of ``object`` kind can be."""
    return x if np.asarray(x).dtype == np.float64 else np.clip(x, -(2**63), 2**63 - 1)


def _numbers(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix; exact in doubles where products stay below 2**53."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _search(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """queries: by dimension the ids and the matrix."""

    def answer(ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        qids, qs = queries[vectors.shape[1]]
        largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(qs).max(initial=0)) * max(1, vectors.shape[1])
        kind = np.float64 if largest < 2**53 else object
        v, q = vectors.astype(kind), qs.astype(kind)
        lists = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        found = [threshold_top_k(lists, v, ids, q[i], int(qids[i]), k) for i in range(len(qids))]
        sizes = [len(a) for a, _ in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(qids, sizes), pa.int64()),
                pa.array(np.concatenate([a for a, _ in found]), pa.int64()),
                pa.array([int(s) for _, b in found for s in b], pa.int64()),
            ],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                if int(dim) not in queries:
                    continue
                part = b if (sizes == dim).all() else b.filter(pa.array(sizes == dim))
                for lo in range(0, part.num_rows, SHARD):
                    piece = part.slice(lo, SHARD)
                    have = held.setdefault(int(dim), [])
                    have.append((piece.column(0).to_numpy(zero_copy_only=False), _numbers(piece.column(1))))
                    if sum(len(x) for x, _ in have) >= SHARD:
                        yield from answer(*map(np.concatenate, zip(*have)))
                        held[int(dim)] = []
        for have in held.values():
            if have:
                yield from answer(*map(np.concatenate, zip(*have)))

    return run


def scaled(vector: str, scale: float = 1024.0):
    """Components as floor(scale * x), x as double; null for a vector that takes no part."""
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(sound, F.transform(x, lambda v: F.floor(v * scale)))


def top_k(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100) -> DataFrame:
    """The k highest inner products of every query row with all other rows.

    Queries are the rows whose id is divisible by ``every``; components are
    floor(1024 * x).  Returns (query_id, rank, vec_id, score), ties to the smaller id.

    Edge cases: vectors that are null or hold null or non-finite components take no
    part, nor do rows with a null id; a query meets only vectors of its own length; rows
    that share the query's id are its own, and the least of their vectors asks; fewer
    candidates give fewer rows; an empty table gives an empty table; other columns are
    ignored; components and scores beyond a long count as its bounds; an id that is no
    whole number is refused by the cast to bigint.

    Plan: queries go out in blocks of about QUERY_BLOCK, a pass over the candidates each.
    The driver holds one block at a time, for with more than one each pass writes its
    result to the shared folder before the next begins.  A task sorts the lists of up to
    SHARD candidates and sends k rows per query, which are merged by query.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), scaled(vector_col).alias("v")).where("v is not null")
    tables = Rounds(spark)
    asked = tables.cut(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))

    def answers(b: int) -> tuple[DataFrame, Broadcast]:
        got = (asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else asked).orderBy("id").toArrow().combine_chunks()
        sizes = pa.compute.list_value_length(got.column("v")).to_numpy()
        by_dim = {}
        for dim in np.unique(sizes).tolist():
            part = got.filter(pa.array(sizes == dim)).combine_chunks()
            by_dim[dim] = part.column("id").to_numpy(), part.column("v").combine_chunks().flatten().to_numpy().reshape(len(part), dim)
        shared = spark.sparkContext.broadcast(by_dim)
        found = rows.mapInArrow(lambda batches: _search(shared.value, k)(batches), "query_id bigint, vec_id bigint, score bigint")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), shared

    if blocks == 1:
        return answers(0)[0]
    for b in range(blocks):
        found, shared = answers(b)
        tables.add("found", found)
        shared.destroy()
    return tables.read("found")
