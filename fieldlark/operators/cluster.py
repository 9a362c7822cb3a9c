"""Connected regions of fields, and k-means on latent vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.operators.components import components
from fieldlark.operators.fold import fold_sorted
from fieldlark.operators.lineage import Rounds

NEIGHBOURS = {4: ((0, 1), (1, 0), (0, -1), (-1, 0)), 8: ((0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1))}

#: Cells along a side of a tile, which one task labels.
TILE = 256


def label_tile(i: np.ndarray, j: np.ndarray, connectivity: int) -> np.ndarray:
    """Per cell the index of the first cell, row by row, of its region among the given cells.

    Regions hook to the least root they touch and halve their paths, so the rounds grow with
    the logarithm of the cells, not with the length of a region.
    """
    order = np.lexsort((j, i))
    r, c = i[order] - i.min(), j[order] - j.min()
    grid = np.full((r.max() + 2, c.max() + 3), -1, dtype=np.int64)
    grid[r, c + 1] = np.arange(len(order))
    ends = []
    for a, b in NEIGHBOURS[connectivity]:
        if a > 0 or (a == 0 and b > 0):
            other = grid[r + a, c + 1 + b]
            ends.append((np.flatnonzero(other >= 0), other[other >= 0]))
    u, v = (np.concatenate(e) for e in zip(*ends))
    root = np.arange(len(order))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[root]
    return out


def label_regions(field: DataFrame, threshold: float = 0.0, connectivity: int = 4, keys: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """(keys, i, j, value, label): cells above the threshold with the least row-major cell of their region.

    The grid is cut into tiles of ``tile`` by ``tile`` cells, each labelled in one task.  Labels
    that touch across a border are the links of a graph, as large as the borders, whose
    components join the tiles; cells are relabelled by one join.  A field within one tile
    needs no more than that tile.  Repeated cells are not expected.
    """
    if connectivity not in NEIGHBOURS:
        raise ValueError("connectivity must be 4 or 8")
    tables = Rounds(field.sparkSession)
    cells = field.where(F.col("value") > threshold).select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("value"))
    cell = T.StructType([T.StructField(n, T.IntegerType()) for n in ("i", "j")])
    full = T.StructType([T.StructField(f.name, f.dataType) for f in cells.schema] + [T.StructField("label", cell)])

    def label(table: pa.Table) -> pa.Table:
        i, j = (table.column(n).to_numpy() for n in ("i", "j"))
        first = label_tile(i, j, connectivity)
        at = pa.StructArray.from_arrays([pa.array(i[first], pa.int32()), pa.array(j[first], pa.int32())], names=["i", "j"])
        return pa.table([*(table.column(n) for n in full.names[:-1]), at], names=full.names)

    ti, tj = F.floor(F.col("i") / tile).alias("_ti"), F.floor(F.col("j") / tile).alias("_tj")
    local = tables.cut(cells.groupBy(*keys, ti, tj).applyInArrow(label, full))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in NEIGHBOURS[connectivity]])
    rim = lambda n: (F.pmod(F.col(n), F.lit(tile)) == 0) | (F.pmod(F.col(n), F.lit(tile)) == tile - 1)
    name = F.struct(*keys, F.col("label.i").alias("_i"), F.col("label.j").alias("_j"))
    edge = local.where(rim("i") | rim("j")).select(*keys, "i", "j", name.alias("a"))
    near = edge.select(*keys, "i", "j", "a", F.explode(steps).alias("s")).select(*keys, F.col("i").alias("_fi"), F.col("j").alias("_fj"), (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "a")
    near = near.where((F.floor(F.col("i") / tile) != F.floor(F.col("_fi") / tile)) | (F.floor(F.col("j") / tile) != F.floor(F.col("_fj") / tile)))
    links = tables.cut(near.join(edge.select(*keys, "i", "j", F.col("a").alias("b")), [*keys, "i", "j"]).where("a < b").select("a", "b").distinct())
    if links.isEmpty():
        return local
    roots = components(links, tables).select(*[F.col(f"node.{k}").alias(k) for k in keys], F.struct(F.col("node._i").alias("i"), F.col("node._j").alias("j")).alias("label"), F.struct(F.col("root._i").alias("i"), F.col("root._j").alias("j")).alias("_root"))
    return local.join(roots, [*keys, "label"], "left").select(*keys, "i", "j", "value", F.coalesce("_root", "label").alias("label"))


def regions(labelled: DataFrame, min_size: int = 1, keys: tuple[str, ...] = (), pixels: bool = False) -> DataFrame:
    """Size, intensity, weighted centroid and box of every region, ranked by size, then by first cell."""
    v = F.col("value")
    aggs = [
        F.count(F.lit(1)).alias("size"), F.sum(v).alias("total_intensity"), F.sum(F.col("i") * v).alias("si"), F.sum(F.col("j") * v).alias("sj"), F.avg("i").alias("mi"), F.avg("j").alias("mj"),
        F.min("i").alias("row_min"), F.max("i").alias("row_max"), F.min("j").alias("col_min"), F.max("j").alias("col_max"),
    ]
    if pixels:
        aggs.append(F.array_sort(F.collect_list(F.struct(F.col("i").alias("r"), F.col("j").alias("c")))).alias("pixels"))
    g = labelled.groupBy(*keys, "label").agg(*aggs).where(F.col("size") >= min_size)
    weighted = F.col("total_intensity") > 0
    g = g.withColumn("centroid_row", F.when(weighted, F.try_divide("si", "total_intensity")).otherwise(F.col("mi")))
    g = g.withColumn("centroid_col", F.when(weighted, F.try_divide("sj", "total_intensity")).otherwise(F.col("mj")))
    order = Window.partitionBy(*keys).orderBy(F.col("size").desc(), "label")
    cols = ["centroid_row", "centroid_col", "size", "total_intensity", "row_min", "row_max", "col_min", "col_max"] + (["pixels"] if pixels else [])
    return g.select(*keys, F.row_number().over(order).alias("rank"), *cols)


def find_regions(field: DataFrame, threshold: float = 0.0, min_size: int = 1, connectivity: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    return regions(label_regions(field, threshold, connectivity, keys), min_size, keys)


def find_regions_per_tick(field: DataFrame, threshold: float = 0.0, min_size: int = 1, connectivity: int = 4, by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Regions of many small fields (by, i, j, value): one tick's active cells at a time in Python.

    A tick is one floor grid, which is its bound; large single grids take ``find_regions``.
    """
    out = "rank int, centroid_row double, centroid_col double, size bigint, total_intensity double"
    active = field.where(F.col("value") > threshold).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "j", "value"))).alias("cells"))

    def step(_, row):
        return None, {"found": tick_regions(row["cells"], min_size, connectivity)}

    found = fold_sorted(active, list(by), [], step, f"found array<struct<{out.replace(' ', ':').replace(',:', ',')}>>")
    return found.select(*by, F.explode("found").alias("r")).select(*by, "r.*")


def tick_regions(cells: list[dict], min_size: int, connectivity: int) -> list[dict]:
    left = {(c["i"], c["j"]): c["value"] for c in cells}
    out = []
    for start in sorted(left):
        if start not in left:
            continue
        values, todo = {start: left.pop(start)}, [start]
        while todo:
            i, j = todo.pop()
            for a, b in NEIGHBOURS[connectivity]:
                at = (i + a, j + b)
                if at in left:
                    values[at] = left.pop(at)
                    todo.append(at)
        if len(values) >= min_size:
            total, n = sum(values.values()), len(values)
            w = values if total > 0 else dict.fromkeys(values, 1.0)
            t = sum(w.values())
            out.append({"centroid_row": sum(i * v for (i, _), v in w.items()) / t, "centroid_col": sum(j * v for (_, j), v in w.items()) / t, "size": n, "total_intensity": float(total)})
    out.sort(key=lambda r: -r["size"])
    return [{"rank": k + 1} | r for k, r in enumerate(out)]


def count_regions(field: DataFrame, threshold: float = 0.0, min_size: int = 1) -> DataFrame:
    return find_regions(field, threshold, min_size).agg(F.count(F.lit(1)).alias("n"))


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row, the lowest index on a tie, and its squared distance; a few rows at a time."""
    near, d2 = np.empty(len(x), dtype=np.int32), np.empty(len(x))
    step = max(1, (1 << 20) // max(1, centers.size))
    for lo in range(0, len(x), step):
        gap = x[lo : lo + step, None, :] - centers[None]
        d = np.einsum("nkd,nkd->nk", gap, gap)
        near[lo : lo + step] = d.argmin(axis=1)
        d2[lo : lo + step] = d[np.arange(len(d)), near[lo : lo + step]]
    return near, d2


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float)
    if column.null_count or len(x) != dim * len(column):
        raise ValueError(f"vectors must have {dim} numbers, as the centres have")
    return x.reshape(-1, dim)


def assign(vectors: DataFrame, centers: np.ndarray, x: str = "x") -> DataFrame:
    """``vectors`` with the nearest centre (``cluster``, the lowest index on a tie) and its squared
    distance (``d2``).  Centres are broadcast: they are given by the caller, so bounded."""
    centers = np.asarray(centers, float)
    shared = vectors.sparkSession.sparkContext.broadcast(centers)
    full = T.StructType([*(T.StructField(f.name, f.dataType) for f in vectors.schema), T.StructField("cluster", T.IntegerType()), T.StructField("d2", T.DoubleType())])
    at = vectors.columns.index(x)

    def run(batches):
        for b in batches:
            near, d2 = _nearest(_matrix(b.column(at), shared.value.shape[1]), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(d2)], names=full.names)

    return vectors.mapInArrow(run, full)


def _sums(vectors: DataFrame, starts: dict[int, np.ndarray], x: str) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per set of centres: members and their sums per centre, and the cost, from one pass over the vectors.

    A task adds up its rows; what is shuffled is as many numbers as the centres have, per task.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(starts)
    dim = next(iter(starts.values())).shape[1]

    def run(batches):
        n = {name: np.zeros(len(c)) for name, c in shared.value.items()}
        total, cost = {name: np.zeros(c.shape) for name, c in shared.value.items()}, dict.fromkeys(shared.value, 0.0)
        for b in batches:
            rows = _matrix(b.column(0), dim)
            for name, c in shared.value.items():
                near, d2 = _nearest(rows, c)
                n[name] += np.bincount(near, minlength=len(c))
                np.add.at(total[name], near, rows)
                cost[name] += d2.sum()
        for name, c in shared.value.items():
            k = len(c)
            values = np.concatenate((n[name][:, None], total[name]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (k + 1), pa.int32()), pa.array(range(-1, k), pa.int32()), pa.array([[cost[name]], *values.tolist()], pa.list_(pa.float64()))], names=["of", "cluster", "v"])

    parts = vectors.select(x).mapInArrow(run, "of int, cluster int, v array<double>")
    rows = parts.select("of", "cluster", F.posexplode("v").alias("d", "v")).groupBy("of", "cluster", "d").agg(F.sum("v").alias("v")).collect()
    out = {name: (np.zeros(len(c)), np.zeros(c.shape), 0.0) for name, c in starts.items()}
    for r in rows:
        n, total, cost = out[r.of]
        if r.cluster < 0:
            out[r.of] = n, total, r.v
        elif r.d == 0:
            n[r.cluster] = r.v
        else:
            total[r.cluster, r.d - 1] = r.v
    return out


def lloyd(vectors: DataFrame, starts: dict[int, np.ndarray], max_iter: int = 100, tol: float = 1e-6, x: str = "x") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Lloyd's rounds for several sets of centres at once: name -> (centres before the last move, centres).

    Each round is one pass for all sets that still move; an empty cluster is the origin.
    """
    moving = {name: np.asarray(c, float) for name, c in starts.items()}
    done = {}
    for _ in range(max_iter):
        found = _sums(vectors, moving, x)
        for name, (n, total, _) in found.items():
            before = moving[name]
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], 0.0)
            done[name] = before, new
            moving[name] = new
            if np.sqrt(((new - before) ** 2).sum()) < tol:
                del moving[name]
        if not moving:
            break
    return done


def own_distance(centers: np.ndarray, x: str = "x") -> Column:
    """Squared distance to the centre of the row's ``cluster``."""
    all_ = F.array(*[F.array(*[F.lit(float(a)) for a in c]) for c in centers])
    return F.aggregate(F.zip_with(x, F.get(all_, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def inertia(assigned: DataFrame, centers: np.ndarray, x: str = "x") -> float:
    """Sum of squared distances to the assigned centres."""
    return assigned.agg(F.sum(own_distance(centers, x))).first()[0] or 0.0


def _uniform(seed: int, step: int, idx: str) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(step), F.col(idx)), 11).cast("double") + 0.5) / float(1 << 53)


def plus_plus(vectors: DataFrame, k: int, seed: int, idx: str = "idx", x: str = "x") -> np.ndarray:
    """k-means++ start: each next centre with odds in proportion to its squared distance, a pass each.

    A draw is the row with the least exponential number over its distance, from hashes of
    the row's index, so only the drawn rows reach the driver.
    """
    centers: list = []
    for step in range(k):
        rows = vectors.withColumn("w", F.lit(1.0)) if not centers else assign(vectors, np.array(centers), x).withColumnRenamed("d2", "w").where("w > 0")
        got = rows.select(x, F.col(idx), (-F.log(_uniform(seed, step, idx)) / F.col("w")).alias("e")).orderBy("e", idx).limit(1).collect()
        if not got:
            raise ValueError("fewer different vectors than clusters")
        centers.append(list(got[0][x]))
    return np.array(centers)


def oversampled(vectors: DataFrame, k: int, seed: int, idx: str = "idx", x: str = "x", rounds: int = 5, factor: float = 2.0) -> np.ndarray:
    """k-means|| start: some ``factor`` * k candidates a round, then the best k of them.

    In each of a few passes a row is drawn by hash with odds of factor * k times its share of
    the cost.  Candidates, some rounds * factor * k, are weighed by the rows nearest to them
    and reduced on the driver by weighted k-means++ and Lloyd's rounds.
    """
    first = vectors.select(x, idx, F.xxhash64(F.lit(seed), F.col(idx)).alias("h")).orderBy("h", idx).limit(1).collect()
    if not first:
        raise ValueError("fewer different vectors than clusters")
    found = np.array([list(first[0][x])], dtype=float)
    for step in range(rounds):
        cost = _sums(vectors, {0: found}, x)[0][2]
        if cost <= 0:
            break
        drawn = assign(vectors, found, x).where((F.col("d2") > 0) & (_uniform(seed, step, idx) < F.col("d2") * (factor * k / cost)))
        new = [list(r[x]) for r in drawn.select(x, idx).orderBy(idx).collect()]
        found = np.unique(np.concatenate((found, np.array(new, dtype=float).reshape(len(new), found.shape[1]))), axis=0)
    if len(found) < k:  # few different vectors, or few draws: one by one
        return plus_plus(vectors, k, seed, idx, x)
    weight, rng = _sums(vectors, {0: found}, x)[0][0], np.random.default_rng(seed)
    best = None
    for _ in range(5):
        centers = found[[rng.choice(len(found), p=weight / weight.sum())]]
        while len(centers) < k:
            odds = weight * _nearest(found, centers)[1]
            centers = np.concatenate((centers, found[[rng.choice(len(found), p=odds / odds.sum() if odds.sum() > 0 else None)]]))
        for _ in range(20):
            near, d2 = _nearest(found, centers)
            n = np.bincount(near, weights=weight, minlength=k)
            total = np.zeros_like(centers)
            np.add.at(total, near, found * weight[:, None])
            centers = np.where(n[:, None] > 0, total / np.maximum(n, 1e-300)[:, None], centers)
        cost = float((weight * _nearest(found, centers)[1]).sum())
        if best is None or cost < best[0]:
            best = cost, centers
    return best[1]


def k_means(vectors: DataFrame, k: int, centers: np.ndarray | None = None, max_iter: int = 100, tol: float = 1e-6, seed: int = 0, idx: str = "idx", x: str = "x", start: Callable = oversampled):
    """(assigned, centres): Lloyd's rounds over (idx, x).  The assignments returned were made
    before the last move of the centres.  Without centres ``start`` finds them."""
    if k < 1:
        raise ValueError("k must be positive")
    kept = vectors.select(idx, x).persist(StorageLevel.MEMORY_AND_DISK)
    before, centers = lloyd(kept, {k: start(kept, k, seed, idx, x) if centers is None else centers}, max_iter, tol, x)[k]
    kept.unpersist()
    return assign(vectors, before, x), centers


def latent_clusters(assigned: DataFrame, centers: np.ndarray, idx: str = "idx") -> DataFrame:
    """(cluster_id, center, size, indices), empty clusters too."""
    spark = assigned.sparkSession
    c = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(centers)], "cluster_id int, center array<double>")
    m = assigned.groupBy(F.col("cluster").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list(idx)).alias("indices"))
    none = F.expr("cast(array() as array<bigint>)")
    return c.join(m, "cluster_id", "left").select("cluster_id", "center", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("indices", none).alias("indices"))


def optimal_k(vectors: DataFrame, k_range: tuple[int, int] = (2, 10), starts: Callable[[int], np.ndarray] | None = None, **kw) -> tuple[int, list[float]]:
    """The k after which inertia falls most in relation to the inertia before; ``starts`` gives the
    first centres for a k.  All k move in the same passes."""
    n = vectors.count()
    lo, hi = max(1, k_range[0]), min(n, k_range[1])
    if lo > hi:
        return lo, []
    seed, idx, x = kw.get("seed", 0), kw.get("idx", "idx"), kw.get("x", "x")
    kept = vectors.select(idx, x).persist(StorageLevel.MEMORY_AND_DISK)
    first = {k: np.asarray(starts(k) if starts else oversampled(kept, k, seed, idx, x), float) for k in range(lo, hi + 1)}
    found = lloyd(kept, first, kw.get("max_iter", 100), kw.get("tol", 1e-6), x)
    curve = [inertia(assign(kept, found[k][0], x), found[k][1], x) for k in range(lo, hi + 1)]
    kept.unpersist()
    if len(curve) < 2:
        return lo, curve
    drops = [(a - b) / a if a > 0 else 0.0 for a, b in zip(curve, curve[1:])]
    return lo + 1 + int(np.argmax(drops)), curve
