"""Fusion of link evidence onto the floor grid: kernels, shape, confidence, persistence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.config import ServerConfig
from fieldlark.operators.fold import dealt
from fieldlark.operators.lineage import Rounds

SOURCE = "geometry_fusion_ph2"
TICK = ("ts",)


def kernels(links: DataFrame, cells: DataFrame, resolution: float) -> DataFrame:
    """(link_id, i, j, k): how much a link sees of a cell, at most 1 per link.

    A cell counts by its distance to the segment, its excess path and its overshoot past
    the ends.  Links are a dimension table: it is the small side of the join, and the
    result is as large as links times cells.
    """
    g = links.select("link_id", F.col("tx.x").alias("tx"), F.col("tx.y").alias("ty"), F.col("rx.x").alias("rx"), F.col("rx.y").alias("ry"))
    g = g.withColumn("length", F.sqrt((F.col("rx") - F.col("tx")) ** 2 + (F.col("ry") - F.col("ty")) ** 2))
    g = g.withColumn("length", F.when(F.col("length") < 1e-9, F.raise_error(F.lit("a link has no length")).cast("double")).otherwise(F.col("length")))
    r = cells.crossJoin(F.broadcast(g))
    dx, dy, length = F.col("rx") - F.col("tx"), F.col("ry") - F.col("ty"), F.col("length")
    along = ((F.col("x") - F.col("tx")) * dx + (F.col("y") - F.col("ty")) * dy) / (length * length)
    inside = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    px, py = F.col("tx") + inside * dx, F.col("ty") + inside * dy
    perp = F.sqrt((F.col("x") - px) ** 2 + (F.col("y") - py) ** 2)
    d_tx = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
    d_rx = F.sqrt((F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2)
    excess = F.greatest(F.lit(0.0), d_tx + d_rx - length)
    outside = F.when(along < 0, -along).when(along > 1, along - 1).otherwise(F.lit(0.0)) * length
    s_perp = F.greatest(F.lit(0.75 * resolution), 0.05 * length)
    s_out = F.greatest(F.lit(resolution), 0.08 * length)
    k = F.exp(-0.5 * (perp / s_perp) ** 2) * F.exp(-0.5 * (excess / s_perp) ** 2) * F.exp(-0.5 * (outside / s_out) ** 2)
    r = r.select("link_id", "i", "j", k.alias("k"))
    return r.withColumn("k", F.col("k") / F.max("k").over(Window.partitionBy("link_id")))


class KernelCache:
    """Kernels by link id, each computed once and written to the shared folder.

    As in a running system, a link that comes again with another geometry keeps its kernel;
    ``forget`` drops it.  What is held on the driver is the ids of links.
    """

    def __init__(self, cells: DataFrame, resolution: float):
        self.cells, self.resolution, self.computed = cells, resolution, 0
        self._tables = Rounds(cells.sparkSession)
        self._known: set[str] = set()

    def get(self, links: DataFrame) -> DataFrame:
        """(link_id, i, j, k) of ``links``."""
        asked = {r.link_id for r in links.select("link_id").distinct().collect()}
        new = sorted(asked - self._known)
        if new:
            self._tables.add("kernels", kernels(links.where(F.col("link_id").isin(new)), self.cells, self.resolution))
            self._known |= set(new)
            self.computed += 1
        return self._tables.read("kernels").where(F.col("link_id").isin(sorted(asked)))

    def forget(self) -> None:
        self._tables.forget(0)
        self._known = set()


def metadata(gated: DataFrame, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, source, frame_count, link_ids): the links that gave a fused field, in order."""
    ids = F.array_sort(F.collect_list(F.when(F.col("strength") > 0, F.col("link_id"))))
    return gated.groupBy(*by).agg(ids.alias("link_ids")).select(*by, F.lit(SOURCE).alias("source"), F.lit(1).alias("frame_count"), "link_ids")


def gate(links: DataFrame, evidence: DataFrame, c: ServerConfig, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, link_id, strength, health, confidence): evidence with its strength.

    Links without evidence are left out; unhealthy or idle ones have strength 0.
    """
    e = evidence.join(F.broadcast(links.select("link_id")), "link_id", "left_semi")
    return e.select(*by, "link_id", _strength(c).alias("strength"), "health_score", "confidence")


def _strength(c: ServerConfig) -> Column:
    above = F.col("activity") - c.min_activity
    return F.when((F.col("health_score") < c.min_health) | (above <= 0), F.lit(0.0)).otherwise(above * F.col("health_score") * F.col("confidence"))


def link_weights(gated: DataFrame, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, link_weights, active_links): the strength of every link with evidence, and those above 0."""
    entries = F.array_sort(F.collect_list(F.struct("link_id", "strength")))
    return gated.groupBy(*by).agg(F.map_from_entries(entries).alias("link_weights"), F.array_sort(F.collect_list(F.when(F.col("strength") > 0, F.col("link_id")))).alias("active_links"))


def kernel_arrays(kernel: DataFrame, cells: list[tuple[int, int]]) -> dict[str, np.ndarray]:
    """Kernels by link, an array over ``cells`` (in their order) each: as many numbers as links times cells."""
    at = {c: n for n, c in enumerate(cells)}
    packed = kernel.groupBy("link_id").agg(F.collect_list(F.struct("i", "j", "k")).alias("cells"))
    out = {}
    for r in packed.collect():
        k = np.full(len(cells), np.nan)
        for x in r.cells:
            if (x.i, x.j) in at:
                k[at[x.i, x.j]] = x.k
        if np.isnan(k).any() or len(r.cells) > len({(x.i, x.j) for x in r.cells}):
            raise ValueError(f"the kernel of link {r.link_id} must have one number for every cell")
        out[r.link_id] = k
    return out


#: Cells of a batch that a task fuses or steps before it hands them on.
BATCH_CELLS = 1 << 16


def fuse(links: DataFrame, cells: DataFrame, evidence: DataFrame, c: ServerConfig = ServerConfig(), kernel: DataFrame | None = None, by: tuple[str, ...] = TICK) -> DataFrame:
    """(by, i, j, value, confidence, n_active) of each tick on its own, without persistence.

    ``by`` names a tick: its time, and the room where there are many with the same links.

    Evidence is shuffled by tick; a task takes one tick after the other and makes all its cells
    from the kernels, which every task has as arrays.  No cell is shuffled.
    """
    kernel = kernels(links, cells, c.field_resolution) if kernel is None else kernel
    floor = sorted((r.i, r.j) for r in cells.select("i", "j").collect())
    arrays = kernel_arrays(kernel, floor)
    i, j = (np.array([x[n] for x in floor], dtype=np.int32) for n in (0, 1))
    known = evidence.join(F.broadcast(links.select("link_id").distinct().withColumn("_known", F.lit(True))), "link_id", "left")
    live = (_strength(c) > 0) & F.col("_known")
    for name in by:
        live = live & F.col(name).isNotNull()
    found = F.struct("link_id", _strength(c).cast("double").alias("strength"), F.col("health_score").cast("double").alias("health_score"), F.col("confidence").cast("double").alias("confidence"))
    ticks = dealt(known, *by).groupBy(*by).agg(F.array_sort(F.collect_list(F.when(live, found))).alias("live"))
    full = T.StructType([*(T.StructField(f.name, f.dataType) for f in ticks.schema if f.name in by), *(T.StructField(n, T.IntegerType()) for n in ("i", "j")), *(T.StructField(n, T.DoubleType()) for n in ("value", "confidence")), T.StructField("n_active", T.IntegerType())])

    def run(batches):
        reference, zero = sum(arrays.values()), np.zeros(len(floor))
        step = max(1, BATCH_CELLS // max(1, len(floor)))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                made = []
                for live in part.column(part.num_columns - 1).to_pylist():
                    seen = [e for e in live if e["link_id"] in arrays]
                    made.append((*_mix(arrays, seen, np.array([e["strength"] for e in live]), reference, c), len(live)) if seen else (zero, zero, 0))
                n = part.num_rows
                of = pa.array(np.repeat(np.arange(n), len(floor)))
                value, sure = (pa.array(np.concatenate([m[x] for m in made])) for x in (0, 1))
                active = pa.array(np.repeat(np.array([m[2] for m in made], dtype=np.int32), len(floor)))
                yield pa.RecordBatch.from_arrays([*(part.column(x).take(of) for x in range(len(by))), pa.array(np.tile(i, n)), pa.array(np.tile(j, n)), value, sure, active], names=full.names)

    return ticks.select(*by, "live").mapInArrow(run, full)


def _bounded(x: np.ndarray) -> np.ndarray:
    """Between 0 and 1; what is not a number is above all numbers, as in SQL."""
    return np.fmin(np.maximum(x, 0.0), 1.0)


def _mix(kernel: dict[str, np.ndarray], live: list[dict], strength: np.ndarray, reference: np.ndarray, c: ServerConfig) -> tuple[np.ndarray, np.ndarray]:
    """Values and confidences of all cells from the evidence of links with a kernel; ``strength`` is that of all live links."""
    k = np.stack([kernel[e["link_id"]] for e in live])
    n = len(strength)
    s, h, conf = (np.array([e[x] for e in live])[:, None] for x in ("strength", "health_score", "confidence"))
    w = s / max(strength.sum(), 1e-9)
    linear, square = (w * k).sum(0), (w * k * k).sum(0)
    shape = (1 - c.log_fusion_weight) * linear + c.log_fusion_weight * np.exp((w * np.log(np.clip(k, 1e-9, 1))).sum(0))
    conflict = np.zeros_like(linear)
    if n >= 2:
        shape = _bounded(shape) ** (1 + c.sharpening * (n - 1))
        conflict = _bounded(np.sqrt(np.maximum(square - linear * linear, 0)) / np.maximum(linear, 1e-9))
    raw = shape * strength.mean()
    value = _bounded(raw / np.maximum(1.0, raw.max()))
    kh, khc = (k * h).sum(0), (k * h * conf).sum(0)
    coverage = _bounded(kh / np.maximum(reference, 1e-9))
    return value, _bounded(coverage * khc / np.maximum(kh, 1e-9) * (1 - 0.5 * conflict))


def fuse_tick(kernel: dict[str, np.ndarray], found: list[dict], c: ServerConfig = ServerConfig()) -> tuple[np.ndarray, np.ndarray, list[tuple[str, float]]]:
    """One tick of ``fuse``: values and confidences of all cells, and the strength of every link with evidence.

    ``kernel``: an array over the cells per link; ``found``: link_id, activity, health_score, confidence.
    """
    known = sorted((e for e in found if e["link_id"] in kernel), key=lambda e: e["link_id"])
    strength = [0.0 if e["health_score"] < c.min_health else max(e["activity"] - c.min_activity, 0.0) * e["health_score"] * e["confidence"] for e in known]
    live = [e | {"strength": s} for e, s in zip(known, strength) if s > 0]
    weights = [(e["link_id"], s) for e, s in zip(known, strength)]
    if not live:
        zero = np.zeros_like(next(iter(kernel.values())))
        return zero, zero, weights
    return *_mix(kernel, live, np.array([e["strength"] for e in live]), sum(kernel.values()), c), weights


def hold_tick(state: tuple[np.ndarray, np.ndarray, np.ndarray], value: np.ndarray, c: ServerConfig = ServerConfig()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hold_step`` of all cells at once."""
    f = c.decay * state[0] + (1 - c.decay) * value
    count = np.where(f >= c.enter_threshold, state[1] + 1, 0)
    return f, count, (count >= c.persistence) | (state[2] & (f >= c.exit_threshold))


def hold_step(state: tuple[float, int, bool], value: float, c: ServerConfig) -> tuple[float, int, bool]:
    """One tick of a cell: decayed value, ticks above enter, active."""
    f = c.decay * state[0] + (1 - c.decay) * value
    count = state[1] + 1 if f >= c.enter_threshold else 0
    active = count >= c.persistence or (state[2] and f >= c.exit_threshold)
    return f, count, active


#: Strips of cells, each stepped as arrays in one task.
STRIPS = 32


class _Strip:
    """The cells of a strip, by their place in its arrays; a cell that comes first at a tick starts then."""

    def __init__(self):
        self.at: dict[tuple[int, int], int] = {}
        self.state = np.zeros(0), np.zeros(0, dtype=int), np.zeros(0, dtype=bool)
        self.last: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def places(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.last is not None and np.array_equal(self.last[0], i) and np.array_equal(self.last[1], j):
            return self.last[2]
        places = np.array([self.at.setdefault(c, len(self.at)) for c in zip(i.tolist(), j.tolist())])
        more = len(self.at) - len(self.state[0])
        self.state = tuple(np.concatenate((x, np.zeros(more, dtype=x.dtype))) for x in self.state)
        self.last = i, j, places
        return places

    def step(self, i: np.ndarray, j: np.ndarray, value: np.ndarray, c: ServerConfig) -> tuple[np.ndarray, np.ndarray]:
        places = self.places(i, j)
        new = hold_tick(tuple(x[places] for x in self.state), value, c)
        for x, y in zip(self.state, new):
            x[places] = y
        return new[0], new[2]


def persist(instant: DataFrame, c: ServerConfig = ServerConfig(), keys: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """Decay, persistence and hysteresis of every cell in order of ts; at most one row a cell and tick.

    The output is 0 where the cell is not active; the state keeps the unmasked value.  What a task
    has of a tick is packed by strip of cells before the shuffle, pieces are sorted by strip and
    time, and each is one step on arrays: strips run in parallel, no cell's history is held, and the
    work grows in proportion to the ticks.
    """
    rooms = [k for k in keys if k not in ("i", "j")]
    rows = instant.select(*rooms, "ts", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("value"), F.col("confidence").cast("double").alias("confidence"))
    tick = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name in (*rooms, "ts")]
    cell = [("i", T.IntegerType()), ("j", T.IntegerType()), ("value", T.DoubleType()), ("confidence", T.DoubleType())]
    packed = T.StructType([*tick, T.StructField("_strip", T.IntegerType()), *(T.StructField(n, T.ArrayType(t)) for n, t in cell)])
    full = T.StructType([*tick, *(T.StructField(n, t) for n, t in cell), T.StructField("active", T.BooleanType())])
    grouped = ["_strip", *rooms]

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            strip = (batch.column("i").to_numpy().astype(np.int64) * 31 + batch.column("j").to_numpy()) % STRIPS
            codes = [batch.column(f.name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for f in tick]
            order = np.lexsort((strip, *codes))
            new = np.zeros(len(order), dtype=bool)
            new[0] = True
            for x in (strip, *codes):
                new[1:] |= x[order][1:] != x[order][:-1]
            starts = np.flatnonzero(new)
            at, cuts = pa.array(order), pa.array(np.append(starts, len(order)), pa.int32())
            first = pa.array(order[starts])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name).take(first) for f in tick), pa.array(strip[order[starts]], pa.int32()), *(pa.ListArray.from_arrays(cuts, batch.column(n).take(at)) for n, _ in cell)], names=packed.names
            )

    def run(batches):
        key, held = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                lengths = batch.column("i").value_lengths().to_numpy()
                ends = np.cumsum(lengths)
                i, j, value, sure = (batch.column(n).flatten().to_numpy(zero_copy_only=False) for n, _ in cell)
                shown, on = np.zeros(len(i)), np.zeros(len(i), dtype=bool)
                for now, a, b in zip(zip(*(batch.column(n).to_pylist() for n in grouped)), ends - lengths, ends):
                    if now != key:
                        key, held = now, _Strip()
                    f, on[a:b] = held.step(i[a:b], j[a:b], value[a:b], c)
                    shown[a:b] = np.where(on[a:b], f, 0.0)
                of = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
                columns = [pa.array(i), pa.array(j), pa.array(shown), pa.array(np.where(on, sure, 0.0)), pa.array(on)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(of) for f in tick), *columns], names=full.names)

    return dealt(rows.mapInArrow(pack, packed), *grouped).sortWithinPartitions(*grouped, "ts").mapInArrow(run, full)
