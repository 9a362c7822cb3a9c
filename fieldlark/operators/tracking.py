"""Detections, tracks and the entity tracker."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.operators.fold import fold_sorted


def distance(x1: Column, y1: Column, x2: Column, y2: Column, z1: Column | None = None, z2: Column | None = None) -> Column:
    flat = F.hypot(x1 - x2, y1 - y2)
    return flat if z1 is None else F.sqrt(flat * flat + (z1 - z2) * (z1 - z2))


def is_confirmed(state: str = "state") -> Column:
    return F.col(state) == "CONFIRMED"


def is_active(state: str = "state") -> Column:
    return F.col(state).isin("TENTATIVE", "CONFIRMED")


def predict(track: DataFrame, dt: float, axes: str = "xy") -> DataFrame:
    """Positions after dt at constant velocity; tracks without one stay."""
    return track.withColumns({a: F.col(a) + F.coalesce(F.col(f"velocity.v{a}"), F.lit(0.0)) * dt for a in axes})


def detection_to_2d(d: DataFrame) -> DataFrame:
    """Without z; of a box (x, y, z, x, y, z) the four numbers of the plane."""
    box = F.when(F.col("bbox").isNotNull(), F.array(*[F.get("bbox", F.lit(i)) for i in (0, 1, 3, 4)]))
    return d.drop("z").withColumn("bbox", box)


def track_to_2d(t: DataFrame) -> DataFrame:
    history = F.transform("history", lambda h: F.struct(h["t"].alias("t"), h["x"].alias("x"), h["y"].alias("y")))
    velocity = F.when(F.col("velocity").isNotNull(), F.struct(F.col("velocity.vx").alias("vx"), F.col("velocity.vy").alias("vy")))
    return t.drop("z").withColumn("history", history).withColumn("velocity", velocity)


def candidates(clusters: list[dict], scale: tuple[float, float], offset: tuple[float, float]) -> list[dict]:
    """World position (of the index itself, without half a cell), radius and activity of clusters."""
    out = []
    for c in clusters:
        out.append(
            {
                "x": offset[0] + c["centroid_row"] * scale[0],
                "y": offset[1] + c["centroid_col"] * scale[1],
                "radius": max(0.3, min(2.0, math.sqrt(c["size"]) * scale[0] * 0.5)),
                "activity": min(1.0, c["total_intensity"] / max(c["size"], 1)),
            }
        )
    return out


class FreeCandidates:
    """Candidates of a tick in a grid of cells as wide as the reach: the nearest one nearer than
    that lies in the nine cells around a point."""

    def __init__(self, found: list[dict], reach: float):
        self.found, self.reach, self.cells = found, reach, {}
        for i, c in enumerate(found):
            self.cells.setdefault(self._cell(c["x"], c["y"]), []).append(i)

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return math.floor(x / self.reach), math.floor(y / self.reach)

    def nearest(self, x: float, y: float) -> tuple[float, int | None]:
        """Distance and index of the nearest free candidate, the first on a tie; None if none is in reach."""
        a, b = self._cell(x, y)
        near = [i for u in (a - 1, a, a + 1) for v in (b - 1, b, b + 1) for i in self.cells.get((u, v), ())]
        d, i = min(((math.hypot(x - self.found[i]["x"], y - self.found[i]["y"]), i) for i in near), default=(math.inf, None))
        return (d, i) if d < self.reach else (math.inf, None)

    def take(self, i: int) -> None:
        self.cells[self._cell(self.found[i]["x"], self.found[i]["y"])].remove(i)

    def left(self) -> list[int]:
        return sorted(i for cell in self.cells.values() for i in cell)


def track(state: tuple[int, list[dict]] | None, found: list[dict], now: float, reach: float = 1.5, stability_scale: float = 0.5) -> tuple[tuple[int, list[dict]], list[dict]]:
    """One tick of the tracker.

    Entities in their order each take the nearest free candidate nearer than ``reach`` (the
    first on a tie); those that find none are gone, candidates left over are new.
    """
    next_id, entities = state or (1, [])
    free, kept = FreeCandidates(found, reach), []
    for e in entities:
        d, i = free.nearest(e["x"], e["y"])
        if i is None:
            continue
        free.take(i)
        c = found[i]
        moved = d > 0.3 or abs(c["activity"] - e["activity"]) > 0.2
        kept.append(
            e | {"x": c["x"], "y": c["y"], "z": 0.0, "radius": c["radius"], "activity": c["activity"], "stability": 0.7 * max(0.0, 1 - d * stability_scale) + 0.3 * e["stability"], "last_change": now if moved else e["last_change"], "frames_tracked": e["frames_tracked"] + 1}
        )
    for i in free.left():
        c = found[i]
        kept.append({"id": next_id, "x": c["x"], "y": c["y"], "z": 0.0, "activity": c["activity"], "stability": 0.5, "last_change": now, "radius": c["radius"], "frames_tracked": 1})
        next_id += 1
    return (next_id, kept), kept


ENTITIES = "entities array<struct<id:bigint,x:double,y:double,z:double,activity:double,stability:double,last_change:double,radius:double,frames_tracked:bigint>>"


def track_rooms(clusters: DataFrame, scale: tuple[float, float], offset: tuple[float, float], reach: float = 1.5, stability_scale: float = 0.5) -> DataFrame:
    """(room, ts, clusters array) -> (room, ts, entities): rooms in parallel, ticks in order."""

    def step(state, row):
        state, kept = track(state, candidates(row["clusters"] or [], scale, offset), row["ts"], reach, stability_scale)
        return state, {"entities": [dict(e) for e in kept]}

    return fold_sorted(clusters, ["room"], ["ts"], step, ENTITIES)
