"""The update loop: moves the world by steps, makes frames, fills a grid."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.config import ServerConfig
from fieldlark.functions.predicates import require_grid, require_objects
from fieldlark.operators import synthetic, world
from fieldlark.operators.lineage import Rounds
from fieldlark.sources import tables


class Made(NamedTuple):
    """What a run made: objects and frames per tick, and the grid after the last one (none without a grid)."""

    objects: DataFrame
    frames: DataFrame
    field: DataFrame | None


class UpdateLoop:
    """A world of objects that is carried on by ``dt`` a step.

    A run of n steps is one job over all its ticks; the loop keeps the objects where the run
    left them, so runs can be chained, objects put in and taken out between them.
    """

    def __init__(self, links: DataFrame, objects: DataFrame, dt: float = 0.05, grid: DataFrame | None = None, c: ServerConfig = ServerConfig(), seed: int = 42, noise: bool = False):
        if dt <= 0:
            raise ValueError("dt must be positive")
        self.links, self.objects, self.dt, self.config, self.seed, self.noise = links, require_objects(objects), dt, c, seed, noise
        self.grid = grid if grid is None else require_grid(grid)
        self.step_count, self.ticks = 0, 0
        self._tables = Rounds(links.sparkSession)

    @property
    def current_time(self) -> float:
        return self.ticks * self.dt

    def run(self, steps: int) -> Made:
        """``steps`` further ticks; ticks and times go on from those before."""
        if steps < 1:
            raise ValueError("steps must be positive")
        c, before = self.config, self.ticks
        moved = self._tables.cut(world.at_ticks(self.objects, steps, self.dt, start=before, with_velocity=True))
        shown = moved.drop("vx", "vy")
        rows = synthetic.generate(
            self.links, world.path_disturbance(self.links, shown), self.dt, n=c.num_subcarriers, fc=c.frequency_hz, bw=c.bandwidth_hz,
            sigma_amp=c.amplitude_noise if self.noise else 0.0, sigma_phase=c.phase_noise if self.noise else 0.0, seed=self.seed,
        )
        frames = tables.pack(rows, "amp", "phase").select("link_id", "ts", F.col("amp").alias("amplitude"), "phase")
        last = moved.where(F.col("tick") == before + steps)
        field = None if self.grid is None else world.field_at(self.grid, last.drop("tick", "vx", "vy"), ["i", "j", "k"])
        at = last.select("object_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("vx").alias("_vx"), F.col("vy").alias("_vy"))
        new = {n: F.col(f"_{n}") for n in ("x", "y", "vx", "vy")}
        self.objects = self._tables.cut(self.objects.join(at, "object_id").withColumns(new).select(*self.objects.columns))
        self.step_count += steps
        self.ticks += steps
        return Made(shown, frames, field)

    def step(self) -> Made:
        return self.run(1)

    def reset_step_count(self) -> None:
        """Steps are counted from 0 again; the world's time goes on."""
        self.step_count = 0

    def set_voxel_grid(self, grid: DataFrame | None) -> None:
        self.grid = grid if grid is None else require_grid(grid)

    def add_objects(self, more: DataFrame) -> None:
        self.objects = world.add_objects(self.objects, more)

    def remove_object(self, object_id: str) -> None:
        self.objects = world.remove_object(self.objects, object_id)

    def clear_objects(self) -> None:
        self.objects = self.objects.limit(0)
