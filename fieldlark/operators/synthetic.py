"""Synthetic channel frames: path loss, attenuation, phase and spectral profiles, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.config import SPEED_OF_LIGHT
from fieldlark.functions.arrays import TWO_PI

PI = TWO_PI / 2


def distance(links: DataFrame) -> Column:
    return F.sqrt(sum(((F.col(f"rx.{a}") - F.col(f"tx.{a}")) ** 2 for a in "xyz"), F.lit(0.0)))


def subcarriers(n: int, fc: float = 5.8e9, bw: float = 40e6) -> Column:
    """Frequencies from fc - bw/2 to fc + bw/2, both ends in."""
    if n == 1:
        return F.array(F.lit(fc - bw / 2))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(fc - bw / 2) + k * (bw / (n - 1)))


def path_loss(d: Column, wavelength: Column) -> Column:
    return F.when(d < 1e-6, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(wavelength, 4 * PI * d)))


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number by Box-Muller from hashes: the same for the same keys, however data are dealt."""
    u = lambda salt: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(TWO_PI * u(2))


def channel(disturbed: DataFrame, n: int = 64, fc: float = 5.8e9, bw: float = 40e6, sigma_amp: float = 0.0, sigma_phase: float = 0.0, seed: int = 0) -> DataFrame:
    """(link_id, tick, t, distance, disturbance) -> (link_id, ts, k, amp, phase).

    amplitude = loss * attenuation * profile + noise, at least 0; phase = path + disturbance
    + profile + noise.
    """
    rows = disturbed.select("*", F.posexplode(subcarriers(n, fc, bw)).alias("k", "f"))
    d, D, t = F.col("distance"), F.col("disturbance"), F.col("t")
    wave = F.lit(SPEED_OF_LIGHT) / F.col("f")
    s, theta = F.tanh(D), F.lit(TWO_PI) * F.col("f") / F.lit(fc)
    shape = (1 + 0.42 * s * F.cos(2.3 * theta - 0.35 * t)) * (1 + 0.24 * s * F.sin(4.1 * theta + 0.22 * t))
    shape = F.least(F.greatest(shape, F.lit(0.35)), F.lit(1.85))
    bend = 1.15 * s * F.sin(1.7 * theta + 0.40 * t) + 0.60 * s * F.cos(3.6 * theta - 0.28 * t)
    keys = (F.col("link_id"), F.col("tick"), F.col("k"))
    amp = path_loss(d, wave) * F.exp(-0.5 * F.abs(D)) * shape
    phase = TWO_PI * d / wave + TWO_PI * 0.1 * F.tanh(D) / wave + bend
    if sigma_amp:
        amp = F.greatest(F.lit(0.0), amp + sigma_amp * normal(seed, F.lit("amp"), *keys))
    if sigma_phase:
        phase = phase + sigma_phase * normal(seed, F.lit("phase"), *keys)
    return rows.select("link_id", t.alias("ts"), "k", amp.alias("amp"), phase.alias("phase"))


def generate(links: DataFrame, path_values: DataFrame, dt: float, **kw) -> DataFrame:
    """Frames of every link and tick from the mean disturbance on its path."""
    rows = path_values.join(links.select("link_id", distance(links).alias("distance")), "link_id")
    return channel(rows.withColumn("t", F.col("tick") * dt), **kw)
