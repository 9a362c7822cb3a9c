"""The stateful sensing stage of a link: conditioning, baseline drift, activity measurement.

Each is a pure step ``(state, input) -> (state, output)``.  Batch jobs run them with
``fold_sorted``, streams with ``fieldlark.streaming``: the same code, so they agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.predicates import all_finite
from fieldlark.operators.fold import fold_sorted
from fieldlark.operators.scan import scan_linear

METHOD = "unwrap_offset_zscore_outlier_clip"
TWO_PI = 2 * math.pi


def replace_outliers(values: np.ndarray, limit: float) -> tuple[np.ndarray, float]:
    """Values further than ``limit`` standard deviations from the mean become the mean."""
    spread = values.std()
    if spread < 1e-8:
        return values.copy(), 0.0
    far = np.abs(values - values.mean()) > limit * spread
    return np.where(far, values.mean(), values), float(far.mean())


def status_of(score: float) -> str:
    return "NOMINAL" if score >= 0.75 else "DEGRADED" if score >= 0.45 else "DISCONNECTED"


def health_of(amplitude: np.ndarray, clean_amp: np.ndarray, clean_phase: np.ndarray, outliers: float) -> dict:
    centre = amplitude.mean()
    noise = ((amplitude - centre) ** 2).mean() + 1e-8
    snr = 10 * math.log10(max((centre * centre + 1e-8) / noise, 1e-8))
    amp_std, phase_std = float(clean_amp.std()), float(np.concatenate(([0.0], np.diff(clean_phase))).std())
    parts = (0.55, min(max((snr + 10) / 30, 0), 1)), (0.20, 1 - min(amp_std / 4, 1)), (0.20, 1 - min(phase_std / 4, 1)), (0.05, 1 - outliers)
    score = min(max(sum(w * x for w, x in parts), 0.0), 1.0)
    return {"snr_db": snr, "amplitude_std": amp_std, "phase_std": phase_std, "outlier_ratio": outliers, "health_score": score, "status": status_of(score)}


def condition(previous: np.ndarray | None, amplitude: np.ndarray, phase: np.ndarray, clip_z: float = 3.5) -> tuple[np.ndarray, dict]:
    """State: the last phases after alignment in time, before unwrapping along subcarriers."""
    aligned = np.unwrap(phase) if previous is None else phase + TWO_PI * np.rint((previous - phase) / TWO_PI)
    spread = amplitude.std()
    scaled = (amplitude - amplitude.mean()) / spread if spread else np.zeros_like(amplitude)
    flat = np.unwrap(aligned)
    offset = float(flat.mean())
    amp, out_a = replace_outliers(scaled, clip_z)
    ph, out_p = replace_outliers(flat - offset, clip_z)
    meta = {"phase_offset": offset, "amplitude_mean_raw": float(amplitude.mean())}
    return aligned, {"amplitude": amp, "phase": ph, "meta": meta, "health": health_of(amplitude, amp, ph, 0.5 * (out_a + out_p))}


def drift(baseline: tuple | None, frame: dict, alpha: float = 0.03) -> tuple[tuple, dict]:
    """Distance to exponential baselines, taken before they move.  The first frame is the baseline."""
    now = (frame["amplitude"], frame["phase"], frame["meta"]["phase_offset"], frame["meta"]["amplitude_mean_raw"])
    base = now if baseline is None else baseline
    amp, ph = float(np.abs(now[0] - base[0]).mean()), float(np.abs(now[1] - base[1]).mean())
    d_offset, d_mean = abs(now[2] - base[2]), abs(now[3] - base[3])
    common = 0.7 * d_offset + 0.3 * d_mean
    out = {"drift_norm": 0.45 * (0.6 * amp + 0.4 * ph) + 0.55 * common, "amplitude_delta": amp, "phase_delta": ph, "common_phase_delta": d_offset, "common_amp_delta": d_mean, "drift_common": common}
    return (now if baseline is None else tuple((1 - alpha) * b + alpha * n for b, n in zip(base, now))), out


def measure(state: dict | None, frame: dict, drifted: dict, window: int = 10, alpha: float = 0.05) -> tuple[dict, dict]:
    """Activity of a link.  State: the mean changes inside the window, the last frame, baselines of the raw value."""
    s = state or {"amps": [], "phases": [], "last": None, "n": 0, "base": None, "prev": None, "floor": None}
    amps, phases = s["amps"], s["phases"]
    if s["last"] is not None:
        amps = (amps + [float(np.abs(frame["amplitude"] - s["last"][0]).mean())])[-(window - 1) :]
        phases = (phases + [float(np.abs(frame["phase"] - s["last"][1]).mean())])[-(window - 1) :]
    n = min(window, s["n"] + 1)
    change, velocity = (sum(amps) / len(amps), sum(phases) / len(phases)) if amps else (0.0, 0.0)
    raw = 0.35 * velocity + 0.30 * change + 0.10 * drifted["drift_norm"] + 0.25 * drifted["drift_common"]
    if s["base"] is None:
        value, delta, base, floor = 0.0, 0.0, raw, 0.0
    else:
        delta = abs(raw - s["prev"])
        value = 0.65 * max(0.0, raw - s["base"]) + 0.35 * max(0.0, delta - s["floor"])
        base, floor = (1 - alpha) * s["base"] + alpha * raw, (1 - alpha) * s["floor"] + alpha * delta
    health = frame["health"]
    quality = {
        "snr": health["snr_db"],
        "confidence": min(max(health["health_score"] * (1 - 0.5 * health["outlier_ratio"]), 0.0), 1.0),
        "completeness": 1.0,
        "stability": min(max(1 - velocity, 0.0), 1.0),
        "outlier_score": health["outlier_ratio"],
    }
    meta = {
        "raw_value": raw, "raw_baseline": base, "delta_noise_floor": floor, "raw_delta": delta, "amp_temporal_delta": change, "phase_velocity": velocity,
        "baseline_drift": drifted["drift_norm"], "baseline_drift_common": drifted["drift_common"], "window_size": float(n),
    }
    new = {"amps": amps, "phases": phases, "last": (frame["amplitude"], frame["phase"]), "n": n, "base": base, "prev": raw, "floor": floor}
    return new, {"value": value, "unit": "activity_index", "quality": quality, "meta": meta}


SENSED = (
    "snr_db double, amplitude_std double, phase_std double, outlier_ratio double, health_score double, status string, "
    "phase_offset double, amplitude_mean_raw double, drift map<string,double>, value double, unit string, "
    "quality struct<snr:double,confidence:double,completeness:double,stability:double,outlier_score:double>, measure_meta map<string,double>, "
    "amplitude array<double>, phase array<double>"
)


def sense(state: tuple | None, row: dict, clip_z: float = 3.5, drift_alpha: float = 0.03, measure_alpha: float = 0.05, window: int = 10) -> tuple[tuple, dict]:
    """Conditioning, drift and measurement of one frame."""
    s = state or (None, None, None)
    aligned, frame = condition(s[0], np.asarray(row["amplitude"], float), np.asarray(row["phase"], float), clip_z)
    baseline, drifted = drift(s[1], frame, drift_alpha)
    held, m = measure(s[2], frame, drifted, window, measure_alpha)
    out = frame["health"] | frame["meta"] | {"drift": drifted, "value": m["value"], "unit": m["unit"], "quality": m["quality"], "measure_meta": m["meta"]}
    return (aligned, baseline, held), out | {"amplitude": frame["amplitude"].tolist(), "phase": frame["phase"].tolist()}


def sense_links(frames: DataFrame, keys: tuple[str, ...] = ("link_id",), **settings) -> DataFrame:
    """(keys, ts) with health, drift, measurement and conditioned arrays of every frame, links in
    parallel; ``keys`` name a link, its room first where there are many.

    Frames that cannot be measured are left out: arrays that are null, empty, of different
    lengths or not finite, and frames of another width than the first of their link.
    """
    size = F.size("amplitude")
    whole = (size > 0) & (size == F.size("phase")) & all_finite(F.col("amplitude")) & all_finite(F.col("phase")) & F.col("ts").isNotNull()

    def step(state, row):
        if state is not None and len(state[0]) != len(row["amplitude"]):
            return state, None
        return sense(state, row, **settings)

    return fold_sorted(frames.select(*keys, "ts", "amplitude", "phase").where(whole), list(keys), ["ts"], step, SENSED)


def evidence_from(sensed: DataFrame, by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(by, link_id, activity, health_score, confidence): activity is tanh(20 * value)."""
    return sensed.select(*by, "link_id", F.tanh(20 * F.col("value")).alias("activity"), "health_score", F.col("quality.confidence").alias("confidence"))


def drift_scanned(conditioned: DataFrame, keys: tuple[str, ...] = ("link_id",), alpha: float = 0.03, chunks: int | None = None) -> DataFrame:
    """(keys, ts, drift_norm, drift_common, ...) of conditioned frames, as ``drift`` gives them, over many tasks a link.

    ``conditioned``: keys, ts, amplitude, phase, phase_offset, amplitude_mean_raw.  The baselines are
    one linear recurrence on all numbers of a frame, which starts at the first frame.
    """
    now = F.concat("amplitude", "phase", F.array("phase_offset", "amplitude_mean_raw"))
    rows = conditioned.select(*keys, "ts", F.size("amplitude").alias("_w"), now.alias("_now"))
    held = scan_linear(rows, list(keys), ["ts"], F.lit(1 - alpha), F.transform("_now", lambda x: alpha * x), F.col("_now"), "_base", chunks)
    # the distance is to the baseline before it moves, which is (base - alpha * now) / (1 - alpha)
    gap = F.zip_with("_base", "_now", lambda b, x: F.abs(x - b) / (1 - alpha))
    mean = lambda start: F.aggregate(F.slice("_gap", start, F.col("_w")), F.lit(0.0), lambda s, x: s + x) / F.col("_w")
    out = held.withColumn("_gap", gap).withColumns({"amplitude_delta": mean(F.lit(1)), "phase_delta": mean(F.col("_w") + 1), "common_phase_delta": F.element_at("_gap", -2), "common_amp_delta": F.element_at("_gap", -1)})
    out = out.withColumn("drift_common", 0.7 * F.col("common_phase_delta") + 0.3 * F.col("common_amp_delta"))
    norm = 0.45 * (0.6 * F.col("amplitude_delta") + 0.4 * F.col("phase_delta")) + 0.55 * F.col("drift_common")
    return out.select(*keys, "ts", norm.alias("drift_norm"), "amplitude_delta", "phase_delta", "common_phase_delta", "common_amp_delta", "drift_common")
