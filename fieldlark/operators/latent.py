"""Encoders and the online signals of latent vectors."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.functions.arrays import dot
from fieldlark.operators.fold import fold_sorted
from fieldlark.operators.moments import moments


class Encoder(ABC):
    """Turns a vector column into a latent column."""

    input_dim: int
    latent_dim: int

    @abstractmethod
    def encode(self, x: Column) -> Column: ...


def _literal(v) -> Column:
    return F.array(*[F.lit(float(a)) for a in v])


def _affine(x: Column, weights: np.ndarray, bias=None) -> Column:
    """x W + bias as one expression per output: runs in the JVM without a join."""
    cols = [dot(x, _literal(w)) for w in weights.T]
    return F.array(*[c if bias is None else c + float(b) for c, b in zip(cols, bias if bias is not None else cols)])


class LinearEncoder(Encoder):
    """(x - bias) W; by default W has orthonormal columns drawn from a seed."""

    def __init__(self, input_dim: int, latent_dim: int, weights=None, bias=None, seed: int | None = None):
        if not 0 < latent_dim <= input_dim:
            raise ValueError("latent_dim must be between 1 and input_dim")
        self.input_dim, self.latent_dim = input_dim, latent_dim
        self.set_weights(np.linalg.qr(np.random.default_rng(seed).standard_normal((input_dim, latent_dim)))[0] if weights is None else weights)
        self.set_bias(np.zeros(input_dim) if bias is None else bias)

    def set_weights(self, weights) -> None:
        w = np.asarray(weights, float)
        if w.shape != (self.input_dim, self.latent_dim) or not np.isfinite(w).all():
            raise ValueError("weights must be finite, input_dim by latent_dim")
        self.weights = w

    def set_bias(self, bias) -> None:
        b = np.asarray(bias, float)
        if b.shape != (self.input_dim,) or not np.isfinite(b).all():
            raise ValueError("bias must be finite, of length input_dim")
        self.bias = b

    def encode(self, x: Column) -> Column:
        return _affine(F.zip_with(x, _literal(self.bias), lambda a, b: a - b), self.weights)


class PCAEncoder(Encoder):
    """Principal components with a canonical sign: the largest weight of each is positive."""

    def __init__(self, input_dim: int, latent_dim: int):
        if not 0 < latent_dim <= input_dim:
            raise ValueError("latent_dim must be between 1 and input_dim")
        self.input_dim, self.latent_dim = input_dim, latent_dim
        self.mean = self.components = self.explained_variance = None

    @property
    def is_fitted(self) -> bool:
        return self.components is not None

    def fit(self, df: DataFrame, x: str) -> PCAEncoder:
        """The covariance is a matrix per task, merged pairwise; only the merged one reaches the driver."""
        d = self.input_dim
        found = moments(df, x, []).first()
        n = found.n if found else 0
        if n < self.latent_dim or n < 2:
            raise ValueError("too few vectors to fit")
        mean, cov = np.array(found.mean), np.array(found.m2).reshape(len(found.mean), -1) / (n - 1)
        if len(mean) != d:
            raise ValueError(f"vectors have {len(mean)} numbers, not {d}")
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        top = np.argsort(-values, kind="stable")[: self.latent_dim]
        w = vectors[:, top]
        self.set_parameters(mean, w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])]), np.maximum(values[top], 0))
        return self

    def set_parameters(self, mean, components, explained_variance=None) -> None:
        self.mean, self.components = np.asarray(mean, float), np.asarray(components, float)
        self.explained_variance = None if explained_variance is None else np.asarray(explained_variance, float)

    def encode(self, x: Column) -> Column:
        if not self.is_fitted:
            raise RuntimeError("fit the encoder or set its parameters first")
        return _affine(F.zip_with(x, _literal(self.mean), lambda a, b: a - b), self.components)


class MLPEncoder(Encoder):
    """tanh(x W1 + b1) W2 + b2, Xavier start, no training."""

    def __init__(self, input_dim: int, hidden_dim: int, latent_dim: int, seed: int | None = None):
        if min(input_dim, hidden_dim, latent_dim) <= 0:
            raise ValueError("dimensions must be positive")
        self.input_dim, self.hidden_dim, self.latent_dim = input_dim, hidden_dim, latent_dim
        rng = np.random.default_rng(seed)
        self.set_parameters(rng.normal(0, np.sqrt(2 / (input_dim + hidden_dim)), (input_dim, hidden_dim)), np.zeros(hidden_dim), rng.normal(0, np.sqrt(2 / (hidden_dim + latent_dim)), (hidden_dim, latent_dim)), np.zeros(latent_dim))

    def set_parameters(self, weights1, bias1, weights2, bias2) -> None:
        shapes = (self.input_dim, self.hidden_dim), (self.hidden_dim,), (self.hidden_dim, self.latent_dim), (self.latent_dim,)
        got = [np.asarray(p, float) for p in (weights1, bias1, weights2, bias2)]
        if tuple(g.shape for g in got) != shapes or not all(np.isfinite(g).all() for g in got):
            raise ValueError("parameters have the wrong shape or are not finite")
        self.weights1, self.bias1, self.weights2, self.bias2 = got

    def get_parameters(self) -> dict[str, np.ndarray]:
        return {"weights1": self.weights1, "bias1": self.bias1, "weights2": self.weights2, "bias2": self.bias2}

    def encode(self, x: Column) -> Column:
        hidden = F.transform(_affine(x, self.weights1, self.bias1), F.tanh)
        return _affine(hidden, self.weights2, self.bias2)


SIGNALS = "intensity double, intensity_variance double, temporal_change double, temporal_change_avg double, novelty double, novelty_normalized double, motion_energy double"


class InferenceState:
    """History and exponential baselines of one stream of latent vectors."""

    def __init__(self, history: int = 50, decay: float = 0.02):
        if history < 1 or not 0 < decay <= 1:
            raise ValueError("history >= 1 and decay in (0, 1] are required")
        self.size, self.decay = history, decay
        self.reset()

    def reset(self) -> None:
        self.history, self.baseline, self.square, self.observation_count = [], None, None, 0

    def clear_history(self) -> None:
        self.history = []

    def set_baseline(self, baseline) -> None:
        self.baseline = np.asarray(baseline, float)
        self.square = self.baseline**2

    def history_array(self) -> np.ndarray:
        return np.array(self.history)

    def signals(self, x: np.ndarray) -> dict[str, float]:
        h = self.history_array()
        norm = lambda v: float(np.sqrt((v * v).sum()))
        out = {"intensity": norm(x), "intensity_variance": 0.0, "temporal_change": 0.0, "temporal_change_avg": 0.0, "novelty": 0.0, "novelty_normalized": 0.0, "motion_energy": 0.0}
        if len(h):
            out |= {"intensity_variance": float(h.var(axis=0).mean()), "temporal_change": norm(x - h[-1]), "temporal_change_avg": norm(x - h.mean(axis=0))}
        if len(h) > 1:
            out["motion_energy"] = float((np.diff(h, axis=0) ** 2).sum())
        if self.baseline is not None:
            sd = np.sqrt(np.maximum(self.square - self.baseline**2, 0))
            out["novelty"] = norm(x - self.baseline)
            out["novelty_normalized"] = norm((x - self.baseline) / np.where(sd > 1e-8, sd, 1.0)) / np.sqrt(len(x))
        return out

    def observe(self, x: np.ndarray) -> None:
        self.history = (self.history + [x])[-self.size :]
        if self.baseline is None:
            self.baseline, self.square = x.copy(), x**2
        else:
            self.baseline = (1 - self.decay) * self.baseline + self.decay * x
            self.square = (1 - self.decay) * self.square + self.decay * x**2
        self.observation_count += 1


def latent_signals(vectors: DataFrame, key: str, ts: str, x: str, history: int = 50, decay: float = 0.02) -> DataFrame:
    """Signals of each vector against what its key has seen before, then it is observed."""

    def step(state, row):
        s = state or InferenceState(history, decay)
        v = np.asarray(row[x], float)
        out = s.signals(v)
        s.observe(v)
        return s, out

    return fold_sorted(vectors.select(key, ts, x), [key], [ts], step, SIGNALS)


def history_signals(rows: DataFrame, history: int = 50) -> DataFrame:
    """The signals that read the history only, as window functions on the long form
    (link_id, ts, k, amp): no Python and no history held."""
    w = Window.partitionBy("link_id", "k").orderBy("ts")
    past = w.rowsBetween(-history, -1)
    x = F.col("amp")
    r = rows.withColumn("d", x - F.lag(x).over(w)).withColumn("n", F.row_number().over(w))
    r = r.select("link_id", "ts", "k", "amp", "n", "d", F.var_pop("amp").over(past).alias("v"), F.avg("amp").over(past).alias("m"), F.sum(F.col("d") * F.col("d")).over(w.rowsBetween(-(history - 1), -1)).alias("e"))
    zero = F.lit(0.0)
    return r.groupBy("link_id", "ts").agg(
        F.sqrt(F.sum(x * x)).alias("intensity"),
        F.coalesce(F.avg("v"), zero).alias("intensity_variance"),
        F.coalesce(F.sqrt(F.sum(F.col("d") * F.col("d"))), zero).alias("temporal_change"),
        F.coalesce(F.sqrt(F.sum((x - F.col("m")) ** 2)), zero).alias("temporal_change_avg"),
        F.coalesce(F.sum("e"), zero).alias("motion_energy"),
    )
