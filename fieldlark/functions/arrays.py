"""Column expressions on packed arrays (one array per frame); no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793
TWO_PI = 2 * PI


def let(use, **values: Column) -> Column:
    """``use(v)`` with v.name bound to each value, computed once per row: a lambda would compute
    what it closes over for every element."""
    row = F.array(F.struct(*[c.alias(n) for n, c in values.items()]))
    return F.get(F.transform(row, use), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def variance(a: Column) -> Column:
    """Population variance."""
    return let(lambda v: mean(F.transform(v["a"], lambda x: (x - v["m"]) * (x - v["m"]))), a=a, m=mean(a))


def std(a: Column) -> Column:
    return F.sqrt(variance(a))


def scan(a: Column, start: Column, step) -> Column:
    """Running fold: [step(start, a0), step(that, a1), ...]; quadratic in the length of a, meant for frames."""
    return F.aggregate(a, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))), lambda acc: F.slice(acc, 2, F.size(acc)))


def diff(a: Column) -> Column:
    """First differences, one shorter than ``a``; empty for one element."""
    empty = F.slice(a, 1, 0)
    return F.when(F.size(a) > 1, F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x - F.get(a, i))).otherwise(empty)


def wrapped_jump(d: Column) -> Column:
    """What unwrapping adds to a difference d: it brings it into [-pi, pi), and keeps +pi for d > 0."""
    m = F.pmod(d + PI, F.lit(TWO_PI)) - PI
    m = F.when((m == -PI) & (d > 0), F.lit(PI)).otherwise(m)
    return F.when(F.abs(d) < PI, F.lit(0.0)).otherwise(m - d)


def remove_offset(a: Column) -> Column:
    return let(lambda v: F.transform(v["a"], lambda x: x - v["m"]), a=a, m=mean(a))


def _scaled(a: Column, shift: Column, by: Column) -> Column:
    """(x - shift) / by, 0 where ``by`` is 0."""
    return let(lambda v: F.transform(v["a"], lambda x: F.when(v["s"] == 0, F.lit(0.0)).otherwise(F.try_divide(x - v["m"], v["s"]))), a=a, m=shift, s=by)


def normalize_sum(a: Column) -> Column:
    return _scaled(a, F.lit(0.0), total(a))


def normalize_minmax(a: Column) -> Column:
    return _scaled(a, F.array_min(a), F.array_max(a) - F.array_min(a))


def normalize_zscore(a: Column) -> Column:
    return _scaled(a, mean(a), std(a))


def to_complex(amplitude: Column, phase: Column) -> Column:
    return F.zip_with(amplitude, phase, lambda a, p: F.struct((a * F.cos(p)).alias("re"), (a * F.sin(p)).alias("im")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bounds a number; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def snr_db(a: Column) -> Column:
    m = mean(a)
    return 10.0 * F.log10(F.greatest((m * m + 1e-8) / (variance(a) + 1e-8), F.lit(1e-8)))


def health_score(snr: Column, amplitude_std: Column, phase_std: Column, outlier_ratio: Column) -> Column:
    s = 0.55 * clip((snr + 10.0) / 30.0, 0, 1) + 0.20 * (1 - clip(amplitude_std / 4.0, 0, 1)) + 0.20 * (1 - clip(phase_std / 4.0, 0, 1)) + 0.05 * (1 - outlier_ratio)
    return clip(s, 0, 1)


def health_status(score: Column) -> Column:
    return F.when(score >= 0.75, "NOMINAL").when(score >= 0.45, "DEGRADED").otherwise("DISCONNECTED")
