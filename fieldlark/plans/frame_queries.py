"""Queries over frames: conditioning, features, windows, encoders, k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.functions import arrays as A
from fieldlark.operators import cluster, features, latent, preprocess, scan
from fieldlark.sources import tables

W, STRIDE = 10, 5

FRAMES = """f AS MATERIALIZED (SELECT CAST(label AS VARCHAR) AS link_id, CAST(vec_id AS DOUBLE) AS ts, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
l AS MATERIALIZED (SELECT link_id, ts, CAST(k AS INTEGER) AS k, a[k + 1] AS amp, a[k + 1] * CAST(40 AS DOUBLE) AS phase FROM (SELECT link_id, ts, a, unnest(range(len(a))) AS k FROM f))"""
T = "OVER (PARTITION BY link_id, k ORDER BY ts)"
S = "OVER (PARTITION BY link_id, ts ORDER BY k)"
PER_FRAME = "OVER (PARTITION BY link_id, ts)"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def half_away(x, digits: int):
    """``x`` to some digits as SQL's round on doubles does it: the product with a power of ten to the
    nearest whole number.  ``F.round`` goes by the shortest decimal, which settles ties otherwise."""
    return F.round(x * 10.0**digits) / 10.0**digits


def _rows(spark, sf):
    return tables.long(tables.frames(spark, sf))


def _timed_rows(spark, sf, before: int) -> DataFrame:
    """Rows of frames in blocks along time."""
    return tables.long(scan.in_blocks(tables.frames(spark, sf), ["link_id"], ["ts"], before))


def _packed(spark, sf, value) -> DataFrame:
    out = tables.frames(spark, sf).select("link_id", "ts", F.posexplode(value).alias("k", "value"))
    return rounded(out, "value")


def _long_sql(value: str, where: str = "") -> str:
    return f"WITH {FRAMES} SELECT link_id, ts, k, {r('value')} AS value FROM (SELECT *, {value} AS value FROM l) {where}"


def _unwrap_sql(over: str) -> str:
    pi = "pi()"
    m = f"((d + {pi}) - floor((d + {pi}) / (2 * {pi})) * (2 * {pi}) - {pi})"
    return f"""WITH {FRAMES}, d AS (SELECT link_id, ts, k, phase, phase - lag(phase) {over} AS d FROM l),
c AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < {pi} THEN 0.0 ELSE (CASE WHEN {m} = -{pi} AND d > 0 THEN {pi} ELSE {m} END) - d END AS j FROM d)
SELECT link_id, ts, k, {r(f"phase + sum(j) {over}")} AS value FROM c"""


@query(_unwrap_sql(S))
def unwrap_phase(spark, sf):
    return rounded(preprocess.unwrap(_rows(spark, sf), "phase").select("link_id", "ts", "k", F.col("phase").alias("value")), "value")


@query(_unwrap_sql(T))
def unwrap_phase_temporal(spark, sf):
    return rounded(preprocess.unwrap_in_time(_timed_rows(spark, sf, 1), "phase").select("link_id", "ts", "k", F.col("phase").alias("value")), "value")


@query(_long_sql(f"phase - lag(phase) {T}", "WHERE value IS NOT NULL"))
def difference_phase_temporal(spark, sf):
    return rounded(preprocess.difference(_timed_rows(spark, sf, 1), "phase").select("link_id", "ts", "k", F.col("phase").alias("value")), "value")


@query(f"WITH {FRAMES} SELECT link_id, ts, k - 1 AS k, {r('value')} AS value FROM (SELECT *, phase - lag(phase) {S} AS value FROM l) WHERE value IS NOT NULL")
def difference_phase_subcarrier(spark, sf):
    return _packed(spark, sf, A.diff(F.col("phase")))


@query(_long_sql(f"phase - avg(phase) {PER_FRAME}"))
def remove_phase_offset(spark, sf):
    return _packed(spark, sf, A.remove_offset(F.col("phase")))


@query(_long_sql(f"coalesce(amp / nullif(sum(amp) {PER_FRAME}, 0), 0)"))
def normalize_amplitude(spark, sf):
    return _packed(spark, sf, A.normalize_sum(F.col("amplitude")))


@query(_long_sql(f"coalesce((amp - min(amp) {PER_FRAME}) / nullif(max(amp) {PER_FRAME} - min(amp) {PER_FRAME}, 0), 0)"))
def normalize_amplitude_minmax(spark, sf):
    return _packed(spark, sf, A.normalize_minmax(F.col("amplitude")))


@query(_long_sql(f"coalesce((amp - avg(amp) {PER_FRAME}) / nullif(stddev_pop(amp) {PER_FRAME}, 0), 0)"))
def normalize_amplitude_zscore(spark, sf):
    return _packed(spark, sf, A.normalize_zscore(F.col("amplitude")))


@query(_long_sql("amp - avg(amp) OVER (PARTITION BY link_id, k)"))
def subtract_baseline(spark, sf):
    return rounded(preprocess.subtract_baseline(_rows(spark, sf), "amp").select("link_id", "ts", "k", F.col("amp").alias("value")), "value")


@query(_long_sql(f"coalesce(amp / nullif(first_value(amp) {T}, 0), 1)"))
def amplitude_ratio(spark, sf):
    return rounded(preprocess.amplitude_ratio(_rows(spark, sf), "amp").select("link_id", "ts", "k", F.col("amp").alias("value")), "value")


@query(f"WITH {FRAMES} SELECT link_id, ts, k, {r('amp * cos(phase)')} AS re, {r('amp * sin(phase)')} AS im FROM l")
def complex_frames(spark, sf):
    out = tables.frames(spark, sf).select("link_id", "ts", F.posexplode(A.to_complex(F.col("amplitude"), F.col("phase"))).alias("k", "c"))
    return rounded(out.select("link_id", "ts", "k", "c.re", "c.im"), "re", "im")


@query(f"WITH {FRAMES} SELECT link_id, ts, CAST(len(a) AS INTEGER) AS n_subcarriers, {r('list_sum(a)')} AS total FROM f")
def pack_unpack(spark, sf):
    """Frames exploded, shuffled and packed again."""
    back = tables.pack(_rows(spark, sf), "amp", "phase")
    return rounded(back.select("link_id", "ts", F.size("amp").alias("n_subcarriers"), A.total(F.col("amp")).alias("total")), "total")


# features


@query(_long_sql(f"amp - lag(amp) {T}", "WHERE value IS NOT NULL"))
def first_order_difference(spark, sf):
    return rounded(preprocess.difference(_timed_rows(spark, sf, 1), "amp", 1).select("link_id", "ts", "k", F.col("amp").alias("value")), "value")


@query(_long_sql(f"(amp - lag(amp) {T}) - (lag(amp) {T} - lag(amp, 2) {T})", "WHERE value IS NOT NULL"))
def second_order_difference(spark, sf):
    return rounded(preprocess.difference(_timed_rows(spark, sf, 2), "amp", 2).select("link_id", "ts", "k", F.col("amp").alias("value")), "value")


def _windowed_sql(expr: str, name: str) -> str:
    frame = f"OVER (PARTITION BY link_id, k ORDER BY ts ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
    return f"""WITH {FRAMES}, w AS (SELECT link_id, k, ts, row_number() {T} AS rn, {expr.format(o=frame)} AS v FROM l)
SELECT link_id, k, ts, CAST((rn - {W}) / {STRIDE} AS INTEGER) AS w_idx, {r('v')} AS {name} FROM w WHERE rn >= {W} AND (rn - {W}) % {STRIDE} = 0"""


def _windowed(spark, sf, aggregate, name):
    return rounded(preprocess.windowed(_timed_rows(spark, sf, W - 1), "amp", W, STRIDE, aggregate, name), name)


@query(_windowed_sql("sum(amp * amp) {o}", "energy"))
def windowed_energy(spark, sf):
    return _windowed(spark, sf, lambda c: F.sum(c * c), "energy")


@query(_windowed_sql("var_pop(amp) {o}", "variance"))
def windowed_variance(spark, sf):
    return _windowed(spark, sf, F.var_pop, "variance")


@query(_windowed_sql("avg(amp) {o}", "mean"))
def windowed_mean(spark, sf):
    return _windowed(spark, sf, F.avg, "mean")


@query(_windowed_sql("stddev_pop(amp) {o}", "std"))
def windowed_std(spark, sf):
    return _windowed(spark, sf, F.stddev_pop, "std")


_O = "OVER (PARTITION BY link_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {FRAMES}, w AS (SELECT link_id, row_number() OVER (PARTITION BY link_id ORDER BY ts) AS rn, min(ts) {_O} AS ts_start, ts AS ts_end, list(a) {_O} AS fs FROM f)
SELECT link_id, CAST((rn - 10) / 5 AS INTEGER) AS w_idx, ts_start, ts_end, CAST(len(fs) AS INTEGER) AS n_frames, {r('list_sum(list_transform(fs, lambda x: x[1]))')} AS first_sum
FROM w WHERE rn >= 10 AND (rn - 10) % 5 = 0"""
)
def sliding_window(spark, sf):
    w = preprocess.sliding_window(tables.frames(spark, sf), W, STRIDE)
    first = A.total(F.transform("frames", lambda f: f["amplitude"][0]))
    return rounded(w.select("link_id", "w_idx", "ts_start", "ts_end", F.size("frames").alias("n_frames"), first.alias("first_sum")), "first_sum")


@query(f"WITH {FRAMES} SELECT link_id, k, {r('sum(amp * amp)')} AS energy FROM l GROUP BY ALL")
def short_time_energy(spark, sf):
    return rounded(features.energy(_rows(spark, sf), "amp", 0), "energy")


@query(f"WITH {FRAMES} SELECT link_id, ts, {r('sum(amp * amp)')} AS energy FROM l GROUP BY link_id, ts")
def short_time_energy_per_frame(spark, sf):
    return rounded(features.energy(_rows(spark, sf), "amp", 1), "energy")


@query(f"WITH {FRAMES} SELECT link_id, k, {r('avg(amp)')} AS mean, {r('stddev_pop(amp)')} AS std, {r('min(amp)')} AS min, {r('max(amp)')} AS max FROM l GROUP BY link_id, k")
def aggregate_statistics(spark, sf):
    return rounded(features.statistics(_rows(spark, sf), "amp"), "mean", "std", "min", "max")


@query(f"WITH {FRAMES} SELECT link_id, k, {r('max(amp) - min(amp)')} AS range FROM l GROUP BY link_id, k")
def subcarrier_range(spark, sf):
    return rounded(features.spread(_rows(spark, sf), "amp"), "range")


@query(f"WITH {FRAMES} SELECT link_id, k, {r('median(amp)')} AS median FROM l GROUP BY link_id, k")
def subcarrier_median(spark, sf):
    return rounded(features.median(_rows(spark, sf), "amp"), "median")


@query(f"WITH {FRAMES} SELECT link_id, ts, {r('var_pop(amp)')} AS variance FROM l GROUP BY link_id, ts")
def inter_subcarrier_variance(spark, sf):
    return rounded(features.inter_subcarrier_variance(_rows(spark, sf), "amp"), "variance")


_PAIRS = f"WITH {FRAMES}, p AS (SELECT x.link_id, x.k AS k1, y.k AS k2, x.amp AS a, y.amp AS b FROM l x JOIN l y ON x.link_id = y.link_id AND x.ts = y.ts)"


@query(f"{_PAIRS} SELECT link_id, k1, k2, {r('corr(a, b)')} AS r FROM p GROUP BY link_id, k1, k2 HAVING count(*) >= 2")
def subcarrier_correlation_matrix(spark, sf):
    return rounded(features.correlation_matrix(tables.frames(spark, sf)), "r")


@query(f"{_PAIRS} SELECT link_id, k1, k2, {r('covar_samp(a, b)')} AS c FROM p GROUP BY link_id, k1, k2")
def subcarrier_covariance_matrix(spark, sf):
    return rounded(features.covariance_matrix(tables.frames(spark, sf)), "c")


@query(f"{_PAIRS}, m AS (SELECT link_id, corr(a, b) AS c FROM p WHERE k1 < k2 GROUP BY link_id, k1, k2) SELECT link_id, {r('avg(c)')} AS mean_r FROM m GROUP BY link_id")
def mean_subcarrier_correlation(spark, sf):
    return rounded(features.mean_correlation(tables.frames(spark, sf)), "mean_r")


@query(
    f"""WITH {FRAMES}, d AS (SELECT *, amp - lag(amp) {T} AS d1 FROM l), e AS (SELECT *, d1 - lag(d1) {T} AS d2 FROM d)
SELECT link_id, k, {r('sum(amp * amp)')} AS total_energy, {r('avg(abs(d1))')} AS mean_first, {r('avg(abs(d2))')} AS mean_second FROM e GROUP BY link_id, k"""
)
def temporal_features(spark, sf):
    parts = features.temporal_features(_rows(spark, sf), "amp", W, STRIDE)
    mean = lambda n, a: parts[n].groupBy("link_id", "k").agg(F.avg(F.abs("amp")).alias(a))
    out = parts["total_energy"].withColumnRenamed("energy", "total_energy").join(mean("first_diff", "mean_first"), ["link_id", "k"], "left").join(mean("second_diff", "mean_second"), ["link_id", "k"], "left")
    return rounded(out, "total_energy", "mean_first", "mean_second")


@query(
    f"""WITH {FRAMES}, p AS (SELECT x.link_id, x.k AS k1, y.k AS k2, corr(x.amp, y.amp) AS c FROM l x JOIN l y ON x.link_id = y.link_id AND x.ts = y.ts AND x.k < y.k GROUP BY ALL),
m AS (SELECT link_id, avg(c) AS c FROM p GROUP BY link_id), s AS (SELECT link_id, k, avg(amp) AS mean, stddev_pop(amp) AS std, max(amp) - min(amp) AS rng FROM l GROUP BY link_id, k),
v AS (SELECT link_id, avg(v) AS v FROM (SELECT link_id, ts, var_pop(amp) AS v FROM l GROUP BY link_id, ts) GROUP BY link_id)
SELECT s.link_id, {r('any_value(m.c)')} AS mean_correlation, {r('avg(mean)')} AS mean, {r('avg(std)')} AS std, {r('avg(rng)')} AS range, {r('any_value(v.v)')} AS variance
FROM s JOIN m ON s.link_id = m.link_id JOIN v ON s.link_id = v.link_id GROUP BY s.link_id"""
)
def spectral_features(spark, sf):
    f = tables.frames(spark, sf)
    p = features.spectral_features(f, tables.long(f))
    by = lambda n, **a: p[n].groupBy("link_id").agg(*[F.avg(c).alias(o) for o, c in a.items()])
    out = p["mean_correlation"].withColumnRenamed("mean_r", "mean_correlation").join(by("statistics", mean="mean", std="std"), "link_id").join(by("range", range="range"), "link_id").join(by("inter_subcarrier_variance", variance="variance"), "link_id")
    return rounded(out, "mean_correlation", "mean", "std", "range", "variance")


@query(
    f"""WITH {FRAMES}, d AS (SELECT link_id, ts, abs(amp - lag(amp) {T}) AS d FROM l), s AS (SELECT link_id, ts, avg(d) AS d FROM d GROUP BY link_id, ts)
SELECT link_id, ts, {r('coalesce(avg(d) OVER (PARTITION BY link_id ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 0)')} AS change FROM s"""
)
def rolling_activity(spark, sf):
    return rounded(features.rolling_activity(_timed_rows(spark, sf, 10), "amp"), "change")


_H = "OVER (PARTITION BY link_id, k ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"
_H1 = "OVER (PARTITION BY link_id, k ORDER BY ts ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING)"


@query(
    f"""WITH {FRAMES}, d AS (SELECT *, amp - lag(amp) {T} AS d FROM l), h AS (SELECT *, var_pop(amp) {_H} AS v, avg(amp) {_H} AS m, sum(d * d) {_H1} AS e FROM d)
SELECT link_id, ts, {r('sqrt(sum(amp * amp))')} AS intensity, {r('coalesce(avg(v), 0)')} AS intensity_variance, {r('coalesce(sqrt(sum(d * d)), 0)')} AS temporal_change,
{r('coalesce(sqrt(sum((amp - m) * (amp - m))), 0)')} AS temporal_change_avg, {r('coalesce(sum(e), 0)')} AS motion_energy FROM h GROUP BY link_id, ts"""
)
def latent_history_signals(spark, sf):
    out = latent.history_signals(_rows(spark, sf))
    return rounded(out, *[c for c in out.columns if c not in ("link_id", "ts")])


@query(
    f"""WITH RECURSIVE {FRAMES}, n AS MATERIALIZED (SELECT link_id, k, amp, ts, row_number() {T} AS rn FROM l),
e AS (SELECT link_id, k, rn, ts, amp, amp AS b, amp * amp AS q, CAST(0 AS DOUBLE) AS pb, CAST(0 AS DOUBLE) AS pq FROM n WHERE rn = 1
  UNION ALL SELECT n.link_id, n.k, n.rn, n.ts, n.amp, CAST(0.98 AS DOUBLE) * e.b + CAST(0.02 AS DOUBLE) * n.amp, CAST(0.98 AS DOUBLE) * e.q + CAST(0.02 AS DOUBLE) * n.amp * n.amp, e.b, e.q FROM e JOIN n ON n.link_id = e.link_id AND n.k = e.k AND n.rn = e.rn + 1),
s AS (SELECT *, sqrt(greatest(pq - pb * pb, 0)) AS sd FROM e)
SELECT link_id, ts, CASE WHEN any_value(rn) = 1 THEN 0.0 ELSE {r('sqrt(sum((amp - pb) * (amp - pb)))')} END AS novelty,
CASE WHEN any_value(rn) = 1 THEN 0.0 ELSE round(sqrt(sum(power((amp - pb) / CASE WHEN sd > 1e-8 THEN sd ELSE 1 END, 2))) / sqrt(count(*)), 4) END AS novelty_normalized FROM s GROUP BY link_id, ts"""
)
def latent_novelty(spark, sf):
    out = latent.latent_signals(tables.frames(spark, sf), "link_id", "ts", "amplitude").select("link_id", "ts", F.round("novelty", 6).alias("novelty"), F.round("novelty_normalized", 4).alias("novelty_normalized"))
    return out


def _matrix(rows: int, cols: int, step: float) -> np.ndarray:
    """A fixed matrix of small sines, the same in SQL."""
    return np.array([[np.sin(step * (i * cols + j + 1)) for j in range(cols)] for i in range(rows)])


@query(
    f"""WITH {FRAMES} SELECT link_id, ts, CAST(o AS INTEGER) AS k, {r('sum((amp - 0.01::DOUBLE) * sin(0.37::DOUBLE * (l.k * 8 + o + 1)))')} AS value
FROM l, (SELECT unnest(range(8)) AS o) GROUP BY link_id, ts, o"""
)
def linear_encode(spark, sf):
    e = latent.LinearEncoder(64, 8, _matrix(64, 8, 0.37), np.full(64, 0.01))
    return _packed(spark, sf, e.encode(F.col("amplitude")))


@query(
    f"""WITH {FRAMES}, h AS (SELECT link_id, ts, o, tanh(sum(amp * sin(0.37::DOUBLE * (l.k * 16 + o + 1))) + 0.05::DOUBLE) AS h FROM l, (SELECT unnest(range(16)) AS o) GROUP BY link_id, ts, o)
SELECT link_id, ts, CAST(p AS INTEGER) AS k, {r('sum(h * sin(0.53::DOUBLE * (o * 4 + p + 1))) - 0.02::DOUBLE')} AS value FROM h, (SELECT unnest(range(4)) AS p) GROUP BY link_id, ts, p"""
)
def mlp_encode(spark, sf):
    e = latent.MLPEncoder(64, 16, 4)
    e.set_parameters(_matrix(64, 16, 0.37), np.full(16, 0.05), _matrix(16, 4, 0.53), np.full(4, -0.02))
    return _packed(spark, sf, e.encode(F.col("amplitude")))


@query()
def pca_encode(spark, sf):
    f = tables.frames(spark, sf)
    return _packed(spark, sf, latent.PCAEncoder(64, 4).fit(f, "amplitude").encode(F.col("amplitude")))


_COV = f"""{FRAMES}, pc AS MATERIALIZED (SELECT a.k AS i, b.k AS j, covar_samp(a.amp, b.amp) AS c FROM l a JOIN l b ON a.link_id = b.link_id AND a.ts = b.ts GROUP BY ALL), rows_ AS MATERIALIZED (SELECT i, list(c ORDER BY j) AS c FROM pc GROUP BY i)"""


@query(
    f"""WITH RECURSIVE {_COV}, pw AS (SELECT 0 AS n, (SELECT list(1 / sqrt(64) ORDER BY i) FROM rows_) AS v, 0::DOUBLE AS norm UNION ALL
SELECT n + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))), sqrt(list_dot_product(w, w)) FROM (SELECT n, list(list_dot_product(c, v) ORDER BY i) AS w FROM pw, rows_ WHERE n < 2000 GROUP BY n))
SELECT (SELECT round(sum(c), 4) FROM pc WHERE i = j) AS total_variance, round(norm, 4) AS leading_variance FROM pw WHERE n = 2000"""
)
def pca_spectrum(spark, sf):
    """All variance is explained by all components; the leading one's is that of power iteration."""
    e = latent.PCAEncoder(64, 64).fit(tables.frames(spark, sf), "amplitude")
    v = e.explained_variance
    return spark.createDataFrame([(round(float(v.sum()), 4), round(float(v.max()), 4))], "total_variance double, leading_variance double")


@query("SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, true AS as_explained, true AS orthonormal FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b)")
def pca_projections(spark, sf):
    """Projections are uncorrelated, vary as explained, and the components are orthonormal."""
    f = tables.frames(spark, sf)
    e = latent.PCAEncoder(64, 4).fit(f, "amplitude")
    z = f.select(F.posexplode(e.encode(F.col("amplitude"))).alias("a", "u"), e.encode(F.col("amplitude")).alias("z"))
    c = z.select("a", "u", F.posexplode("z").alias("b", "w")).groupBy("a", "b").agg(F.covar_samp("u", "w").alias("c"), F.abs(F.avg("u")).alias("m"))
    explained, unit = (F.array(*[F.lit(float(x)) for x in v]) for v in (e.explained_variance, np.abs(e.components.T @ e.components - np.eye(4)).max(axis=0)))
    want = F.when(F.col("a") == F.col("b"), F.get(explained, F.col("a"))).otherwise(0.0)
    return c.select("a", "b", ((F.abs(F.col("c") - want) < 1e-8) & (F.col("m") < 1e-8)).alias("as_explained"), (F.get(unit, F.col("a")) < 1e-9).alias("orthonormal"))


def _vectors(spark, sf):
    return tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("x"))


_C = "c AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS c, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 4))"
_V = "v AS MATERIALIZED (SELECT vec_id AS idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_D = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NEAR = f"a AS MATERIALIZED (SELECT idx, any_value(e) AS e, arg_min(c, d * 1000 + c * 1e-12) AS cluster, min(d) AS d2 FROM (SELECT idx, v.e, c, {_D.format(a='v.e', b='c.e')} AS d FROM v, c) GROUP BY idx)"


def _start(spark, sf) -> np.ndarray:
    return np.array([list(row.x) for row in _vectors(spark, sf).orderBy("idx").limit(4).collect()])


@query(f"WITH {_C}, {_V}, {_NEAR} SELECT idx, cluster, {r('d2')} AS d2 FROM a")
def kmeans_assign(spark, sf):
    return rounded(cluster.assign(_vectors(spark, sf), _start(spark, sf)).select("idx", "cluster", "d2"), "d2")


@query(
    f"""WITH {_C}, {_V}, {_NEAR}, m AS (SELECT cluster, d, avg(x) AS m FROM (SELECT cluster, unnest(range(len(e))) AS d, unnest(e) AS x FROM a) GROUP BY cluster, d),
n AS (SELECT cluster, list(m ORDER BY d) AS e FROM m GROUP BY cluster)
SELECT a.cluster AS cluster_id, count(*) AS size, {r(f"sum({_D.format(a='a.e', b='n.e')})")} AS inertia FROM a JOIN n ON a.cluster = n.cluster GROUP BY a.cluster"""
)
def kmeans_step(spark, sf):
    """One Lloyd round: sizes, and inertia against the moved centres."""
    assigned, centers = cluster.k_means(_vectors(spark, sf), 4, _start(spark, sf), max_iter=1)
    clusters = cluster.latent_clusters(assigned, centers)
    per = assigned.groupBy(F.col("cluster").alias("cluster_id")).agg(F.sum(cluster.own_distance(centers)).alias("inertia"))
    return rounded(clusters.join(per, "cluster_id").select("cluster_id", "size", "inertia"), "inertia")


def _lloyd_sql(ks: str, rounds: int) -> str:
    """Rounds from the first k vectors: centres cs of every k and round."""
    near = f"list_transform(cs, lambda q: {_D.format(a='e', b='q')})"
    return f"""{_V}, s0 AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings), ks AS (SELECT unnest({ks}) AS k),
lloyd AS (SELECT CAST(k AS INTEGER) AS k, 0 AS it, list(e ORDER BY n) AS cs FROM s0 JOIN ks ON n <= k GROUP BY k UNION ALL
SELECT k, it, list(m ORDER BY cluster) FROM (SELECT k, it + 1 AS it, cluster, list(m ORDER BY d) AS m FROM (SELECT k, it, cluster, d, avg(x) AS m FROM
(SELECT k, it, list_position(ds, list_min(ds)) - 1 AS cluster, unnest(range(len(e))) AS d, unnest(e) AS x FROM (SELECT k, it, e, {near} AS ds FROM lloyd, v WHERE it < {rounds}))
GROUP BY k, it, cluster, d) GROUP BY k, it, cluster) GROUP BY k, it),
won AS (SELECT k, idx, e, list_position(ds, list_min(ds)) - 1 AS cluster FROM (SELECT k, idx, e, {near} AS ds FROM lloyd, v WHERE it = {rounds - 1})),
cost AS (SELECT won.k, idx, cluster, {_D.format(a='e', b='cs[cluster + 1]')} AS d2 FROM won JOIN lloyd ON won.k = lloyd.k AND it = {rounds})"""


@query(f"WITH RECURSIVE {_lloyd_sql('[4]', 20)} SELECT CAST(cluster AS INTEGER) AS cluster_id, count(*) AS size, {r('sum(d2)')} AS inertia FROM cost GROUP BY cluster")
def kmeans(spark, sf):
    """Up to 20 rounds from the first four vectors."""
    assigned, centers = cluster.k_means(_vectors(spark, sf), 4, _start(spark, sf), max_iter=20)
    clusters = cluster.latent_clusters(assigned, centers)
    per = assigned.groupBy(F.col("cluster").alias("cluster_id")).agg(F.sum(cluster.own_distance(centers)).alias("inertia"))
    return rounded(clusters.join(per, "cluster_id").select("cluster_id", "size", "inertia"), "inertia")


@query(
    f"""WITH RECURSIVE {_lloyd_sql('[2, 3, 4]', 5)}, i AS (SELECT k, sum(d2) AS inertia FROM cost GROUP BY k), f AS (SELECT k, lag(inertia) OVER (ORDER BY k) AS before, inertia FROM i)
SELECT k, {r('inertia')} AS inertia, (SELECT arg_max(k, (before - inertia) / before) FROM f WHERE before IS NOT NULL) AS chosen FROM i"""
)
def kmeans_elbow(spark, sf):
    start = np.array([list(row.x) for row in _vectors(spark, sf).orderBy("idx").limit(4).collect()])
    k, curve = cluster.optimal_k(_vectors(spark, sf), (2, 4), max_iter=5, starts=lambda n: start[:n])
    return rounded(spark.createDataFrame([(i + 2, float(c), k) for i, c in enumerate(curve)], "k int, inertia double, chosen int"), "inertia")


@query()
def kmeans_plus_plus(spark, sf):
    """Rounds from a start drawn by hash, which SQL does not have."""
    assigned, centers = cluster.k_means(_vectors(spark, sf), 4, max_iter=20, seed=1, start=cluster.plus_plus)
    return cluster.latent_clusters(assigned, centers).select("cluster_id", "size")


_SNR = "10 * log10(greatest((avg(amp) * avg(amp) + 1e-8) / (var_pop(amp) + 1e-8), 1e-8))"


@query(f"WITH {FRAMES} SELECT link_id, ts, {r(_SNR)} AS snr_db FROM l GROUP BY link_id, ts")
def snr_estimate(spark, sf):
    return rounded(tables.frames(spark, sf).select("link_id", "ts", A.snr_db(F.col("amplitude")).alias("snr_db")), "snr_db")


_UW = """CASE WHEN d IS NULL OR abs(d) < pi() THEN 0.0 ELSE ((d + pi()) - floor((d + pi()) / (2 * pi())) * (2 * pi()) - pi()) - d END"""


#: Conditioned frames (x, a row per subcarrier) and their health (h).
_CONDITIONED = f"""n AS (SELECT *, row_number() {T} AS rn FROM l),
d0 AS (SELECT *, phase - lag(phase) {S} AS d FROM n), u0 AS (SELECT * EXCLUDE (d), phase + sum({_UW}) {S} AS u FROM d0),
t AS (SELECT *, CASE WHEN rn = 1 THEN round((u - phase) / (2 * pi())) ELSE round_even((lag(phase) {T} - phase) / (2 * pi()), 0) END AS turn FROM u0),
al AS (SELECT link_id, ts, k, amp, phase + 2 * pi() * sum(turn) {T} AS p FROM t),
d1 AS (SELECT *, p - lag(p) {S} AS d FROM al), u1 AS (SELECT * EXCLUDE (d), p + sum({_UW}) {S} AS q FROM d1),
c AS (SELECT *, coalesce((amp - avg(amp) {PER_FRAME}) / nullif(stddev_pop(amp) {PER_FRAME}, 0), 0) AS z, avg(q) {PER_FRAME} AS off FROM u1),
s AS (SELECT *, avg(z) {PER_FRAME} AS mz, stddev_pop(z) {PER_FRAME} AS sz, q - off AS pc, avg(q - off) {PER_FRAME} AS mp, stddev_pop(q - off) {PER_FRAME} AS sp FROM c),
o AS (SELECT *, sz >= 1e-8 AND abs(z - mz) > 3.5 * sz AS oz, sp >= 1e-8 AND abs(pc - mp) > 3.5 * sp AS op FROM s),
x AS (SELECT *, CASE WHEN oz THEN mz ELSE z END AS ca, CASE WHEN op THEN mp ELSE pc END AS cp FROM o),
y AS (SELECT *, coalesce(cp - lag(cp) {S}, 0) AS dp FROM x),
g AS (SELECT link_id, ts, {_SNR} AS snr, stddev_pop(ca) AS sa, stddev_pop(dp) AS sd, 0.5 * (avg(CAST(oz AS INTEGER)) + avg(CAST(op AS INTEGER))) AS ro, any_value(off) AS off FROM y GROUP BY link_id, ts),
h AS (SELECT *, least(greatest(0.55 * least(greatest((snr + 10) / 30, 0), 1) + 0.2 * (1 - least(sa / 4, 1)) + 0.2 * (1 - least(sd / 4, 1)) + 0.05 * (1 - ro), 0), 1) AS score FROM g)"""


@query(
    f"""WITH {FRAMES}, {_CONDITIONED}
SELECT link_id, ts, {r('snr')} AS snr_db, {r('sa')} AS amplitude_std, {r('sd')} AS phase_std, {r('ro')} AS outlier_ratio, {r('score')} AS health_score,
CASE WHEN score >= 0.75 THEN 'NOMINAL' WHEN score >= 0.45 THEN 'DEGRADED' ELSE 'DISCONNECTED' END AS status, {r('off')} AS phase_offset FROM h"""
)
def condition_links(spark, sf):
    """Health of every conditioned frame."""
    from fieldlark.operators.sensing import sense_links

    out = sense_links(tables.frames(spark, sf))
    names = ["snr_db", "amplitude_std", "phase_std", "outlier_ratio", "health_score", "phase_offset"]
    return rounded(out.select("link_id", "ts", "snr_db", "amplitude_std", "phase_std", "outlier_ratio", "health_score", "status", "phase_offset"), *names)


def _mean_gap(a: str, b: str) -> str:
    return f"list_avg(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"


def _blend(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: (1 - 0.03::DOUBLE) * z[1] + 0.03::DOUBLE * z[2])"


#: Drift (rw) and measurement (me) of every conditioned frame.
SENSED = f"""{_CONDITIONED},
fr AS MATERIALIZED (SELECT link_id, ts, list(ca ORDER BY k) AS ca, list(cp ORDER BY k) AS cp, any_value(off) AS off, avg(amp) AS raw, row_number() OVER (PARTITION BY link_id ORDER BY ts) AS rn FROM x GROUP BY link_id, ts),
bs AS (SELECT link_id, rn, ca AS ba, cp AS bp, off AS bo, raw AS bm, 0::DOUBLE AS da, 0::DOUBLE AS dp, 0::DOUBLE AS d_off, 0::DOUBLE AS dm FROM fr WHERE rn = 1
UNION ALL SELECT f.link_id, f.rn, {_blend('ba', 'ca')}, {_blend('bp', 'cp')}, (1 - 0.03::DOUBLE) * bo + 0.03::DOUBLE * off, (1 - 0.03::DOUBLE) * bm + 0.03::DOUBLE * raw, {_mean_gap('ca', 'ba')}, {_mean_gap('cp', 'bp')}, abs(off - bo), abs(raw - bm)
FROM bs JOIN fr f ON f.link_id = bs.link_id AND f.rn = bs.rn + 1),
tw AS (SELECT link_id, ts, rn, {_mean_gap('ca', 'la')} AS ad, {_mean_gap('cp', 'lp')} AS pd FROM (SELECT *, lag(ca) OVER w AS la, lag(cp) OVER w AS lp FROM fr WINDOW w AS (PARTITION BY link_id ORDER BY rn))),
mv AS (SELECT link_id, ts, rn, coalesce(avg(ad) OVER w, 0) AS change, coalesce(avg(pd) OVER w, 0) AS velocity FROM tw WINDOW w AS (PARTITION BY link_id ORDER BY rn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
rw AS MATERIALIZED (SELECT mv.*, 0.45 * (0.6 * da + 0.4 * dp) + 0.55 * (0.7 * d_off + 0.3 * dm) AS drift_norm, 0.7 * d_off + 0.3 * dm AS drift_common,
0.35 * velocity + 0.30 * change + 0.10 * (0.45 * (0.6 * da + 0.4 * dp) + 0.55 * (0.7 * d_off + 0.3 * dm)) + 0.25 * (0.7 * d_off + 0.3 * dm) AS raw FROM mv JOIN bs ON mv.link_id = bs.link_id AND mv.rn = bs.rn),
me AS (SELECT link_id, rn, 0::DOUBLE AS value, raw AS base, raw AS prev, 0::DOUBLE AS floor FROM rw WHERE rn = 1
UNION ALL SELECT r.link_id, r.rn, 0.65 * greatest(0, r.raw - base) + 0.35 * greatest(0, abs(r.raw - prev) - floor), 0.95::DOUBLE * base + 0.05::DOUBLE * r.raw, r.raw, 0.95::DOUBLE * floor + 0.05::DOUBLE * abs(r.raw - prev)
FROM me JOIN rw r ON r.link_id = me.link_id AND r.rn = me.rn + 1)"""


@query(
    f"""WITH RECURSIVE {FRAMES}, {SENSED}
SELECT rw.link_id, rw.ts, {r('drift_norm')} AS drift_norm, {r('drift_common')} AS drift_common, {r('value')} AS value, {r('least(greatest(score * (1 - 0.5 * ro), 0), 1)')} AS confidence, {r('least(greatest(1 - velocity, 0), 1)')} AS stability
FROM rw JOIN me ON rw.link_id = me.link_id AND rw.rn = me.rn JOIN h ON rw.link_id = h.link_id AND rw.ts = h.ts"""
)
def sense_links(spark, sf):
    """Drift and measurement of every frame."""
    from fieldlark.operators import sensing

    out = sensing.sense_links(tables.frames(spark, sf))
    return rounded(out.select("link_id", "ts", F.col("drift")["drift_norm"].alias("drift_norm"), F.col("drift")["drift_common"].alias("drift_common"), "value", F.col("quality.confidence").alias("confidence"), F.col("quality.stability").alias("stability")), "drift_norm", "drift_common", "value", "confidence", "stability")


@query(
    f"""WITH RECURSIVE {FRAMES}, {SENSED} SELECT link_id, ts, {r('drift_norm')} AS drift_norm, {r('drift_common')} AS drift_common FROM rw"""
)
def drift_baselines(spark, sf):
    """Drift of every conditioned frame, its exponential baselines found by a scan over chunks of time."""
    from fieldlark.operators import sensing

    out = sensing.drift_scanned(sensing.sense_links(tables.frames(spark, sf)))
    return rounded(out.select("link_id", "ts", "drift_norm", "drift_common"), "drift_norm", "drift_common")
