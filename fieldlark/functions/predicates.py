"""Validation as boolean columns, with a fail-fast and a quarantine mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.config import DISTURBANCE

INF = float("inf")


class ValidationError(ValueError):
    pass


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def all_finite(a: Column) -> Column:
    return a.isNotNull() & F.forall(a, finite)


def bad_count(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: ~finite(x)))


def positive(x: Column, allow_zero: bool = False) -> Column:
    return finite(x) & ((x >= 0) if allow_zero else (x > 0))


def in_range(x: Column, lo: float | None = None, hi: float | None = None, inclusive: bool = True) -> Column:
    ok = finite(x)
    if lo is not None:
        ok = ok & ((x >= lo) if inclusive else (x > lo))
    if hi is not None:
        ok = ok & ((x <= hi) if inclusive else (x < hi))
    return ok


def has_length(a: Column, n: int | None) -> Column:
    """A shape with a wild card: any length for None."""
    return a.isNotNull() & (F.lit(True) if n is None else F.size(a) == n)


def has_shape(a: Column, shape: tuple[int | None, ...]) -> Column:
    """Nested arrays of the given lengths."""
    ok = has_length(a, shape[0])
    return ok if len(shape) == 1 else ok & F.forall(a, lambda x: has_shape(x, shape[1:]))


def same_shape(a: Column, b: Column) -> Column:
    return F.size(a) == F.size(b)


def non_empty(a: Column) -> Column:
    return F.size(a) > 0


def text_non_empty(s: Column) -> Column:
    """A blank is text."""
    return s.isNotNull() & (F.length(s) > 0)


def text_not_blank(s: Column) -> Column:
    return s.isNotNull() & (F.length(F.trim(s)) > 0)


def require_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Schema check of types and dimensions: names and simple type strings."""
    have = dict(df.dtypes)
    for name, kind in kinds.items():
        if name not in have:
            raise TypeError(f"column {name} is missing")
        if have[name] != kind:
            raise TypeError(f"column {name} is {have[name]}, not {kind}")
    return df


def dimensions(df: DataFrame, name: str) -> int:
    """How deep arrays are nested in a column."""
    kind, n = df.schema[name].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def is_of_type(df: DataFrame, name: str, *kinds: str) -> bool:
    """Whether a column has one of the types."""
    return df.schema[name].dataType.simpleString() in kinds


def require_objects(objects: DataFrame) -> DataFrame:
    """What takes part as a disturbance has its columns and types."""
    return require_columns(objects, **{f.name: f.dataType.simpleString() for f in DISTURBANCE.fields})


def require_grid(cells: DataFrame, axes: str = "xyz") -> DataFrame:
    """What can be filled as a grid has an index and a centre along every axis."""
    return require_columns(cells, **dict.fromkeys("ijk"[: len(axes)], "int"), **dict.fromkeys(axes, "double"))


def frame_faults() -> dict[str, Column]:
    return {
        "link_id is empty": ~text_non_empty(F.col("link_id")),
        "ts is not finite": ~F.coalesce(finite(F.col("ts")), F.lit(False)),
        "amplitude is empty": ~F.coalesce(non_empty(F.col("amplitude")), F.lit(False)),
        "amplitude and phase differ in length": ~F.coalesce(same_shape(F.col("amplitude"), F.col("phase")), F.lit(False)),
        "amplitude is not finite": ~F.coalesce(all_finite(F.col("amplitude")), F.lit(False)),
        "phase is not finite": ~F.coalesce(all_finite(F.col("phase")), F.lit(False)),
    }


def legacy_frame_faults() -> dict[str, Column]:
    """The old form: shapes only, members of arrays are not looked at."""
    return {
        "timestamp is not finite": ~F.coalesce(finite(F.col("timestamp")), F.lit(False)),
        "amplitude is empty": ~F.coalesce(non_empty(F.col("amplitude")), F.lit(False)),
        "amplitude and phase differ in length": ~F.coalesce(same_shape(F.col("amplitude"), F.col("phase")), F.lit(False)),
    }


def quality_faults(q: str = "quality") -> dict[str, Column]:
    c = lambda n: F.col(f"{q}.{n}")
    out = {"snr is not finite": ~F.coalesce(finite(c("snr")), F.lit(False))}
    for n in ("confidence", "completeness", "stability", "outlier_score"):
        out[f"{n} is outside [0, 1]"] = ~F.coalesce(in_range(c(n), 0, 1), F.lit(False))
    return out


def measurement_faults() -> dict[str, Column]:
    value, vector = F.col("value"), F.col("vector")
    return {
        "link_id is empty": ~text_non_empty(F.col("link_id")),
        "ts is not finite": ~F.coalesce(finite(F.col("ts")), F.lit(False)),
        "not one of value and vector": value.isNull() == vector.isNull(),
        "value is not finite": value.isNotNull() & ~finite(value),
        "vector is not finite or empty": vector.isNotNull() & ~(all_finite(vector) & non_empty(vector)),
        "unit is empty": ~text_non_empty(F.col("unit")),
    } | quality_faults()


def evidence_faults() -> dict[str, Column]:
    return {
        "link_id is blank": ~text_not_blank(F.col("link_id")),
        "activity is negative": ~F.coalesce(positive(F.col("activity"), True), F.lit(False)),
        "health_score is outside [0, 1]": ~F.coalesce(in_range(F.col("health_score"), 0, 1), F.lit(False)),
        "confidence is outside [0, 1]": ~F.coalesce(in_range(F.col("confidence"), 0, 1), F.lit(False)),
    }


def geometry_faults() -> dict[str, Column]:
    ends = [F.col(f"{e}.{a}") for e in ("tx", "rx") for a in "xyz"]
    sound = F.lit(True)
    for e in ends:
        sound = sound & F.coalesce(finite(e), F.lit(False))
    return {"link_id is blank": ~text_not_blank(F.col("link_id")), "an end is not finite": ~sound, "frequency is not positive": ~F.coalesce(positive(F.col("frequency_hz")), F.lit(False))}


def detection_faults(dims: int = 2) -> dict[str, Column]:
    out = {f"{a} is not finite": ~F.coalesce(finite(F.col(a)), F.lit(False)) for a in [*"xyz"[:dims], "ts"]}
    out["confidence is outside [0, 1]"] = ~F.coalesce(in_range(F.col("confidence"), 0, 1), F.lit(False))
    for n in ("intensity", "size"):
        out[f"{n} is negative"] = ~F.coalesce(positive(F.col(n), True), F.lit(False))
    out[f"bbox has not {2 * dims} numbers"] = F.col("bbox").isNotNull() & ~(has_length(F.col("bbox"), 2 * dims) & all_finite(F.col("bbox")))
    return out


def track_faults(dims: int = 2) -> dict[str, Column]:
    out = {f"{a} is not finite": ~F.coalesce(finite(F.col(a)), F.lit(False)) for a in [*"xyz"[:dims], "ts"]}
    out["track_id is not positive"] = ~F.coalesce(F.col("track_id") > 0, F.lit(False))
    out["unknown state"] = ~F.coalesce(F.col("state").isin("TENTATIVE", "CONFIRMED", "COASTING", "DELETED"), F.lit(False))
    for n in ("age", "hits", "time_since_update"):
        out[f"{n} is negative"] = ~F.coalesce(F.col(n) >= 0, F.lit(False))
    return out


def field_faults(has_confidence: bool = True) -> dict[str, Column]:
    out = {"value is not finite": ~F.coalesce(finite(F.col("value")), F.lit(False))}
    if has_confidence:
        out["confidence is outside [0, 1]"] = F.col("confidence").isNotNull() & ~in_range(F.col("confidence"), 0, 1)
    return out


def first_fault(faults: dict[str, Column]) -> Column:
    """The first fault of a row by name, null for a sound row."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in faults.items()])


def quarantine(df: DataFrame, faults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(sound rows, faulty rows with their ``fault``)."""
    marked = df.withColumn("fault", first_fault(faults))
    return marked.where("fault is null").drop("fault"), marked.where("fault is not null")


def enforce(df: DataFrame, faults: dict[str, Column]) -> DataFrame:
    """Rows unchanged; the job fails at the first faulty one."""
    fault = first_fault(faults)
    return df.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True)))


def out_of_order(df: DataFrame, key: str = "link_id", ts: str = "ts", order: str | None = None, strict: bool = True) -> DataFrame:
    """Per key the first row (from 0) whose time does not follow the one before; keys in order are left out."""
    w = Window.partitionBy(key).orderBy(order or ts)
    before = F.lag(ts).over(w)
    marked = df.select(key, F.col(ts), (F.row_number().over(w) - 1).alias("idx"), ((F.col(ts) <= before) if strict else (F.col(ts) < before)).alias("bad"))
    return marked.where("bad").groupBy(key).agg(F.min("idx").alias("first_bad"), F.min_by(ts, "idx").alias("at"))


def combined_quality(q: str = "quality") -> Column:
    c = lambda n: F.col(f"{q}.{n}")
    return c("confidence") * c("completeness") * c("stability") * (1 - c("outlier_score"))


def is_reliable(q: str = "quality") -> Column:
    return (F.col(f"{q}.confidence") >= 0.5) & (F.col(f"{q}.outlier_score") < 0.5)


def as_float(value: str = "value", vector: str = "vector") -> Column:
    return F.when(F.col(vector).isNotNull(), F.raise_error(F.lit("a vector has no scalar value")).cast("double")).otherwise(F.col(value))


def as_array(value: str = "value", vector: str = "vector") -> Column:
    return F.coalesce(F.col(vector), F.array(value))


def is_scalar(vector: str = "vector") -> Column:
    return F.col(vector).isNull()


def measured_dim(vector: str = "vector") -> Column:
    """Numbers in a measurement; a scalar has one."""
    return F.when(is_scalar(vector), F.lit(1)).otherwise(F.size(vector))
