"""Short forms of records for documents: which fields go out, and under which names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a document and the columns they come from (fixed values).
FIELDS = {
    "detection_2d": {n: n for n in ("x", "y", "timestamp", "confidence", "intensity", "size")},
    "detection_3d": {n: n for n in ("x", "y", "z", "timestamp", "confidence", "intensity", "size")},
    "track_2d": {"id": "track_id"} | {n: n for n in ("x", "y", "timestamp", "state", "confidence", "age", "hits")},
    "track_3d": {"id": "track_id"} | {n: n for n in ("x", "y", "z", "timestamp", "state", "confidence", "age", "hits")},
    "link_health": {n: n for n in ("link_id", "snr_db", "amplitude_std", "phase_std", "outlier_ratio", "health_score", "status")},
    "entity": {n: n for n in ("id", "x", "y", "z", "activity", "stability", "last_change", "radius")},
}


def fields(kind: str) -> Column:
    """The short form of a row as a struct; a record's ``ts`` goes out as its timestamp."""
    return F.struct(*[F.col("ts" if column == "timestamp" else column).alias(name) for name, column in FIELDS[kind].items()])


def document(kind: str) -> Column:
    return F.to_json(fields(kind))
