"""The continuous pipeline: frames to state messages, on keyed state with event-time timers.

Two stateful operators in a chain, in append mode.  A link's processor conditions and measures its
frames, a room's fuses the evidence of a tick, holds the field and follows the entities.  Both
keep what arrives until the watermark has passed it and take it in order of time, so the
order of arrival within the watermark's delay does not matter.  Rows that come later are
dropped by Spark and counted in the query's progress.  State is typed and lives in
RocksDB; a query that is started again goes on from its checkpoint.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fieldlark.config import ServerConfig
from fieldlark.operators import fusion, message, sensing, tracking
from fieldlark.operators.cluster import tick_regions
from fieldlark.operators.lineage import Rounds
from fieldlark.sources import tables

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time is the room's second plus EPOCH: rows at time 0 would be late from the start.
EPOCH = 1000.0
#: A row of no room that only moves the watermark.
HEARTBEAT = ""
#: Rows that are read, and ticks that are handed on, at a time.
PART = 256

MEASURED = (
    "snr_db double, amplitude_std double, phase_std double, outlier_ratio double, health_score double, status string, drift map<string,double>, value double, "
    "quality struct<snr:double,confidence:double,completeness:double,stability:double,outlier_score:double>, measure_meta map<string,double>"
)
EVIDENCE = f"room string, link_id string, ts double, at timestamp, activity double, confidence double, drift_common double, {MEASURED}"
REGION = "struct<centroid_row:double,centroid_col:double,size:bigint,total_intensity:double>"
ENTITY = "struct<id:bigint,x:double,y:double,z:double,activity:double,stability:double,last_change:double,radius:double,frames_tracked:bigint>"
TICK = (
    "room string, ts double, at timestamp, n_links int, total_activity double, novelty double, env_drift double, csi_health string, data array<double>, confidence array<double>, active array<boolean>, "
    f"active_links array<string>, clusters array<{REGION}>, entities array<{ENTITY}>, links array<struct<link_id:string,doc:string>>"
)
ENTITY_NAMES = ("id", "x", "y", "z", "activity", "stability", "last_change", "radius", "frames_tracked")


def _ms(ts: float) -> int:
    return round((ts + EPOCH) * 1000)


def _at(ts: float) -> pd.Timestamp:
    return pd.Timestamp(_ms(ts), unit="ms")


class InOrder(StatefulProcessor):
    """Keeps the rows of a key by their time until the watermark has passed it, then takes them in order.

    ``fields``: what is kept of a row.  Rows wait in pages of ``span`` seconds, as each read or write
    of state is a call to the store.  Pages are read one at a time and output is handed on in
    small parts, so memory does not grow with what has arrived.  One timer is set at a time, for the earliest row.  A key
    that has no row for more than ``forget`` seconds begins anew, and its state goes once the
    watermark has passed that time.
    """

    fields = ""
    forget: float | None = None
    span = 1.0

    def page(self, ts: float) -> int:
        return math.floor(ts / self.span)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "page bigint", f"rows array<struct<ts:double,{self.fields}>>")
        self.seen = handle.getValueState("seen", "ts double")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare the key's own state."""

    def row(self, r: dict) -> tuple | None:
        """What is kept of a row, None if nothing is."""
        raise NotImplementedError

    def load(self):
        """The key's own state, None at its start; read once for all times that have passed."""
        raise NotImplementedError

    def take(self, state, key: tuple, ts: float, rows: list) -> tuple:
        """The state after all rows of one time, and their output."""
        raise NotImplementedError

    def store(self, state) -> None:
        """Write the key's own state; clear it if there is none."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            for lo in range(0, len(part), PART):
                found: dict[int, list] = {}
                for r in part.iloc[lo : lo + PART].to_dict("records"):
                    kept = self.row(r)
                    if kept is not None:
                        ts = float(r["ts"])
                        found.setdefault(self.page(ts), []).append((ts, *kept))
                        first = ts if first is None else min(first, ts)
                for page, new in found.items():
                    held = self.waiting.getValue((page,))
                    self.waiting.updateValue((page,), ([*(map(tuple, held[0]) if held else ()), *new],))
        if first is not None:
            self.handle.registerTimer(_ms(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        # an expired timer may still lie before its page's rows: pages whose first time has not passed are not read
        pages = sorted(k[0] for k in self.waiting.keys())
        state = last = next_ = None
        taken = False
        for page in pages:
            if next_ is not None or _ms(page * self.span) > passed:
                next_ = next_ if next_ is not None else page * self.span
                break
            rows = [tuple(r) for r in self.waiting.getValue((page,))[0]]
            ready, wait = [r for r in rows if _ms(r[0]) <= passed], [r for r in rows if _ms(r[0]) > passed]
            if ready and not taken:
                state, last, taken = self.load(), self.seen.get(), True
                last = last[0] if last is not None else min(r[0] for r in ready)
            times: dict[float, list] = {}
            for r in ready:
                times.setdefault(r[0], []).append(r[1:])
            out = []
            for ts in sorted(times):
                if self.forget is not None and ts - last > self.forget:
                    state = None
                last = ts
                state, made = self.take(state, key, ts, times[ts])
                out += made
                if len(out) >= PART:
                    yield pd.DataFrame(out)
                    out = []
            if out:
                yield pd.DataFrame(out)
            if wait:
                next_ = min(r[0] for r in wait)
                if ready:
                    self.waiting.updateValue((page,), (wait,))
            else:
                self.waiting.removeKey((page,))
        if taken:
            self.store(state)
            self.seen.update((last,))
        if next_ is not None:
            self.handle.registerTimer(_ms(next_))
        elif self.forget is not None and self.seen.exists():
            end = _ms(self.seen.get()[0] + self.forget)
            if end > passed:
                self.handle.registerTimer(end)
            else:
                self.seen.clear()
                self.store(None)

    def close(self) -> None:
        pass


class LinkProcessor(InOrder):
    """Frames of a link to evidence.  Frames whose arrays are missing, empty, ragged or not finite are not taken."""

    fields = "amplitude:array<double>,phase:array<double>"

    def __init__(self, c: ServerConfig, forget: float | None = None):
        self.c, self.forget = c, forget

    def open(self, handle: StatefulProcessorHandle) -> None:
        a = "array<double>"
        self.phases = handle.getValueState("phases", f"aligned {a}")
        self.baseline = handle.getValueState("baseline", f"amplitude {a}, phase {a}, phase_offset double, amplitude_mean double")
        self.last = handle.getValueState("last", f"amplitude {a}, phase {a}, n int, base double, prev double, floor double")
        self.changes = handle.getListState("changes", "amplitude double, phase double")

    def load(self):
        array = lambda x: np.asarray(x, dtype=float)
        phases, base, last = self.phases.get(), self.baseline.get(), self.last.get()
        if phases is None:
            return None
        changes = [tuple(x) for x in self.changes.get()]
        held = {"amps": [x[0] for x in changes], "phases": [x[1] for x in changes], "last": (array(last[0]), array(last[1])), "n": last[2], "base": last[3], "prev": last[4], "floor": last[5]}
        return array(phases[0]), (array(base[0]), array(base[1]), base[2], base[3]), held

    def store(self, state) -> None:
        if state is None:
            for s in (self.phases, self.baseline, self.last, self.changes):
                s.clear()
            return
        aligned, base, held = state
        self.phases.update((aligned.tolist(),))
        self.baseline.update((base[0].tolist(), base[1].tolist(), float(base[2]), float(base[3])))
        self.last.update((held["last"][0].tolist(), held["last"][1].tolist(), int(held["n"]), float(held["base"]), float(held["prev"]), float(held["floor"])))
        if held["amps"]:
            self.changes.put([(float(x), float(y)) for x, y in zip(held["amps"], held["phases"])])

    def row(self, r: dict) -> tuple | None:
        a, p = r["amplitude"], r["phase"]
        if a is None or p is None or len(a) != len(p) or not len(a):
            return None
        a, p = np.asarray(a, dtype=float), np.asarray(p, dtype=float)
        return (a.tolist(), p.tolist()) if np.isfinite(a).all() and np.isfinite(p).all() else None

    def take(self, state, key: tuple, ts: float, rows: list) -> tuple:
        c, out = self.c, []
        for amplitude, phase in rows:
            if state is not None and len(state[0]) != len(amplitude):
                continue  # a frame of another width than the link's
            state, made = sensing.sense(state, {"amplitude": amplitude, "phase": phase}, c.clip_z, c.drift_alpha, c.measurement_alpha, c.window_size)
            first = {"room": key[0], "link_id": key[1], "ts": ts, "at": _at(ts), "activity": math.tanh(20 * made["value"]), "confidence": made["quality"]["confidence"], "drift_common": made["drift"]["drift_common"]}
            names = ("snr_db", "amplitude_std", "phase_std", "outlier_ratio", "health_score", "status", "drift", "value", "quality", "measure_meta")
            out.append(first | {n: made[n] for n in names})
        return state, out


class RoomProcessor(InOrder):
    """Evidence of a tick to its field, regions and entities.  A tick is closed by a timer."""

    fields = "link_id:string,activity:double,health_score:double,confidence:double,drift_common:double,doc:string"

    def __init__(self, kernel: dict[str, np.ndarray], c: ServerConfig, forget: float | None = None):
        self.kernel, self.c, self.forget = kernel, c, forget

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getValueState("cells", "value array<double>, ticks array<int>, active array<boolean>, shown array<double>")
        self.next_id = handle.getValueState("next_id", "id bigint")
        self.entities = handle.getListState("entities", "id bigint, x double, y double, z double, activity double, stability double, last_change double, radius double, frames_tracked bigint")

    def load(self):
        held, known = self.cells.get(), self.next_id.get()
        if held is None:
            return None
        cells = np.asarray(held[0], dtype=float), np.asarray(held[1]), np.asarray(held[2], dtype=bool)
        return cells, np.asarray(held[3], dtype=float), (int(known[0]), [dict(zip(ENTITY_NAMES, e)) for e in self.entities.get()])

    def store(self, state) -> None:
        self.entities.clear()  # a list cannot be empty
        if state is None:
            self.cells.clear()
            self.next_id.clear()
            return
        (value, ticks, active), shown, (next_id, entities) = state
        self.cells.update((value.tolist(), ticks.tolist(), active.tolist(), shown.tolist()))
        self.next_id.update((next_id,))
        if entities:
            self.entities.put([tuple(e[n] for n in ENTITY_NAMES) for e in entities])

    def row(self, r: dict) -> tuple | None:
        if r["link_id"] is None or any(r[n] is None or not math.isfinite(r[n]) for n in ("activity", "health_score", "confidence")):
            return None
        common = r.get("drift_common")
        return r["link_id"], float(r["activity"]), float(r["health_score"]), float(r["confidence"]), float(common) if common is not None else 0.0, r.get("doc")

    def take(self, state, key: tuple, ts: float, rows: list) -> tuple:
        c, size = self.c, self.c.width * self.c.height
        cells, before, followed = state or ((np.zeros(size), np.zeros(size, dtype=int), np.zeros(size, dtype=bool)), np.zeros(size), None)
        found = [dict(zip(("link_id", "activity", "health_score", "confidence", "drift_common", "doc"), r)) for r in rows]
        instant, sure, weights = fusion.fuse_tick(self.kernel, found, c)
        cells = fusion.hold_tick(cells, instant, c)
        active = cells[2]
        shown, sure = np.where(active, cells[0], 0.0), np.where(active, sure, 0.0)
        strong = shown * sure
        strong = [{"i": int(k) // c.height, "j": int(k) % c.height, "value": float(strong[k])} for k in np.flatnonzero(strong > c.cluster_threshold)]
        regions = [{n: r[n] for n in ("centroid_row", "centroid_col", "size", "total_intensity")} for r in tick_regions(strong, c.cluster_min_size, 4)]
        followed, kept = tracking.track(followed, tracking.candidates(regions, (c.field_resolution,) * 2, (c.room_x_min, c.room_y_min)), ts, c.match_threshold, c.stability_scale)
        clip = lambda x: min(max(float(x), 0.0), 1.0)
        mean = lambda name: sum(e[name] for e in found) / len(found)
        out = {
            "room": key[0], "ts": ts, "at": _at(ts), "n_links": len(found), "total_activity": clip(shown.max()), "novelty": clip(np.abs(shown - before).mean()),
            "env_drift": clip(math.tanh(mean("drift_common"))), "csi_health": sensing.status_of(mean("health_score")), "data": shown.tolist(), "confidence": sure.tolist(), "active": active.tolist(),
            "active_links": [n for n, s in weights if s > 0], "clusters": regions, "entities": kept, "links": [{"link_id": e["link_id"], "doc": e["doc"]} for e in sorted(found, key=lambda e: e["link_id"])],
        }
        return (cells, shown, followed), [out]


def timed(rows: DataFrame, late: str = "2 seconds") -> DataFrame:
    """Rows with their event time ``at`` and its watermark; a row without a time is not of the stream."""
    at = F.timestamp_micros(F.round((F.col("ts") + EPOCH) * 1000).cast("bigint") * 1000)
    return rows.where(F.col("ts").isNotNull()).withColumn("at", at).withWatermark("at", late)


def _with_state(rows: DataFrame) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows


def link_stream(frames: DataFrame, c: ServerConfig = ServerConfig(), late: str = "2 seconds", forget: float | None = None) -> DataFrame:
    """(room, link_id, ts, amplitude, phase) to evidence, a state per link."""
    keyed = _with_state(timed(frames.select("room", "link_id", "ts", "amplitude", "phase"), late)).groupBy("room", "link_id")
    return keyed.transformWithStateInPandas(LinkProcessor(c, forget), EVIDENCE, "append", "EventTime", eventTimeColumnName="at")


def kernel_arrays(links: DataFrame, c: ServerConfig = ServerConfig()) -> dict[str, np.ndarray]:
    """Kernels of the links of a room, an array over its cells each: as many numbers as links times cells."""
    cells = tables.grid(links.sparkSession, c)
    return fusion.kernel_arrays(fusion.kernels(links, cells, c.field_resolution), [(i, j) for i in range(c.width) for j in range(c.height)])


def room_stream(evidence: DataFrame, links: DataFrame, c: ServerConfig = ServerConfig(), late: str = "2 seconds", forget: float | None = None) -> DataFrame:
    """Evidence (room, link_id, ts, activity, health_score, confidence ...) to ticks, a state per room."""
    rows = evidence if "at" in evidence.columns else timed(evidence, late)
    keyed = _with_state(rows).groupBy("room")
    return keyed.transformWithStateInPandas(RoomProcessor(kernel_arrays(links, c), c, forget), TICK, "append", "EventTime", eventTimeColumnName="at")


def message_stream(frames: DataFrame, links: DataFrame, c: ServerConfig = ServerConfig(), late: str = "2 seconds", forget: float | None = None) -> DataFrame:
    """Frames to (room, ts, message and its parts): the whole pipeline as one stream."""
    sensed = message.with_geometry(link_stream(frames, c, late, forget), links)
    ticks = room_stream(sensed.withColumn("doc", message.link_document()), links, c, late, forget)
    parts = ticks.withColumns(
        {
            "field": message.packed_field(c),
            "entities": F.transform("entities", lambda e: e.dropFields("frames_tracked")),
            "links": F.map_from_entries("links"),
            "fps": F.lit(c.target_fps),
            "latency_ms": F.lit(0.0),
        }
    )
    return message.with_documents(parts, links.count())


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's recent batches dropped because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def replayed(rows: DataFrame, job: Callable[[DataFrame], DataFrame], arrivals: int = 4, late: str = "2 seconds") -> DataFrame:
    """What ``job`` makes of ``rows`` (room, link_id, ts ...) when they arrive as a stream, in order of time.

    The rows are written in ``arrivals`` parts to the shared folder, then a row of no room that
    moves the watermark past them; the stream reads part by part, and writes its result there.
    """
    spark, home = rows.sparkSession, Rounds(rows.sparkSession)
    inbox, out, marks = (f"{home.home}/{x}-{uuid.uuid4().hex}" for x in ("in", "out", "marks"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        first = last = 0.0
    step = (last - first) / arrivals
    for k in range(arrivals):
        low, high = F.col("ts") >= first + k * step, F.col("ts") < first + (k + 1) * step
        rows.where(low & high if k + 1 < arrivals else low).coalesce(1).write.mode("append").parquet(inbox)
    beat = Row(*rows.columns)(*[HEARTBEAT if f in ("room", "link_id") else last + 3600.0 if f == "ts" else None for f in rows.columns])
    spark.createDataFrame([beat], schema).coalesce(1).write.mode("append").parquet(inbox)
    stream = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox))
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

