"""Structured Streaming forms of the stateful operators; they run the batch steps.

Event time is the simulation second plus EPOCH, for rows at time 0 would be late from
the start.  A tick is a window of ``dt``; rows later than the watermark are dropped, and
rows of a micro-batch are put in order of time before they are folded.
"""

from __future__ import annotations

import json
import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldlark.operators import sensing, tracking
from fieldlark.operators.cluster import tick_regions

EPOCH = 1000.0
FRAME_STREAM = "link_id string, ts double, amplitude array<double>, phase array<double>"
EVIDENCE = "link_id string, ts double, activity double, health_score double, confidence double, value double, status string"


def with_event_time(df: DataFrame, ts: str = "ts", late: str = "2 seconds") -> DataFrame:
    at = F.timestamp_micros(((F.col(ts) + EPOCH) * 1e6).cast("bigint"))
    return df.withColumn("at", at).withWatermark("at", late)


def fold_stream(df: DataFrame, key: str, order: str, step: Callable, out: str) -> DataFrame:
    """``step(state, row) -> (state, output)`` per key over a stream; the state is kept pickled."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        result = []
        for row in rows.to_dict("records"):
            held, made = step(held, row)
            if made is not None:
                result.append({key: k[0], order: row[order]} | made)
        state.update((pickle.dumps(held),))
        if result:
            yield pd.DataFrame(result)

    return df.groupBy(key).applyInPandasWithState(run, out, "state binary", "append", GroupStateTimeout.NoTimeout)


def sense_stream(frames: DataFrame, **settings) -> DataFrame:
    """Frames of many links to evidence, a state per link."""

    def step(state, row):
        state, made = sensing.sense(state, row, **settings)
        import math

        quality = made["quality"]
        return state, {"activity": math.tanh(20 * made["value"]), "health_score": made["health_score"], "confidence": quality["confidence"], "value": made["value"], "status": made["status"]}

    return fold_stream(frames, "link_id", "ts", step, EVIDENCE)


def tick_windows(evidence: DataFrame, dt: float) -> DataFrame:
    """(window, n, mean_activity) per tick once the watermark has passed it."""
    timed = with_event_time(evidence)
    return timed.groupBy(F.window("at", f"{int(dt * 1000)} milliseconds")).agg(F.count(F.lit(1)).alias("n"), F.avg("activity").alias("mean_activity"))


def track_stream(fields: DataFrame, scale: tuple[float, float], offset: tuple[float, float], threshold: float, min_size: int) -> DataFrame:
    """(room, ts, cells array<struct<i,j,value>>) to entities per tick, a state per room."""

    def step(state, row):
        cells = [c for c in (dict(i=int(x["i"]), j=int(x["j"]), value=float(x["value"])) for x in row["cells"]) if c["value"] > threshold]
        state, kept = tracking.track(state, tracking.candidates(tick_regions(cells, min_size, 4), scale, offset), row["ts"])
        return state, {"n": len(kept), "ids": [int(e["id"]) for e in kept]}

    return fold_stream(fields, "room", "ts", step, "room string, ts double, n int, ids array<bigint>")


class Publisher:
    """Sink of state messages: every batch goes to all clients, a callable each; a client that
    fails is dropped, as is one that has said nothing for ``timeout`` seconds.  The transport
    itself is the caller's, and so is the clock."""

    def __init__(self, clients: list[Callable[[str], None]] | None = None, single: bool = False, timeout: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.single, self.timeout, self.clock = single, timeout, clock
        self.clients: list[Callable[[str], None]] = []
        self.heard: dict[int, float] = {}
        self.latest: str | None = None
        self.published = 0
        for client in clients or []:
            self.connect(client)

    def connect(self, client: Callable[[str], None]) -> None:
        self.clients = [client] if self.single else [*self.clients, client]
        self.heard[id(client)] = self.clock()

    def disconnect(self, client: Callable[[str], None]) -> None:
        self.clients = [c for c in self.clients if c is not client]
        self.heard.pop(id(client), None)

    def receive(self, text: str, client: Callable[[str], None] | None = None) -> str | None:
        """The answer to what a client sends."""
        if client is not None:
            self.heard[id(client)] = self.clock()
        return "pong" if text == "ping" else None

    def drop_silent(self) -> None:
        if self.timeout is not None:
            for client in list(self.clients):
                if self.clock() - self.heard[id(client)] > self.timeout:
                    self.disconnect(client)

    def status(self) -> dict:
        """The last message as it was sent, and who listens."""
        return {"clients": len(self.clients), "published": self.published, "state": None if self.latest is None else json.loads(self.latest)}

    def publish(self, batch: DataFrame, batch_id: int) -> None:
        for row in batch.orderBy("ts").select("message").toLocalIterator():
            self.latest = row.message
            self.published += 1
            self.drop_silent()
            for client in list(self.clients):
                try:
                    client(row.message)
                except ConnectionError:
                    self.disconnect(client)


def frames_from_files(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(FRAME_STREAM).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
