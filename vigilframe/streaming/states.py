"""Per-address threat status as arbitrary state: each change of status leaves its +1 and -1."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DELTAS = "src_ip string, seq bigint, status string, active int, blocked int, suspicious int"
COUNTED = {  # status: what an address in it adds to the counters
    "Active": (1, 0, 1), "Blocked": (0, 1, 0),
}
OTHER, NONE = (0, 0, 1), (0, 0, 0)


def counted(status: str | None) -> tuple[int, int, int]:
    return COUNTED.get(status, OTHER)


class StatusMachine(StatefulProcessor):
    """Keeps the newest status of an address; an older row that comes late changes nothing.

    With idle_ms an address is forgotten, and taken off the counters, that long after its last event.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "seq long, status string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for pdf in rows:  # at most a row for each Arrow batch of the micro-batch
            row = pdf.loc[pdf["seq"].idxmax()]
            if newest is None or row["seq"] > newest["seq"]:
                newest = row
        seq, before, timer = self.held.get() if self.held.exists() else (None, None, 0)
        if seq is not None and newest["seq"] <= seq:
            return
        status = newest["status"]
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = int(newest["ts"].timestamp() * 1000) + self.idle_ms
            self.handle.registerTimer(timer)
        self.held.update((int(newest["seq"]), status, timer))
        yield from change(key[0], newest["seq"], status, counted(before) if seq is not None else NONE, counted(status))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            seq, status, _ = self.held.get()
            self.held.clear()
            yield from change(key[0], seq, None, counted(status), NONE)

    def close(self) -> None:
        pass


def change(address: str, seq: int, status: str | None, before: tuple, after: tuple) -> Iterator[pd.DataFrame]:
    steps = [b - a for a, b in zip(before, after)]
    if any(steps) or before == NONE:
        yield pd.DataFrame({"src_ip": [address], "seq": [int(seq)], "status": [status], "active": [steps[0]], "blocked": [steps[1]], "suspicious": [steps[2]]}).astype(
            {"active": "int32", "blocked": "int32", "suspicious": "int32"})


def newest_of_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of an Arrow batch only the newest row of an address matters: a hot one shrinks before the shuffle."""
    for pdf in batches:
        yield pdf.loc[pdf.groupby("src_ip")["seq"].idxmax()]


def threat_deltas(stream: DataFrame, idle_ms: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """The changes that each address makes to the counters of active, blocked and suspicious addresses.

    Sums of the deltas are the counters at any time, and never below 0. Needs the RocksDB state
    store. With idle_ms addresses expire by event time, and only then are rows later than
    `lateness` left out. Rows without an address are left out.
    """
    rows = stream.where("src_ip is not null").select("src_ip", "seq", F.col("ts").cast("timestamp").alias("ts"), "status")
    small = rows.mapInPandas(newest_of_batch, "src_ip string, seq bigint, ts timestamp, status string")
    if idle_ms:
        small = small.withWatermark("ts", lateness)
    return small.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=StatusMachine(idle_ms), outputStructType=DELTAS, outputMode="Append" if idle_ms else "Update",
        timeMode="EventTime" if idle_ms else "None")


def counters(deltas: DataFrame) -> DataFrame:
    return deltas.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("active", "blocked", "suspicious")])
