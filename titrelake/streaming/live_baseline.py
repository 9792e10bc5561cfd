"""Own-baseline ratios on a stream: keyed state, corrections when baselines change, timers that let idle subjects go."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import FOLD_KEY

ROW = "row_ord long, day double, value double"
OUT = f"subject_id string, series string, {ROW}, baseline double, fold_rise double, revision long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OwnBaseline(StatefulProcessor):
    """The rows of one subject, in all series. A series' rows wait until there is a day-0 value; a day-0 row that comes late
    changes the baseline, and all rows so far are given anew with the next revision. What a key holds is a subject's visits:
    a call for each subject, not for each of its series, as what a call costs outweighs the few rows of a series."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", f"series string, {ROW}")
        self.known = handle.getValueState("known", "series array<string>, baseline array<double>, revision array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(s, int(r), float(d), float(v)) for part in rows for s, r, d, v in zip(part["series"], part["row_ord"], part["day"], part["value"])]
        state = self.known.get() if self.known.exists() else None
        known = {s: (b, n) for s, b, n in zip(*state)} if state else {}
        self.rows.appendList(new)
        # without a new day-0 row the baseline stays, and only new rows are given; it is null before the first
        changed = {s for s, _, d, _ in new if d == 0 or s not in known}
        held: dict[str, list[tuple]] = {}
        for row in [tuple(r) for r in self.rows.get()] if changed else []:
            if row[0] in changed:
                held.setdefault(row[0], []).append(row)
        fresh: dict[str, list[tuple]] = {}
        for row in new:
            fresh.setdefault(row[0], []).append(row)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        out, moved = [], False
        for s, some in fresh.items():
            before, revision = known.get(s, (None, 0))
            baseline = median([v for _, _, d, v in held[s] if d == 0] or [0.0]) if s in changed else before
            good = baseline is not None and baseline > 0
            if good or (before or 0) > 0:
                given = held[s] if baseline != before else some
                revision += baseline != before
                moved |= baseline != before
                known[s] = (float(baseline), int(revision))
                shown = baseline if good else None  # a baseline that is no longer positive takes its rows back
                out += [(key[0], s, r, d, v, shown, v / shown if good else None, revision) for _, r, d, v in given]
        if moved:
            self.known.update(([*known], [b for b, _ in known.values()], [n for _, n in known.values()]))
        if out:
            yield pd.DataFrame(out, columns=["subject_id", "series", "row_ord", "day", "value", "baseline", "fold_rise", "revision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        self.known.clear()
        return iter([])

    def close(self) -> None:
        pass


def own_baseline(stream: DataFrame, idle_ms: int = 0) -> DataFrame:
    """(subject_id, series, row_ord, day, value, baseline, fold_rise, revision) of a stream of measurements, in update mode.

    A row of a later revision replaces those of earlier ones (latest() does that). Rows without a value take no part, nor
    do subjects whose baseline is not positive. idle_ms: a key without rows for so long is forgotten; 0 keeps all. Keyed
    state of this kind lives in RocksDB, which is set for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    has = [c for c in FOLD_KEY if c in stream.columns]
    series = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in has])
    rows = stream.where("value IS NOT NULL AND day IS NOT NULL").select(F.coalesce(F.col("subject_id").cast("string"), F.lit("")).alias("subject_id"), series.alias("series"), "row_ord", F.col("day").cast("double").alias("day"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("subject_id").transformWithStateInPandas(OwnBaseline(idle_ms), OUT, "Update", "ProcessingTime" if idle_ms else "None")


def latest(updates: DataFrame) -> DataFrame:
    """The last revision of each row; rows that were taken back are absent."""
    best = Window.partitionBy("row_ord").orderBy(F.desc("revision"))
    return updates.withColumn("__r", F.row_number().over(best)).where("__r = 1 AND fold_rise IS NOT NULL").drop("__r")
