"""Streaming forms of the lake's jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lintel.streaming import snapshots

Job = Callable[[DataFrame], DataFrame]
#: Days of event time after which a file or run without events is forgotten.
KEEP_DAYS = 30
_DAY_US = 86_400_000_000


def _upserted(rows: DataFrame, job: Job, out: str, checkpoint: str, key: str, order: list[str]) -> StreamingQuery:
    write = lambda batch, number: snapshots.upsert(job(batch), out, number, key, order)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, path: str, schema: str, job: Job, out: str, checkpoint: str, key: str = "id", order: list[str] | None = None, files_at_once: int = 1000) -> StreamingQuery:
    """New JSON files through a batch job into a table with one row per key (snapshots.read reads it): the row that is last by `order`, then by batch."""
    return _upserted(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path), job, out, checkpoint, key, order or [])


def ingest_files(spark: SparkSession, path: str, out: str, checkpoint: str, job: Job | None = None, files_at_once: int = 1000) -> StreamingQuery:
    """New files of any format into a catalogue (readers.catalogue's columns and modified_at) with one row per path: the last modified. `job` may add to it."""
    from lintel.sources.readers import catalogue

    found = lambda batch: catalogue(batch, "modificationTime").withColumnRenamed("modificationTime", "modified_at")
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(path)
    return _upserted(rows, found if job is None else lambda batch: job(found(batch)), out, checkpoint, "path", ["modified_at"])


def publish_trigger(events: DataFrame, delay: str = "1 day", keep_days: int = KEEP_DAYS, groups: int = 1024) -> DataFrame:
    """file_id, event_id of changes to published from any other state; events: file_id, event_id, ts, state.

    Events wait in their file's state until the watermark has passed them and are then taken in the order of time and id, so that shuffled and late
    batches give the rows of the batch form. Events behind the watermark are dropped. A timer wakes the file for its next event, and ends
    its state `keep_days` of event time after the last one: a file that is published again later counts as coming from nowhere.
    Files share `groups` states by hash, since a call of Python for each file and batch would take most of the time; each has its own order, memory and end there.
    """

    def changes(key, frames: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        # Files are rows of: id is null, id, last state was published, time of it. Events: id is null, id, time, event, leads to published.
        now, keep = state.getCurrentWatermarkMs() * 1000, keep_days * _DAY_US
        known, held = np.empty((0, 4), np.int64), []
        if state.exists:
            files, packed = state.get
            known, held = np.frombuffer(files, np.int64).reshape(-1, 4), [np.frombuffer(packed, np.int64).reshape(-1, 5)]
        if not state.hasTimedOut:
            held += [np.column_stack([rows[c].to_numpy() for c in ("none", "file", "at", "event_id", "to")]) for rows in frames]
        events = np.concatenate(held)
        due = events[:, 2] <= now
        waiting, ready = events[~due], events[due]
        # A file's state goes before its events; each event is held against the row before it.
        rows = np.concatenate([known[:, [0, 1, 3, 3, 2]], ready])
        event = np.arange(len(rows)) >= len(known)
        order = np.lexsort((rows[:, 3], rows[:, 2], event, rows[:, 1], rows[:, 0]))
        rows, event = rows[order], event[order]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        to = rows[:, 4] == 1
        found = rows[event & to & (first | ~np.concatenate([[False], to[:-1]])[: len(to)])]
        known = rows[np.concatenate([first[1:], [True]])[: len(rows)]][:, [0, 1, 4, 2]]
        null = waiting[:, 0] == 1
        awaited = np.where(known[:, 0] == 1, null.any(), np.isin(known[:, 1], waiting[~null, 1]))
        stays = awaited | (known[:, 3] + keep > now)
        known, awaited = known[stays], awaited[stays]
        if len(waiting) or len(known):
            state.update((known.tobytes(), waiting.tobytes()))
            wake = int(np.concatenate([waiting[:, 2], known[~awaited, 3] + keep]).min())
            state.setTimeoutTimestamp(max(wake, now) // 1000 + 1)
        else:
            state.remove()
        if len(found):
            yield pd.DataFrame({"file_id": pd.arrays.IntegerArray(found[:, 1].copy(), found[:, 0] == 1), "event_id": found[:, 3]})

    group = F.pmod(F.xxhash64("file_id"), F.lit(groups)).alias("part")
    rows = events.select(
        group, F.isnull("file_id").cast("long").alias("none"), F.coalesce(F.col("file_id").cast("long"), F.lit(0)).alias("file"), "event_id", "ts",
        F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 62))).alias("at"), F.coalesce(F.col("state") == "published", F.lit(False)).cast("long").alias("to"),
    )
    return rows.withWatermark("ts", delay).groupBy("part").applyInPandasWithState(changes, "file_id long, event_id long", "files binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)


def run_progress(events: DataFrame, delay: str = "1 day", keep_days: int = KEEP_DAYS) -> DataFrame:
    """run_id, stage, overall of runs with new events, in update mode: the batch form's rows, of which the last per run counts.

    events: run_id, ts, event_id, stage, idx, stage_progress, stage_status. Only a run's latest event is kept, until `keep_days` of event time have passed without one.
    """

    def latest(key, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        best = tuple(state.get) if state.exists else None
        for rows in frames:
            times = rows["ts"].astype("datetime64[us]").astype("int64")
            for row in zip(times.tolist(), *(rows[c].tolist() for c in ("event_id", "stage", "idx", "stage_progress", "stage_status")), strict=True):
                best = row if best is None or row[:2] > best[:2] else best
        state.update(best)
        state.setTimeoutTimestamp(max((best[0] + keep_days * _DAY_US) // 1000, state.getCurrentWatermarkMs() + 1))
        _, _, stage, idx, progress, status = best
        yield pd.DataFrame([(key[0], stage, (idx + 1) * 20 if status == "completed" else int((idx * 20 + progress * 0.2) // 1))], columns=["run_id", "stage", "overall"])

    held = "ts long, event_id long, stage string, idx int, stage_progress int, stage_status string"
    rows = events.select("run_id", "ts", "event_id", "stage", "idx", "stage_progress", "stage_status").withWatermark("ts", delay)
    return rows.groupBy("run_id").applyInPandasWithState(latest, "run_id long, stage string, overall long", held, "update", GroupStateTimeout.EventTimeTimeout)


def dedupe_uploads(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first upload of each checksum within the watermark."""
    return files.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(["checksum"])
