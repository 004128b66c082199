"""Streams against the batch forms of their jobs, with late, shuffled and repeated batches."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from lintel.operators import lake
from lintel.streaming import snapshots, streams

START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, frames, stream, name, mode="append"):
    """Rows of a stream over frames, one a micro-batch, with the number of the batch that gave them."""
    source = tmp_path / name
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(source))
    rows = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = []
    write = lambda batch, number: found.extend((number, *r) for r in batch.collect())
    query = stream(rows).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return found, query


def events_of(spark, rows):
    return spark.createDataFrame(rows, "file_id long, event_id long, ts timestamp, state string")


def test_publish_trigger_takes_events_in_their_order(spark, tmp_path):
    random = np.random.default_rng(2)
    rows = [(int(random.integers(0, 6)), i, START + dt.timedelta(minutes=int(random.integers(0, 900))), ["wip", "shared", "published", "published"][int(random.integers(0, 4))]) for i in range(240)]
    batch = {(r["file_id"], r["event_id"]) for r in lake.publish_trigger(events_of(spark, rows)).collect()}
    order = random.permutation(len(rows))
    parts = [events_of(spark, [rows[i] for i in order[k::5]]) for k in range(5)]
    closing = events_of(spark, [(-1, -1, START + dt.timedelta(days=9), "end")])
    found, _ = run(spark, tmp_path, [*parts, closing], lambda x: streams.publish_trigger(x, "1 day"), "events")
    assert {(r[1], r[2]) for r in found} == batch and len(found) == len(batch) > 20


def test_publish_trigger_waits_in_any_time_zone(spark, tmp_path):
    at = lambda hours: START + dt.timedelta(days=9, hours=hours)
    parts = [[(1, 1, at(24), "wip")], [(1, 2, at(2), "published")], [(1, 3, at(1), "published")], [(9, 9, at(24 * 60), "wip")]]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        trigger = lambda x: streams.publish_trigger(x, "1 day")
        found, _ = run(spark, tmp_path, [events_of(spark, x) for x in parts], trigger, "zoned")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    # The watermark is 9 days after the first batch: the second event waits, so that the third comes before it.
    assert [(r[1], r[2]) for r in found] == [(1, 3)]


def test_publish_trigger_forgets_and_drops(spark, tmp_path):
    at = lambda days: START + dt.timedelta(days=days)
    frames = [
        events_of(spark, [(1, 1, at(0), "published"), (2, 2, at(0), "wip")]),
        events_of(spark, [(2, 3, at(20), "wip")]),
        events_of(spark, [(1, 4, at(5), "wip")]),  # behind the watermark: dropped
        events_of(spark, [(2, 5, at(60), "wip")]),  # file 1 is forgotten
        events_of(spark, [(1, 6, at(70), "published"), (2, 7, at(71), "published")]),
        events_of(spark, [(3, 8, at(200), "end")]),
        events_of(spark, [(3, 9, at(400), "end")]),
    ]
    found, query = run(spark, tmp_path, frames, lambda x: streams.publish_trigger(x, "1 day", keep_days=30), "forgotten")
    assert sorted((r[1], r[2]) for r in found) == [(1, 1), (1, 6), (2, 7)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # the file of the last events alone


def test_run_progress_keeps_the_latest(spark, tmp_path):
    row = lambda run, minute, event, stage, idx, part, status="running": (run, START + dt.timedelta(minutes=minute), event, stage, idx, part, status)
    schema = "run_id long, ts timestamp, event_id long, stage string, idx int, stage_progress int, stage_status string"
    parts = [[row(1, 0, 1, "parse", 0, 50), row(2, 0, 2, "parse", 0, 99, "completed")], [row(1, 9, 4, "enrich", 2, 37), row(1, 5, 3, "validate", 1, 10)], [row(1, 7, 5, "validate", 1, 90), row(2, 60 * 24 * 90, 6, "package", 4, 0, "completed")]]
    frames = [spark.createDataFrame(x, schema) for x in parts]
    found, _ = run(spark, tmp_path, frames, streams.run_progress, "progress", "update")
    batch = {(r["run_id"], r["stage"], r["overall"]) for r in lake.run_progress(spark.createDataFrame(sum(parts, []), schema)).collect()}
    last = {}
    for _, run_id, stage, overall in found:
        last[run_id] = (run_id, stage, overall)
    assert set(last.values()) == batch == {(1, "enrich", 47), (2, "package", 100)}


def test_upsert_is_safe_to_repeat(spark, tmp_path):
    out, schema = str(tmp_path / "table"), "id long, v string, at int"
    rows = lambda x: spark.createDataFrame(x, schema)
    now = lambda: sorted((tuple(r) for r in snapshots.read(spark, out, schema).collect()), key=str)
    assert now() == []
    batches = [[(1, "a", 1), (2, "b", 1), (None, "x", 1)], [(1, "c", 2), (1, "d", 0), (3, "e", None), (2, "b2", 1)], [(1, "old", 1), (3, "f", 0)]]
    after = [[(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (2, "b2", 1), (3, "e", None)], [(1, "c", 2), (2, "b2", 1), (3, "f", 0)]]
    for n, (batch, want) in enumerate(zip(batches, after, strict=True)):
        for _ in range(2):  # a batch that runs twice changes nothing
            snapshots.upsert(rows(batch), out, n, "id", ["at"], buckets=4)
            assert now() == sorted(want, key=str)
    snapshots.upsert(rows([]), out, 9, "id", ["at"], buckets=4)
    assert now() == sorted(after[-1], key=str)
    # A batch whose list of buckets is missing has not happened.
    rows([(7, "z", 1)]).withColumn("batch_", F.lit(8).cast("long")).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{out}/data/batch=8")
    assert now() == sorted(after[-1], key=str)


def test_ingest_keeps_the_last_of_each_key(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    job = lambda b: b.withColumn("n", F.length("v"))
    go = lambda: streams.ingest(spark, str(source), "id long, v string", job, out, str(tmp_path / "c"), files_at_once=1).awaitTermination()
    (source / "1.json").write_text("\n".join(json.dumps({"id": i % 3, "v": "x"}) for i in range(6)))
    go()
    (source / "2.json").write_text(json.dumps({"id": 1, "v": "later"}))
    go()
    assert sorted(map(tuple, snapshots.read(spark, out, "id long, v string, n int").collect())) == [(0, "x", 1), (1, "later", 5), (2, "x", 1)]
    files = tmp_path / "files"
    (files / "a").mkdir(parents=True)
    (files / "a" / "m.ifc").write_bytes(b"ISO-10303-21;HEADER;FILE_SCHEMA(('IFC4'));")
    (files / "n.bin").write_bytes(bytes(range(256)))
    streams.ingest_files(spark, str(files), str(tmp_path / "catalogue"), str(tmp_path / "k")).awaitTermination()
    found = snapshots.read(spark, str(tmp_path / "catalogue"), "name string, category string, model_schema string, checksum string").collect()
    assert sorted((r["name"], r["category"], r["model_schema"], len(r["checksum"])) for r in found) == [("m.ifc", "bim_model", "IFC4", 64), ("n.bin", "other", None, 64)]


def test_dedupe_uploads(spark, tmp_path):
    files = spark.createDataFrame([(i, f"c{i % 3}", START + dt.timedelta(minutes=i)) for i in range(9)], "id long, checksum string, uploaded_at timestamp")
    found, _ = run(spark, tmp_path, [files.where("id < 5"), files.where("id >= 5")], streams.dedupe_uploads, "uploads")
    assert sorted(r[2] for r in found) == ["c0", "c1", "c2"]
