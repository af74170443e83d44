"""Growing logs and appended records: every line and record once, from the wanted start, in bounded batches."""

import json
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vigilframe.session import fresh_path
from vigilframe.sources import following, readers
from vigilframe.streaming import sinks


def lines_read(spark, path):
    return sorted(r["line"] for r in spark.read.parquet(path).collect())


def append(path, text):
    with open(path, "a", newline="") as file:
        file.write(text)


@pytest.mark.parametrize("split", [64 << 20, 16])
def test_tail_reads_appended_lines_once(spark, tmp_path, split):
    folder, out, state = tmp_path / "logs", fresh_path(spark, "tail"), fresh_path(spark, "tail-state")
    folder.mkdir()
    first, second = folder / "detection_log_1.txt", folder / "detection_log_2.txt"
    append(first, "one\r\ntwo\nhalf a li")
    append(folder / "other.log", "not this one\n")
    run = lambda: sinks.drain(following.follow_lines(spark, str(folder), "detection_log_*.txt", split_bytes=split), sinks.changelog(out), checkpoint=state)
    run()
    assert lines_read(spark, out) == ["one", "two"]
    append(first, "ne\nlong " + "x" * 100_000 + "\n")  # each run restarts from the checkpoint
    append(second, "\nnewer file, é東\n")
    run()
    run()
    want = ["", "half a line", "long " + "x" * 100_000, "newer file, é東", "one", "two"]
    assert lines_read(spark, out) == sorted(want)
    append(first, "late line in the older file\n")
    second.write_text("started anew, and it is longer than before\nwith two lines\n")
    run()
    assert lines_read(spark, out) == sorted([*want, "late line in the older file", "started anew, and it is longer than before", "with two lines"])


def test_tail_from_now_on(spark, tmp_path):
    out, state = fresh_path(spark, "now"), fresh_path(spark, "now-state")
    append(tmp_path / "a.txt", "old\nhalf")
    run = lambda: sinks.drain(following.follow_lines(spark, str(tmp_path), "*.txt", start="latest"), sinks.changelog(out), checkpoint=state)
    run()
    append(tmp_path / "a.txt", " and half\nnew\n")
    append(tmp_path / "b.txt", "newer\n")
    run()
    assert lines_read(spark, out) == ["half and half", "new", "newer"]


def test_tail_replays_a_lost_batch(spark, tmp_path):
    out, state = fresh_path(spark, "lost"), fresh_path(spark, "lost-state")
    append(tmp_path / "a.txt", "one\ntwo\n")

    def crash(df, batch_id):
        sinks.changelog(out)(df, batch_id)
        raise RuntimeError("lost before commit")

    lines = lambda: following.follow_lines(spark, str(tmp_path), "*.txt")
    with pytest.raises(Exception, match="lost before commit"):
        sinks.drain(lines(), crash, checkpoint=state)
    append(tmp_path / "a.txt", "three\n")
    sinks.drain(lines(), sinks.changelog(out), checkpoint=state)
    sinks.drain(lines(), sinks.changelog(out), checkpoint=state)
    assert lines_read(spark, out) == ["one", "three", "two"]


EVENTS = "seq long, name string"


def put(folder, name, first, n, age=0):
    os.makedirs(folder, exist_ok=True)
    pq.write_table(pa.table({"seq": pa.array(range(first, first + n), pa.int64()), "other": ["x"] * n, "name": [f"e{i}" for i in range(first, first + n)]}),
                   f"{folder}/{name}", row_group_size=7)
    at = time.time() - age
    os.utime(f"{folder}/{name}", (at, at))


def batches(spark, path):
    return [r["n"] for r in spark.read.parquet(path).groupBy("batch_id").count().withColumnRenamed("count", "n").orderBy("batch_id").collect()]


def test_records_come_in_batches_of_rows(spark, tmp_path):
    folder, out, state, note = str(tmp_path / "events"), fresh_path(spark, "rows"), fresh_path(spark, "rows-state"), fresh_path(spark, "rows-note")
    put(folder, "b.parquet", 0, 23, age=100)
    put(folder, "a.parquet", 23, 9, age=50)
    schema = spark.createDataFrame([], EVENTS).schema
    run = lambda: sinks.follow(following.follow_events(spark, folder, schema, rows_per_batch=10, progress=note), sinks.changelog(out), checkpoint=state)
    run()
    assert batches(spark, out) == [10, 10, 10, 2]
    put(folder, "c.parquet", 32, 12)
    run()  # a restart goes on where the last run stopped
    assert batches(spark, out) == [10, 10, 10, 2, 10, 2]
    rows = spark.read.parquet(out).orderBy("batch_id", "seq").collect()
    assert [r["seq"] for r in rows] == list(range(44)) and rows[40]["name"] == "e40"


def test_a_batch_leaves_its_records_and_no_mark(spark, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    put(folder, "a.parquet", 0, 25, age=50)
    schema = spark.createDataFrame([], EVENTS).schema
    sinks.follow(following.follow_events(spark, folder, schema, rows_per_batch=10), sinks.changelog(out))
    assert batches(spark, out) == [10, 10, 5]
    assert not [n for _, _, names in os.walk(out) for n in names if "_SUCCESS" in n]


def test_a_restart_without_a_note_finds_its_place(spark, tmp_path):
    folder, out, state = str(tmp_path / "events"), fresh_path(spark, "unnoted"), fresh_path(spark, "unnoted-state")
    put(folder, "a.parquet", 0, 25, age=50)
    schema = spark.createDataFrame([], EVENTS).schema
    start = json.dumps({"before": 0, "files": {"a.parquet": 5}})
    run = lambda: sinks.follow(following.follow_events(spark, folder, schema, start=start, rows_per_batch=8, progress=fresh_path(spark, "x")), sinks.changelog(out), checkpoint=state)
    run()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == list(range(5, 25))


def test_records_from_now_on(spark, tmp_path):
    folder, out, state, note = str(tmp_path / "events"), fresh_path(spark, "later"), fresh_path(spark, "later-state"), fresh_path(spark, "later-note")
    put(folder, "a.parquet", 0, 5, age=50)
    schema = spark.createDataFrame([], EVENTS).schema
    run = lambda: sinks.follow(following.follow_events(spark, folder, schema, start="latest", progress=note), sinks.changelog(out), checkpoint=state)
    run()
    put(folder, "b.parquet", 5, 13)
    run()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == list(range(5, 18))


def test_offsets_do_not_grow_with_the_history():
    hour, place = 3600 * 10**9, {"before": 0, "files": {}}
    files, read = [], 0
    for n in range(40):
        files.append((n * hour, f"f{n:02d}", 10))
        while (after := following.admitted(place, files, 4)) != place:
            read += sum(after["files"].values()) - sum(v for k, v in place["files"].items() if k in after["files"])
            gone = [k for k in place["files"] if k not in after["files"]]
            assert all(place["files"][k] == 10 for k in gone)
            place = after
            assert len(place["files"]) <= 3
    assert read == 400
