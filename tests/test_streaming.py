"""Streams: restarts, repeated batches, late windows."""

import pandas as pd

from ledgerloom.streaming import events


def write(folder, name, rows):
    pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "ts", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/{name}.parquet")


def stream(spark, folder):
    return spark.readStream.schema("event_id bigint, user_id bigint, event_type string, ts timestamp, value double").parquet(str(folder))


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    folder, base = tmp_path / "in", f"file://{tmp_path}/table"
    folder.mkdir()
    write(folder, "a", [(1, 7, "x", "2024-01-01", 1.0), (2, 7, "y", "2024-01-02", 1.0), (3, 8, "x", "2024-01-01", 1.0)])
    run = lambda: sorted((r["user_id"], r["event_id"]) for r in events.run_available(stream(spark, folder).select("user_id", "event_id"), ["user_id"], "event_id", base).collect())
    assert run() == [(7, 2), (8, 3)]
    assert run() == [(7, 2), (8, 3)]  # nothing new
    write(folder, "b", [(9, 8, "z", "2024-01-03", 1.0), (0, 7, "late", "2023-01-01", 1.0), (4, 9, "x", "2024-01-01", 1.0)])
    assert run() == [(7, 2), (8, 9), (9, 4)]


def test_windows_across_batches(spark, tmp_path):
    folder, base = tmp_path / "in", f"file://{tmp_path}/windows"
    folder.mkdir()
    write(folder, "a", [(1, 7, "x", "2024-01-01 00:10", 1.0), (2, 7, "x", "2024-01-01 00:20", 2.0)])
    counted = lambda: sorted((r["window_start"].hour, r["n"], r["total"]) for r in events.run_available(events.windowed_counts(stream(spark, folder)), ["window_start", "event_type"], base=base).collect())
    assert counted() == [(0, 2, 3.0)]
    write(folder, "b", [(3, 7, "x", "2024-01-01 00:50", 4.0), (4, 7, "x", "2024-01-01 05:00", 8.0)])
    assert counted() == [(0, 3, 7.0), (5, 1, 8.0)]
    write(folder, "c", [(5, 7, "x", "2024-01-01 00:55", 16.0)])
    assert counted() == [(0, 3, 7.0), (5, 1, 8.0)]  # beyond the watermark


def test_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert events.run_available(stream(spark, tmp_path / "in").select("user_id", "event_id"), ["user_id"], "event_id", f"file://{tmp_path}/t").count() == 0
