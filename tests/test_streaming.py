from __future__ import annotations

import datetime as dt

from lodestack.streaming import monitor


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.sql(f"SELECT * FROM {name}").collect()]


def _files(spark, path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return monitor.read_stream(spark, f"{path}/*", schema, files_per_trigger=1)


def test_changes_only(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [[("a", at, "x"), ("b", at, "x"), ("a", at + dt.timedelta(hours=1), "x")], [("a", at + dt.timedelta(hours=2), "y"), ("a", at - dt.timedelta(days=1), "z")]]
    stream = _files(spark, str(tmp_path / "in"), rows, "k string, t timestamp, s string")
    got = _drain(monitor.changes_only(stream, "k", "t", "s"), "changes")
    assert sorted((k, s) for k, _, s in got) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_windows_and_first_decisions(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [[(at, "c", 1.0), (at + dt.timedelta(minutes=5), "c", 2.0)], [(at + dt.timedelta(hours=5), "c", 3.0)]]
    stream = _files(spark, str(tmp_path / "in"), rows, "t timestamp, kind string, v double")
    got = _drain(monitor.windowed_counts(stream, "t", "kind", "v"), "windows")
    assert got == [(at, "c", 2, 3.0)]
    firsts = _drain(monitor.first_decisions(stream, ["kind"], "t"), "firsts")
    assert len(firsts) == 1


def test_batches(spark, tmp_path):
    seen = []
    stream = _files(spark, str(tmp_path / "in"), [[(1,)], [(2,)]], "x int")
    monitor.run_batches(stream, str(tmp_path / "cp"), lambda df, i: seen.append(df.count())).awaitTermination(120)
    assert sum(seen) == 2
