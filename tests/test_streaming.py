"""Streams over observations delivered again and out of order."""

from __future__ import annotations

import os

from graphweft.streaming import observations as streams

MINUTE = 60_000
START = 1_740_000_000_000


def test_attention_counts_each_id_once_in_order_of_time(spark, tmp_path):
    # one edit and reads a minute apart, latest first, each delivered twice, in two files
    told = [(k, "s", START + k * MINUTE, "t", "file:edit" if k == 2 else "file:read", "packages/a.ts") for k in range(5)]
    schema = "id long, session_id string, timestamp long, tool_name string, event string, file_path string"
    for part in (told[3:][::-1], told[::-1]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        for files in (1, 64):
            stream = streams.observation_stream(spark, str(tmp_path / "log"), files)
            found = streams.run_updates(streams.attention_weights(stream), ["session_id", "file_path"])
            assert [tuple(r) for r in found.collect()] == [("s", "packages/a.ts", 0.8, 5, True)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_attention_calls_python_once_a_session(spark, tmp_path):
    # 40 files of one session: one key of state; a file whose time is over is let go alone, though its session goes on
    told = [(k, "s", START + k, "t", "file:read", f"p/{k}.ts") for k in range(40)]
    late = [(100 + k, "s", START + k * 50 * 1_440 * MINUTE, "t", "file:read", "p/0.ts") for k in range(1, 5)] + [(200, "s", START + 200 * 1_440 * MINUTE, "t", "file:read", "p/1.ts")]
    schema = "id long, session_id string, timestamp long, tool_name string, event string, file_path string"
    for part in (told, *([r] for r in late)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    times = {p: k for k, p in enumerate(sorted((tmp_path / "log").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns))}
    for p, k in times.items():
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    states = lambda q: [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators if o.operatorName == "applyInPandasWithState"]
    stream = streams.attention_weights(streams.observation_stream(spark, str(tmp_path / "log"), 1))
    query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("memory").queryName("found").start()
    query.awaitTermination()
    assert max(states(query)) == 1
    got = {(r.file_path, r.accesses) for r in spark.table("found").collect()}
    assert got == {(f"p/{k}.ts", 1) for k in range(40)} | {("p/0.ts", n) for n in range(2, 6)}
