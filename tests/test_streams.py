"""Streams over files, also after a restart."""

from __future__ import annotations

import datetime as dt

from evigraph.streaming import ledgers as Z

T0 = dt.datetime(2024, 1, 1)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


EVENT = "run_id string, stage string, event string, seq long, at timestamp"


def test_stage_status_and_stuck_stages(spark, tmp_path):
    path = str(tmp_path / "e")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    put(spark, path, [("r", "a", "started", 1, at(0)), ("r", "b", "started", 2, at(1)), ("r", "a", "finished", 3, at(2))], EVENT)
    put(spark, path, [("r", "c", "started", 4, at(500))], EVENT)
    put(spark, path, [("r", "d", "started", 5, at(501))], EVENT)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    rows = drain(Z.stage_status(stream), "complete", "status")
    assert {r.stage: r.status for r in rows} == {"a": "finished", "b": "started", "c": "started", "d": "started"}
    assert {r.stage for r in drain(Z.stuck_stages(stream), "append", "stuck")} >= {"b"}


def test_stuck_stages_after_a_restart(spark, tmp_path):
    path, out, point = (str(tmp_path / n) for n in ("e", "o", "c"))
    at = lambda m: T0 + dt.timedelta(minutes=m)
    left = []

    def go(rows):
        put(spark, path, rows, EVENT)
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
        q = Z.stuck_stages(stream).writeStream.format("parquet").option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None)
        return {(r.stage, r.started_ms) for r in spark.read.parquet(out).collect()}

    ms = lambda m: int(at(m).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert go([("r", "a", "started", 1, at(0)), ("r", "b", "started", 2, at(1)), ("r", "a", "finished", 3, at(2))]) == set()
    # a started again, and the end of its first start comes too late to count
    assert go([("r", "a", "started", 5, at(6)), ("r", "a", "failed", 4, at(5))]) == set()
    # the watermark is at 90 now
    assert go([("r", "c", "started", 6, at(100))]) == {("b", ms(1)), ("a", ms(6))}
    assert go([("r", "c", "finished", 7, at(101))]) == {("b", ms(1)), ("a", ms(6))}
    assert left[-1] == 0


def test_remember_once_after_a_restart(spark, tmp_path):
    schema = "repository_id string, fingerprint string, blob string, status string"
    path, table, point = (str(tmp_path / n) for n in ("v", "t", "c"))
    put(spark, path, [("r", "f1", "b", "rejected"), ("r", "f1", "b", "rejected"), ("r", "f2", "b", "validated")], schema)
    for more in ([("r", "f1", "b", "rejected"), ("r", "f3", "b", "rejected")], []):
        Z.remember_stream(spark.readStream.schema(schema).parquet(path), table, point).awaitTermination(120)
        if more:
            put(spark, path, more, schema)
    assert sorted(r.fingerprint for r in spark.read.parquet(table).collect()) == ["f1", "f3"]
    # a batch of its own for each file, and keys of another stream stay out; one with a lost checkpoint starts anew and adds nothing
    put(spark, path, [("r", "f4", "b", "rejected")], schema)
    Z.remember_stream(spark.readStream.schema(schema).parquet(path), table, point + "2").awaitTermination(120)
    assert sorted(r.fingerprint for r in spark.read.parquet(table).collect()) == ["f1", "f3", "f4"]
    Z.remember_stream(spark.readStream.schema(schema).parquet(path), table, point).awaitTermination(120)
    assert spark.read.parquet(table).count() == 3


def test_artifacts_costs_and_budget(spark, tmp_path):
    path, table, point = (str(tmp_path / n) for n in ("b", "t", "c"))
    put(spark, path, [(T0, "x"), (T0, "x"), (T0, "y")], "at timestamp, content string")
    Z.artifact_index_stream(spark.readStream.schema("at timestamp, content string").parquet(path), table, point).awaitTermination(120)
    assert spark.read.parquet(table).count() == 2
    calls = str(tmp_path / "i")
    schema = "run_id string, skill string, tokens long, cost_usd double, at timestamp"
    put(spark, calls, [("r", "s", 60, 1.0, T0), ("r", "s", 50, None, T0 + dt.timedelta(minutes=5)), ("q", "s", 10, None, T0 + dt.timedelta(hours=2))], schema)
    stream = spark.readStream.schema(schema).parquet(calls)
    assert sorted((r.tokens, r.n) for r in drain(Z.cost_windows(stream), "complete", "costs")) == [(10, 1), (110, 2)]
    assert sorted((r.run_id, r.tokens) for r in drain(Z.run_sessions(stream), "complete", "sessions")) == [("q", 10), ("r", 110)]
    assert [(r.run_id, r.tokens) for r in drain(Z.budget_alerts(stream, 100), "append", "alerts")] == [("r", 110)]
