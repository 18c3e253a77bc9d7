"""Append-only ledgers as Structured Streaming jobs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def stage_status(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Current status of each (run_id, stage): its latest event. Update mode; rows later than ``lateness`` are left out."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy("run_id", "stage").agg(F.max_by("event", F.struct("at", "seq")).alias("status"), F.max("at").alias("at"))


def timed_state(events: DataFrame) -> None:
    """State with timers is kept in RocksDB. A stream that goes on from a checkpoint keeps the provider that it began with."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StuckStage(StatefulProcessor):
    """When a stage started, until it ends or ``wait`` milliseconds have passed: a timer for its end of patience."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "ms long")

    def forget(self) -> None:
        self.started.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the batches of a key come in no order
        last = None
        for b in rows:
            known = b[b.event.isin(["started", "finished", "failed"])].sort_values("seq")
            if len(known) and (last is None or known.seq.iloc[-1] > last.seq):
                last = known.iloc[-1]
        if last is not None:
            self.forget()
            if last.event == "started":
                ms = int(last["at"].timestamp() * 1000)
                self.started.update((ms,))
                self.handle.registerTimer(max(ms + self.wait, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.started.exists():
            (ms,) = self.started.get()
            self.started.clear()
            yield pd.DataFrame({"run_id": [key[0]], "stage": [key[1]], "started_ms": [ms]}).astype(object)

    def close(self) -> None:
        pass


def stuck_stages(events: DataFrame, after: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Append mode: a row for each stage that started and has no end when event time has passed ``after`` its start.

    The latest event of a batch decides. A stage that ended, or was reported, has neither state nor timer left.
    """
    timed_state(events)
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    grouped = timed.select("run_id", "stage", "event", "seq", "at").groupBy("run_id", "stage")
    wait = int(pd.Timedelta(after).total_seconds() * 1000)
    return grouped.transformWithStateInPandas(StuckStage(wait), "run_id string, stage string, started_ms long", "Append", "EventTime")


def append_once(rows: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends the rows of a stream to the table at ``path``, one for each key.

    The keys that the stream has met are its state, kept in RocksDB and restored after a restart, so a batch costs what its own keys cost,
    however many batches were before it. A batch has a folder of its own and replaces what it wrote if it runs again. Rows of other
    streams, or of one whose checkpoint was lost, stand in folders of their own; those alone are read to leave their keys out.
    """
    timed_state(rows)

    def sink(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        # the first line is the format's version in some files; the stream's id is in the one that is JSON
        lines = [r.value for r in spark.read.text(f"{checkpoint}/metadata").collect()]
        mine = f"stream={json.loads(next(x for x in lines if x.startswith('{')))['id']}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        others = [f"{path}/{x}" for x in ([f.getPath().getName() for f in files.listStatus(hadoop)] if files.exists(hadoop) else []) if x.startswith("stream=") and x != mine]
        if others:
            df = df.join(spark.read.option("basePath", path).parquet(*others).select(*keys), keys, "left_anti")
        df.write.mode("overwrite").parquet(f"{path}/{mine}/batch={batch}")

    return rows.dropDuplicates(keys).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remember_stream(verdicts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rejected findings (repository_id, fingerprint, blob, ...) into the table at ``path``, each once, also after a restart."""
    return append_once(verdicts.where("status = 'rejected'").drop("status"), path, checkpoint, ["repository_id", "fingerprint", "blob"])


def artifact_index_stream(blobs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly one row for each content (at, content) in the table at ``path``."""
    hashed = blobs.select(F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    return append_once(hashed, path, checkpoint, ["sha256"])


def cost_windows(invocations: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Token and cost sums per tumbling window and skill."""
    timed = invocations.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    sums = timed.groupBy(F.window("at", width), "skill").agg(F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("from_at"), "skill", "tokens", "cost_usd", "n")


def run_sessions(invocations: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    timed = invocations.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    sums = timed.groupBy(F.session_window("at", gap).alias("s"), "run_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return sums.select("run_id", F.col("s.start").alias("from_at"), F.col("s.end").alias("to_at"), "tokens", "n")


class RunBudget(StatefulProcessor):
    """A run's tokens, whether it was told that they pass ``cap``, and a timer that forgets it ``idle`` milliseconds after its last call."""

    def __init__(self, cap: int, idle: int):
        self.cap, self.idle = cap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "total long, told boolean, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, told, last = self.spent.get() if self.spent.exists() else (0, False, 0)
        for b in rows:
            total += int(b.tokens.sum())
            last = max(last, int(b["at"].max().timestamp() * 1000))
        over = total > self.cap and not told
        self.spent.update((total, told or over, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last + self.idle, timerValues.getCurrentWatermarkInMs() + 1))
        if over:
            yield pd.DataFrame({"run_id": [key[0]], "tokens": [total]}).astype(object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent.clear()
        yield from ()

    def close(self) -> None:
        pass


def budget_alerts(invocations: DataFrame, cap: int, idle: str = "7 days", lateness: str = "10 minutes") -> DataFrame:
    """Append mode: one row for each run whose token total passes ``cap``, as it does. A run without a call for ``idle`` of event time is
    over: its state goes, and a later call starts anew."""
    timed_state(invocations)
    timed = invocations.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    return timed.select("run_id", "tokens", "at").groupBy("run_id").transformWithStateInPandas(RunBudget(cap, wait), "run_id string, tokens long", "Append", "EventTime")
