"""Rate limits and latest stages over a stream of events.

Windows of ``limited`` and ``charged`` are aligned to the clock, as in the store's rate-limit statement. ``answered``
gives every call of a stream its answer, by aligned windows or by windows that a first call opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sitelens.sources.tables import shared_folder

LIMIT, WINDOW, LATE = 3, "1 hour", "1 hour"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def limited(events: DataFrame, limit: int = LIMIT, window: str = WINDOW, late: str | None = LATE) -> DataFrame:
    """Hits of each user and aligned window, and how many of them are allowed; refusals are not charged.

    State is dropped once the watermark passes a window, so it is bounded by the users active within
    ``window`` and ``late``. Events later than that are not counted; with ``late`` None all are, and state grows with the windows.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    hits = timed.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("hits"))
    # A limit below one allows nothing.
    return hits.select("user_id", F.unix_seconds("w.start").alias("window_s"), "hits", F.least("hits", F.lit(max(0, limit)).cast("bigint")).alias("allowed"))


def charged(events: DataFrame, scope: str, key: str, seconds: int, limit: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Each call of a batch with its aligned window and whether it is allowed: the first ``limit`` of a scope, key and window are."""
    start = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds
    turn = F.row_number().over(Window.partitionBy(scope, key, "window_s").orderBy(ts, tie))
    return events.withColumn("window_s", start).withColumn("allowed", turn <= max(0, limit))


def latest_stages(events: DataFrame) -> DataFrame:
    """The newest event of each user and type in a stream, and how many there were; state is one row for each of these."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"), F.count("*").alias("n")).select("user_id", "event_type", "m.event_id", "n")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_MICROS = 1_000_000


class CallLimiter(StatefulProcessor):
    """Answers the calls of one scope and key: the first ``limit`` of a window are allowed, refusals are not charged.

    The state is one row: when the window began and how many calls it has allowed. A timer at the window's end removes
    it, so that state is bounded by the keys that call within a window and the watermark's delay. Calls of a batch are taken in
    order of time; one from before the window counts in it.
    """

    def __init__(self, seconds: int, limit: int, aligned: bool):
        self.size, self.limit, self.aligned = seconds * _MICROS, limit, aligned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, used bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        calls = sorted((r.micros is None, r.micros or 0, r.call is None, r.call or 0) for r in rows)
        known = self.window.get()
        start, used = known or (None, 0)
        for _, at, unnamed, call in calls:
            if start is None or at >= start + self.size:
                start, used = (at // self.size * self.size if self.aligned else at), 0
            allowed = used < self.limit
            used += allowed
            yield Row(scope=key[0], key=key[1], call=None if unnamed else call, window_us=start, allowed=allowed)
        if known is None or start != known[0]:
            if known is not None:
                self.handle.deleteTimer((known[0] + self.size) // 1000)
            self.handle.registerTimer((start + self.size) // 1000)
        self.window.update((start, used))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def answered(events: DataFrame, scope: str, key: str, call: str, seconds: int, limit: int, aligned: bool, late: str = LATE, ts: str = "ts") -> DataFrame:
    """A row for each call of a stream: scope, key, call, window_us (the window's start in microseconds) and allowed."""
    timed = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    calls = timed.select(F.col(scope).cast("string").alias("scope"), F.col(key).cast("string").alias("key"), F.col(call).cast("bigint").alias("call"), F.unix_micros("_at").alias("micros"), "_at")
    schema = "scope string, key string, call bigint, window_us bigint, allowed boolean"
    return calls.groupBy("scope", "key").transformWithState(CallLimiter(seconds, max(0, limit), aligned), outputStructType=schema, outputMode="Append", timeMode="EventTime")


@contextmanager
def many_states(spark: SparkSession):
    """State with timers needs the store that Spark keeps on disk."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def progress(stages: DataFrame, order: list[str]) -> DataFrame:
    """Of each audit the share of stages that are done and the one that runs."""
    names = F.array(*[F.lit(s) for s in order])
    done = F.count_if(F.col("status") == "done")
    return stages.groupBy("audit_id").agg((done / len(order)).alias("share"), F.max_by("stage", F.when(F.col("status") == "running", F.array_position(names, F.col("stage")))).alias("running"))


def drained(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs an updating stream over what is there; each key's row of its last batch."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    folder = f"{base}/stream-{uuid.uuid4().hex}"

    def upsert(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(upsert).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    others = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(limited(event_stream(spark, sf_dir), late=None), ["user_id", "window_s"])


def stream_latest_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(latest_stages(event_stream(spark, sf_dir)), ["user_id", "event_type"])


def stream_calls(spark: SparkSession, sf_dir: str, aligned: bool) -> DataFrame:
    """Every event as a call of its type and user, two an hour allowed."""
    with many_states(spark):
        rows = drained(answered(event_stream(spark, sf_dir), "event_type", "user_id", "event_id", 3600, 2, aligned), ["scope", "key", "call"], "append")
    return rows.select(F.col("call").alias("event_id"), "window_us", "allowed")
