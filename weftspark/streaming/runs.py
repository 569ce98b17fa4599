"""Run state as a stream: unit events in, legal states and stale leases out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The states of a unit of work and what may follow each; a state that only leads to itself is final.
TRANSITIONS = {
    "": ("pending",),
    "pending": ("in_progress", "interrupted"),
    "in_progress": ("validated", "validated_with_content_issue", "candidate_isolated", "failed_transient", "hard_failed", "interrupted"),
    "failed_transient": ("in_progress", "interrupted"),
    "interrupted": ("in_progress",),
    "validated": ("validated",),
    "validated_with_content_issue": ("validated_with_content_issue",),
    "candidate_isolated": ("candidate_isolated",),
    "hard_failed": ("hard_failed",),
}
# The same for the earlier chunk states.
CHUNK_TRANSITIONS = {
    "": ("pending",),
    "pending": ("running", "interrupted"),
    "running": ("running", "succeeded", "failed_transient", "failed_deterministic", "interrupted"),
    "succeeded": ("validated", "failed_deterministic"),
    "failed_transient": ("running", "interrupted"),
    "interrupted": ("running",),
    "validated": ("validated",),
    "failed_deterministic": ("failed_deterministic",),
}
EVENT_SCHEMA = "unit_id string, state string, at timestamp, attempt int, payload string"
MOST_ATTEMPTS = 3


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events from JSON files that arrive in a folder."""
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def unit_states(events: DataFrame, lease_seconds: int = 30, watermark: str = "1 hour", transitions: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """Per accepted or refused event: unit_id, state, previous, outcome, attempt.

    A unit's events are taken in time order.  Illegal steps are refused and leave the state as it is; so is a final state
    with another payload.  A unit in progress without an event for lease_seconds of event time is interrupted.
    """

    def advance(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, attempt, payload = state.get if state.exists else ("", 0, "")
        out = []
        if state.hasTimedOut:
            if current in ("in_progress", "running"):
                out.append((key[0], "interrupted", current, "lease_expired", attempt))
                current = "interrupted"
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "attempt"], kind="stable")
            for row in rows.itertuples():
                body = row.payload or ""
                final = current and transitions[current] == (current,)
                if row.state not in transitions.get(current, ()) or (final and body != payload):
                    out.append((key[0], row.state, current, "refused", attempt))
                    continue
                started = row.state in ("in_progress", "running") and current != row.state
                if started and attempt >= MOST_ATTEMPTS:
                    out.append((key[0], row.state, current, "attempts_exhausted", attempt))
                    continue
                attempt += started
                out.append((key[0], row.state, current, "accepted", attempt))
                current, payload = row.state, body
            if current in ("in_progress", "running"):
                last = int(rows["at"].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(last + lease_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        state.update((current, attempt, payload))
        yield pd.DataFrame(out, columns=["unit_id", "state", "previous", "outcome", "attempt"])

    return (
        events.withWatermark("at", watermark)
        .groupBy("unit_id")
        .applyInPandasWithState(advance, "unit_id string, state string, previous string, outcome string, attempt int", "state string, attempt int, payload string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def claims(requests: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The first request of every client key within the watermark; repetitions are dropped.

    requests: client_key, business_key, cache_key, at.
    """
    execution = F.concat(F.lit("exec:"), F.left(F.sha2(F.concat_ws("\n", "client_key", "business_key", "cache_key"), 256), F.lit(24)))
    return requests.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["client_key"]).withColumn("execution_id", execution)


def activity(events: DataFrame, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Events per state and window of event time; late ones within the watermark still count."""
    return events.withWatermark("at", watermark).groupBy(F.window("at", window), "state").agg(F.count(F.lit(1)).alias("events")).select("window.start", "window.end", "state", "events")


def drain(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Everything that is there now, appended to Parquet files; run again, it goes on behind the last batch."""
    stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_incoming(spark: SparkSession, folder: str, process, checkpoint: str) -> None:
    """Hand every workbook that arrives in a folder to process(DataFrame of path and content, batch number), once each."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.xls[xm]").load(folder)
    files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
