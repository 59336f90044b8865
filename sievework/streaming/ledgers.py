"""Requests, batches and answers: at-most-once answers, outcomes of batches, expiry and silence, on batches and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANSWER = "request_id string, content string, ts timestamp"
OUTCOME = "request_id string, outcome string, reason string, content string"


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of answers (ANSWER) from JSON files that are put into a folder; files that are no JSON are passed over."""
    return spark.readStream.schema(ANSWER).option("mode", "DROPMALFORMED").json(folder)


def first_answers(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each request's first answer alone; later ones within the bound of the watermark are dropped."""
    marked = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return marked.dropDuplicatesWithinWatermark(["request_id"]) if stream.isStreaming else stream.dropDuplicates(["request_id"])


def answered(requests: DataFrame, stream: DataFrame) -> DataFrame:
    """Answers to requests that are asked (request_id, ...); others have no request and are left out."""
    return stream.join(requests, "request_id")


def classify_items(items: DataFrame, batches: DataFrame, results: DataFrame) -> DataFrame:
    """OUTCOME of every item: answered, or failed with the reason. No item is dropped.

    items: request_id, batch_id, custom_id; batches: batch_id, state (ended, expired, not_found, failed), reason; results:
    batch_id, custom_id, outcome, reason, content. A batch that is not listed has expired.
    """
    found = results.dropDuplicates(["batch_id", "custom_id"]).select("batch_id", "custom_id", F.col("outcome").alias("__o"), F.col("reason").alias("__r"), "content")
    held = batches.select("batch_id", F.col("state").alias("__s"), F.col("reason").alias("__why"))
    rows = items.join(held, "batch_id", "left").join(found, ["batch_id", "custom_id"], "left")
    failed = (
        F.when(F.coalesce("__s", F.lit("expired")) == "expired", "expired")
        .when(F.col("__s") == "not_found", "batch reference not found")
        .when(F.col("__s") == "failed", F.concat(F.lit("batch failed: "), F.coalesce(F.nullif("__why", F.lit("")), F.lit("provider rejected the batch"))))
        .when(F.col("__o").isNull(), "missing from results")
        .when(F.col("__o") != "succeeded", F.coalesce(F.nullif("__r", F.lit("")), "__o"))
    )
    rows = rows.withColumn("__f", failed)
    done = F.col("__f").isNull()
    return rows.select("request_id", F.when(done, "answered").otherwise("failed").alias("outcome"), F.col("__f").alias("reason"), F.when(done, F.coalesce("content", F.lit(""))).alias("content"))


def resume_checks(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """batch_id, decision: abandon where an item still asked for has another key than at submission, else resume."""
    met = recorded.join(current.select("request_id", F.col("key").alias("__now")), "request_id", "left")
    return met.groupBy("batch_id").agg(F.when(F.bool_or(F.coalesce(F.col("__now") != F.col("key"), F.lit(False))), "abandon").otherwise("resume").alias("decision"))


def expiring(stream: DataFrame, seconds: int) -> DataFrame:
    """A stream of OUTCOME from a stream of events (request_id, kind: submitted or answered, content, ts): a request is
    answered once, or failed as expired when the watermark has passed its time. State is one row a request, and goes with
    its outcome."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "failed", "expired", None)], columns=["request_id", "outcome", "reason", "content"])
            return
        rows = pd.concat(list(batches))
        done = rows[rows["kind"] == "answered"].sort_values("ts")
        if len(done):
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], "answered", None, done.iloc[0]["content"])], columns=["request_id", "outcome", "reason", "content"])
            return
        first = int(rows["ts"].min().timestamp() * 1000)
        state.update((first,))
        state.setTimeoutTimestamp(max(first + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    marked = stream.withWatermark("ts", "0 seconds")
    return marked.groupBy("request_id").applyInPandasWithState(step, OUTCOME, "first long", "append", GroupStateTimeout.EventTimeTimeout)


def silent_sessions(stream: DataFrame, seconds: int) -> DataFrame:
    """user_id, began, ended, events: runs of events with no silence longer than `seconds`; works on streams, where a run is
    given out when the watermark has passed its end."""
    rows = stream.withWatermark("ts", "0 seconds") if stream.isStreaming else stream
    by = rows.groupBy("user_id", F.session_window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return by.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")
