"""Stage status of running requests from start / complete / fail events.

The reading is order-exact but built only from minima and maxima over event order, per request and stage, so it
combines in the map tasks, merges across batches (see ``streaming.stages``) and never lines up one request's
events in one task. What makes that possible: an ending takes effect when its stage has started before it, and the
last ending of a stage takes effect exactly when any does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlgrain import fixed_values as V
from crawlgrain.functions.expr import non_empty, or_zero


def stage_facts(events: DataFrame) -> DataFrame:
    """Mergeable facts per (request_id, stage) from events(event_id, request_id, stage, action, ts_s, details)."""
    start, complete, fail = (F.col("action") == a for a in ("start", "complete", "fail"))
    status = F.when(fail, "failed").otherwise("completed")
    entry = lambda *cols: F.struct("event_id", *cols)
    return events.groupBy("request_id", "stage").agg(
        F.min(F.when(start, entry("ts_s", "details"))).alias("first_start"),
        F.max(F.when(start, F.col("event_id"))).alias("last_start"),
        F.count_if(start).alias("n_starts"),
        F.max(F.when(complete | fail, entry("ts_s", status.alias("status")))).alias("last_end"),
        F.max(F.when(fail | (complete & non_empty(F.col("details")).isNotNull()), entry("details"))).alias("last_note"),
        F.max(F.when(fail, entry("details"))).alias("last_fail"),
        F.max(F.when(complete, F.col("event_id"))).alias("last_complete"),
    )


def merge_facts(facts: DataFrame) -> DataFrame:
    """Facts of several batches -> facts of all of them."""
    largest = ["last_start", "last_end", "last_note", "last_fail", "last_complete"]
    return facts.groupBy("request_id", "stage").agg(
        F.min("first_start").alias("first_start"), F.sum("n_starts").alias("n_starts"),
        *[F.max(c).alias(c) for c in largest]).select(*facts.columns)


def _after_start(event_id: Column) -> Column:
    return F.coalesce(event_id > F.col("first_start.event_id"), F.lit(False))


def stage_progress(stage: Column) -> Column:
    """Percent reached when a stage starts; null for stages outside the fixed list."""
    steps = len(V.STAGES)
    return F.coalesce(*[
        F.when(stage == name, F.least(F.lit(95.0), F.lit(i / steps * 100))) for i, name in enumerate(V.STAGES)])


def request_status(facts: DataFrame) -> DataFrame:
    """Status, current stage, progress, message and error of each request."""
    finished = F.col("stage").isin(V.FINAL_STAGES) & _after_start(F.col("last_complete"))
    failed = _after_start(F.col("last_fail.event_id"))
    error = F.col("last_fail.details")
    verdict = F.greatest(
        F.when(failed, F.struct(
            F.col("last_fail.event_id").alias("event_id"), F.lit("failed").alias("status"),
            F.concat(F.lit("Failed during "), "stage", F.lit(": "), F.coalesce(error, F.lit("None"))).alias("message"))),
        F.when(finished, F.struct(
            F.col("last_complete").alias("event_id"), F.lit("completed").alias("status"),
            F.lit("Processing completed").alias("message"))))
    reached = stage_progress(F.col("stage"))
    progress = F.greatest(
        F.when(reached.isNotNull() & F.col("last_start").isNotNull(), F.struct(
            F.col("last_start").alias("event_id"), reached.alias("percent"))),
        F.when(finished, F.struct(F.col("last_complete").alias("event_id"), F.lit(100.0).alias("percent"))))
    is_first_entry = F.col("last_start") == F.col("first_start.event_id")
    newest = F.when(F.col("last_start").isNotNull(), F.struct(
        F.col("last_start").alias("event_id"), F.col("stage").alias("stage"),
        F.when(is_first_entry & _after_start(F.col("last_end.event_id")), F.col("last_end.ts_s")).alias("ended")))
    rolled = facts.groupBy("request_id").agg(
        F.max(verdict).alias("verdict"), F.max(progress).alias("progress"), F.max(newest).alias("newest"),
        F.max(F.when(failed, F.col("last_fail"))).alias("last_fail"),
        F.min(F.col("first_start")).alias("first_start"), F.sum("n_starts").alias("n_stages"))
    return rolled.select(
        "request_id",
        F.coalesce("verdict.status", F.lit("initializing")).alias("status"),
        F.col("newest.stage").alias("current_stage"),
        F.coalesce("progress.percent", F.lit(0.0)).alias("progress"),
        "n_stages",
        F.coalesce("verdict.message", F.lit("Request initialized")).alias("message"),
        F.col("last_fail.details").alias("error"),
        F.col("first_start.ts_s").alias("first_started"),
        F.col("newest.ended").alias("last_ended"),
    )


def stage_state(events: DataFrame) -> DataFrame:
    return request_status(stage_facts(events))


def stage_entries(events: DataFrame) -> DataFrame:
    """Every started stage. Endings belong to the first entry of a name, so they join on that entry's event id."""
    facts = stage_facts(events).filter(F.col("first_start").isNotNull())
    ended = _after_start(F.col("last_end.event_id"))
    endings = facts.select(
        "request_id", F.col("first_start.event_id").alias("event_id"),
        F.when(ended, F.col("last_end.ts_s")).alias("end_time"), F.when(ended, F.col("last_end.status")).alias("ended_as"),
        F.when(_after_start(F.col("last_note.event_id")), F.col("last_note.details")).alias("note"))
    starts = events.filter(F.col("action") == "start")
    return starts.join(endings, ["request_id", "event_id"], "left").select(
        "request_id", "event_id", "stage", F.col("ts_s").alias("start_time"), "end_time",
        (F.col("end_time") - F.col("ts_s")).alias("duration"),
        F.coalesce("ended_as", F.lit("in_progress")).alias("status"), F.coalesce("note", "details").alias("details"))


def latest_status(updates: DataFrame, attributes: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Newest non-null value of each attribute per request; ids never seen give a row of nulls."""
    newest = updates.groupBy("request_id").agg(
        *[F.max_by(a, F.when(F.col(a).isNotNull(), F.col("event_id"))).alias(a) for a in attributes])
    return newest if ids is None else ids.select("request_id").distinct().join(newest, "request_id", "left")


def expire_status(status: DataFrame, now: float) -> DataFrame:
    """Statuses that stay: begun at most 300 s ago, or not begun; finished ones go 60 s after their last stage."""
    begun = or_zero(F.col("n_stages")) > 0
    too_old = begun & (F.col("first_started") < now - V.STATUS_SECONDS)
    finished = begun & F.col("status").isin("completed", "failed") & (
        F.col("last_ended") < now - V.FINISHED_STATUS_SECONDS)
    return status.filter(~F.coalesce(too_old, F.lit(False)) & ~F.coalesce(finished, F.lit(False)))
