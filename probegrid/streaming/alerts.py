"""Outage alerts while a job is silent, and recoveries, from a stream of heartbeats.

The one place of the library with Python state: Spark keeps the open spans of each
job and wakes them by an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from probegrid.functions.scalars import epoch_micros, from_event_time, interval_seconds
from probegrid.schema import OUTAGE_MINUTES
from probegrid.streaming.feeds import DELAY

FRESH_SECONDS = 60
#: Beats are reduced to the first and last of each such bucket before they are shuffled.
BUCKET = 60_000_000
EVENTS = "job_name string, event string, last_beat long, at long"
SPANS = "firsts array<long>, lasts array<long>, alerted boolean"


def merged(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Spans in order, joined where no more than ``gap`` lies between them."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def close_spans(spans: list[tuple[int, int]], alerted: bool, now: int, gap: int) -> tuple[list[tuple[int, int]], bool, list[tuple[str, int, int]]]:
    """(spans still open, whether the first one is alerted, events): what is certain at time ``now``."""
    events = []
    while spans and spans[0][1] + gap < now:
        last = spans[0][1]
        if not alerted:
            events.append(("alert", last, last + gap))
            alerted = True
        if len(spans) == 1:
            break
        events.append(("recovery", last, spans[1][0]))
        spans, alerted = spans[1:], False
    return spans, alerted, events


def _reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bucket = frame["micros"] // BUCKET
        ends = frame.groupby(["job_name", bucket])["micros"].agg(["min", "max"])
        flat = ends.reset_index(level="job_name").reset_index(drop=True)
        yield pd.concat([flat.rename(columns={c: "micros"})[["job_name", "micros"]] for c in ("min", "max")]).drop_duplicates()


def outage_events(beats: DataFrame, minutes: int = OUTAGE_MINUTES, delay: str = DELAY, ticks: DataFrame | None = None, seen: str | None = None, fresh_seconds: int = FRESH_SECONDS) -> DataFrame:
    """A stream of ``job_name, event, last_beat, at, silent_seconds`` from beats (job_name, ts).

    ``alert`` comes once for each silence above ``minutes``, as soon as the
    watermark is past ``last_beat`` + ``minutes`` (its ``at``), whether or not the
    job ever beats again. ``recovery`` comes with the beat that ends it. Time moves
    with the newest beat of any job; where all jobs may be silent at once, ``ticks``
    gives rows (ts) of a clock. With ``seen``, the column of arrival times, a beat
    that was ``fresh_seconds`` old or more when it arrived says nothing about the
    present: it neither ends an outage nor prevents one.

    State is a few spans per job, those the watermark has not passed. Beats of one
    job are reduced in the tasks that read them, so a busy job sends no more
    than two rows a minute from each.
    """
    gap = minutes * 60_000_000
    fresh = beats
    if seen is not None:
        fresh = beats.where(interval_seconds(F.col(seen) - F.col("ts")) < fresh_seconds)
    timed = fresh.where("ts is not null and job_name is not null").select("job_name", epoch_micros(F.col("ts")).alias("micros"))
    few = timed.mapInPandas(_reduced, "job_name string, micros long")
    if ticks is not None:
        few = few.unionByName(ticks.where("ts is not null").select(F.lit(None).cast("string").alias("job_name"), epoch_micros(F.col("ts")).alias("micros")))
    marked = few.withColumn("event_time", F.timestamp_micros("micros")).withWatermark("event_time", delay)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return  # ticks only move the watermark; a filter would be pushed below it
        spans, alerted = [], False
        if state.exists:
            firsts, lasts, alerted = state.get
            spans = list(zip(firsts, lasts, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                spans += [(t, t) for t in frame["micros"].tolist()]
        watermark = state.getCurrentWatermarkMs()
        spans, alerted, events = close_spans(merged(spans, gap), alerted, watermark * 1000, gap)
        state.update(([s[0] for s in spans], [s[1] for s in spans], alerted))
        if len(spans) > 1 or not alerted:
            state.setTimeoutTimestamp(max((spans[0][1] + gap) // 1000, watermark) + 1)
        if events:
            yield pd.DataFrame({"job_name": key[0], "event": [e[0] for e in events], "last_beat": [e[1] for e in events], "at": [e[2] for e in events]})

    found = marked.groupBy("job_name").applyInPandasWithState(follow, EVENTS, SPANS, "append", GroupStateTimeout.EventTimeTimeout)
    time = lambda c: from_event_time(F.timestamp_micros(c)).alias(c)
    silent = ((F.col("at") - F.col("last_beat")).cast("decimal(20,0)") / 1_000_000).cast("double")
    return found.select("job_name", "event", time("last_beat"), time("at"), F.when(F.col("event") == "recovery", silent).alias("silent_seconds"))


def ended_outages(events: DataFrame, minutes: int = OUTAGE_MINUTES) -> DataFrame:
    """Outages that have ended, from the table of events: as the batch form gives them."""
    threshold = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))
    return events.where("event = 'recovery'").select(
        "job_name", "last_beat", (F.col("last_beat") + threshold).alias("alert_at"), F.col("at").alias("recovered_at"), "silent_seconds")


def open_outages(events: DataFrame) -> DataFrame:
    """Alerts without a recovery: the jobs that are silent now."""
    ended = events.where("event = 'recovery'").select("job_name", "last_beat")
    return events.where("event = 'alert'").join(ended, ["job_name", "last_beat"], "left_anti").select("job_name", "last_beat", F.col("at").alias("alert_at"))
