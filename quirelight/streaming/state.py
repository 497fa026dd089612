"""Streaming jobs with state of their own for every key: limiters, leases, retries.

A job is a step over the key's rows in order of time; Spark keeps the state between micro-batches, and forgets it by a timer in event time once it can no longer matter.
Rows of one key have to come in order of time from batch to batch, as a log's files do; within a batch they are sorted.
State and results live in the folder that the caller names, so a job that was stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: (state, row) -> (state, rows of the result)
Step = Callable[[tuple, Any], tuple[tuple, list[tuple]]]


def walked(
    stream: DataFrame, key: str, micros: str, tie: str, late: str, start: tuple, step: Step, until: Callable[[tuple], int | None], ended: Callable[[tuple], list[tuple]] | None, state_schema: str, out_schema: str
) -> DataFrame:
    """What the steps over each key's rows give, led by the key.

    until(state) tells the time in microseconds after which the state no longer matters; when the watermark passes it, ended(state) gives the last
    rows, and the state goes.  Rows later than `late` behind the newest are dropped.
    """
    rows = stream.withColumn("_at", F.timestamp_micros(micros)).withWatermark("_at", late)
    names = [part.strip().split(" ")[0] for part in out_schema.split(",")]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = state.get if state.exists else start, []
        if state.hasTimedOut:
            out = ended(now) if ended else []
            state.remove()
        else:
            # all rows that a key has in this batch, in order; they are a bounded part of the stream
            for row in pd.concat(list(frames)).sort_values([micros, tie]).itertuples(index=False):
                now, made = step(now, row)
                out += made
            state.update(now)
            end = until(now)
            if end is not None:
                # no timer may lie behind the watermark
                state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(*group, *r) for r in out], columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def limited(stream: DataFrame, key: str, micros: str, tie: str, seconds: int, most: int, late: str) -> DataFrame:
    """(key, tie, accepted): as sequences.limited, over a stream; the state of a key is at most `most` times and goes once all are out of the window."""

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        at = getattr(row, micros)
        times = [t for t in state[0] if at - t <= seconds * 1_000_000]
        fine = len(times) < most
        return ([*times, at] if fine else times,), [(int(getattr(row, tie)), fine)]

    end = lambda state: max(state[0]) + seconds * 1_000_000 if state[0] else None
    kind = stream.schema[key].dataType.simpleString()
    return walked(stream, key, micros, tie, late, ([],), step, end, None, "times array<bigint>", f"{key} {kind}, {tie} bigint, accepted boolean")


def leased(stream: DataFrame, job: str, worker: str, action: str, micros: str, tie: str, seconds: int, attempts: int, late: str) -> DataFrame:
    """(job, tie, moment, outcome): what becomes of each action on a job, and where a lease runs out (tie is null then).

    claim: claimed, taken, or failed after so many attempts without a sign of life.  heartbeat: ok (the lease is longer now), lost (another one holds it) or
    unknown (nobody does).  finish: done, or lost.  A lease that nobody prolongs has run out, by the next action or by the timer, whichever is first.
    """
    lease = seconds * 1_000_000

    def out_of_time(state: tuple) -> tuple[tuple, list[tuple]]:
        holder, until, tries, failed = state
        return (-1, -1, tries, failed or tries >= attempts), [(None, until, "expired")]

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        at, who, what = int(getattr(row, micros)), int(getattr(row, worker)), getattr(row, action)
        state, out = out_of_time(state) if 0 <= state[1] < at else (state, [])
        holder, until, tries, failed = state
        if what == "claim":
            told = "failed" if failed else "taken" if until >= 0 else "claimed"
            state = (who, at + lease, tries + 1, failed) if told == "claimed" else state
        elif what == "heartbeat":
            told = "unknown" if until < 0 else "ok" if holder == who else "lost"
            state = (holder, at + lease, tries, failed) if told == "ok" else state
        else:
            told = "done" if until >= 0 and holder == who else "lost"
            state = (-1, -1, 0, failed) if told == "done" else state
        return state, [*out, (int(getattr(row, tie)), at, told)]

    kind = stream.schema[job].dataType.simpleString()
    # a job without a lease keeps its attempts, so only leases have a timer
    return _with_lease_timer(stream, job, micros, tie, late, step, out_of_time, f"{job} {kind}, {tie} bigint, moment bigint, outcome string")


def _with_lease_timer(stream: DataFrame, job: str, micros: str, tie: str, late: str, step: Step, out_of_time: Callable, out_schema: str) -> DataFrame:
    rows = stream.withColumn("_at", F.timestamp_micros(micros)).withWatermark("_at", late)
    names = [part.strip().split(" ")[0] for part in out_schema.split(",")]

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = tuple(state.get) if state.exists else (-1, -1, 0, False), []
        if state.hasTimedOut:
            if now[1] >= 0:
                now, out = out_of_time(now)
        else:
            for row in pd.concat(list(frames)).sort_values([micros, tie]).itertuples(index=False):
                now, made = step(now, row)
                out += made
        state.update(now)
        if now[1] >= 0:
            state.setTimeoutTimestamp(max(now[1] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(*group, *r) for r in out], columns=names).astype({tie: "Int64"})

    return rows.groupBy(job).applyInPandasWithState(run, out_schema, "holder bigint, until bigint, tries int, failed boolean", "append", GroupStateTimeout.EventTimeTimeout)


def retried(stream: DataFrame, key: str, ok: str, again: str, micros: str, tie: str, waits: Sequence[int], late: str) -> DataFrame:
    """(key, tie, attempts, status, wait): a purchase is ordered by its first success, fails when it may not be tried again or the waits are used up, and else waits; what comes after its end is left out."""

    def step(state: tuple, row: Any) -> tuple[tuple, list[tuple]]:
        tries, over = state
        if over:
            return state, []
        wait = waits[tries] if not getattr(row, ok) and getattr(row, again) and tries < len(waits) else None
        status = "ordered" if getattr(row, ok) else "open" if wait is not None else "failed"
        return (tries + 1, status != "open"), [(int(getattr(row, tie)), tries + 1, status, wait)]

    kind = stream.schema[key].dataType.simpleString()
    return walked(stream, key, micros, tie, late, (0, False), step, lambda state: None, None, "tries int, over boolean", f"{key} {kind}, {tie} bigint, attempts int, status string, wait bigint")


def first_uses(stream: DataFrame, ticket: Sequence[str], issued: str, at: str, seconds: int) -> DataFrame:
    """Uses of tickets that are no older than `seconds` and were not used before; a ticket is remembered for as long as it could be used again."""
    fresh = stream.filter(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(issued).cast("timestamp")) <= seconds * 1_000_000)
    timed = fresh.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{seconds} seconds")
    return timed.dropDuplicatesWithinWatermark(list(ticket))
