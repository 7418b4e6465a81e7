"""Alarms for entities that fall silent, and a word when they come back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds in the units of a gap.
_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}

STATE = "last bigint, alarmed boolean, pending array<bigint>"


def milliseconds(gap: str) -> int:
    """``1 day``, ``90 minutes`` and the like."""
    n, unit = gap.split()
    return int(n) * _UNITS[unit.removesuffix("s")]


def advance(last: int | None, alarmed: bool, pending: list[int], watermark: int, gap: int) -> tuple[int | None, bool, list[int], list[tuple[str, int, int]]]:
    """The state of an entity when no row before ``watermark`` can come any more, and what is to be told.

    Only rows before the watermark count, in order of time, so neither their order of arrival nor the cut of the
    batches matters. A silence is told once, at its deadline, and its end once.
    """
    told = []
    pending = sorted(pending)
    while pending and pending[0] < watermark:
        now = pending.pop(0)
        if last is not None and now >= last + gap:
            if not alarmed:
                told.append(("silent", last + gap, last))
            told.append(("resumed", now, last))
        last, alarmed = (now if last is None else max(last, now)), False
    if last is not None and not alarmed and last + gap <= watermark:
        told.append(("silent", last + gap, last))
        alarmed = True
    return last, alarmed, pending, told


def silences(events: DataFrame, ts: str, entity: str, gap: str = "1 day", lateness: str = "10 minutes", forget: str | None = None) -> DataFrame:
    """(entity, state, at, last_seen): ``silent`` when an entity has had no row for ``gap``, ``resumed`` when it has one again.

    An alarm needs no later row of the entity: a timer on event time speaks as soon as the watermark, moved by any
    entity, passes the deadline. A task holds the time of an entity's last row and of those that are still within
    ``lateness``. After a silence of ``forget`` (never, if None) the entity is dropped; its return is then a first row. Null entities
    are one entity, rows without a time are passed over. Times are rounded to milliseconds, half away from 1970, for rows and watermark alike.
    """
    wait, keep = milliseconds(gap), milliseconds(forget) if forget else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, alarmed, pending = state.get if state.exists else (None, False, [])
        pending = list(pending)
        if not state.hasTimedOut:
            for batch in batches:
                pending += batch["ms"].tolist()
        watermark = state.getCurrentWatermarkMs()
        last, alarmed, pending, told = advance(last, alarmed, pending, watermark, wait)
        # a timer speaks when the watermark is past it: a row counts then, a deadline counts when the watermark is at it
        due = ([pending[0]] if pending else []) + ([last + wait - 1] if last is not None and not alarmed else [])
        if not due and keep is not None:
            if last + wait + keep <= watermark:
                state.remove()
            else:
                due = [last + wait + keep - 1]
        if due or keep is None:
            state.update((last, alarmed, pending))
        if due:
            state.setTimeoutTimestamp(max(min(due), watermark))
        yield pd.DataFrame([(key[0], s, pd.Timestamp(a, unit="ms", tz="UTC"), pd.Timestamp(b, unit="ms", tz="UTC")) for s, a, b in told],
                           columns=[entity, "state", "at", "last_seen"])

    kind = events.schema[entity].dataType.simpleString()
    rounded = F.expr(f"round(unix_micros(`{ts}`), -3) div 1000")
    timed = events.filter(F.col(ts).isNotNull()).select(entity, rounded.alias("ms")).withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", lateness)
    return timed.groupBy(entity).applyInPandasWithState(
        step, f"`{entity}` {kind}, state string, at timestamp, last_seen timestamp", STATE, "append", GroupStateTimeout.EventTimeTimeout)
