"""The iteration counter of each branch, in batch and as a stateful stream.

Outcomes: countable adds one unless it is the change counted last; finished
forgets the branch; inconclusive changes nothing. Over the cap, it escalates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "branch string, seq long, change string, outcome string, count long, escalated boolean"


def advance(count: int, last: str | None, outcome: str, change: str) -> tuple[int, str | None]:
    if outcome == "countable":
        return (count, last) if last == change else (count + 1, change)
    if outcome == "finished":
        return 0, None
    return count, last


def _fold(part: pd.DataFrame, branch: str | None, count: int, last: str | None, cap: int) -> tuple[pd.DataFrame, str | None, int, str | None]:
    rows = []
    for row in part.itertuples(index=False):
        if row.branch != branch:
            branch, count, last = row.branch, 0, None
        count, last = advance(count, last, row.outcome, row.change)
        rows.append((row.branch, row.seq, row.change, row.outcome, count, count > cap))
    return pd.DataFrame(rows, columns=["branch", "seq", "change", "outcome", "count", "escalated"]), branch, count, last


def iterate(events: DataFrame, cap: int = 3) -> DataFrame:
    """Batch: events(branch, seq, change, outcome) with the counter after each.
    A branch's events are sorted by Spark and streamed through one fold with
    three values of state, so a branch of any length fits."""
    ordered = events.select("branch", "seq", "change", "outcome").repartition("branch").sortWithinPartitions("branch", "seq")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        branch, count, last = None, 0, None
        for part in parts:
            out, branch, count, last = _fold(part, branch, count, last, cap)
            yield out

    return ordered.mapInPandas(run, SCHEMA)


def iterate_stream(events: DataFrame, cap: int = 3) -> DataFrame:
    """Stream: the same with the counter kept as state of each branch."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, None)
        for part in parts:
            out, _, count, last = _fold(part.sort_values("seq"), key[0], count, last, cap)
            yield out
        if count or last:
            state.update((count, last))
        elif state.exists:
            state.remove()

    return events.select("branch", "seq", "change", "outcome").groupBy("branch").applyInPandasWithState(run, SCHEMA, "count long, last string", "append", GroupStateTimeout.NoTimeout)


def first_seen_stream(lines: DataFrame, line: str = "line", at: str = "at", late: str = "7 days") -> DataFrame:
    """Stream: each line once, within a watermark (idempotent redelivery)."""
    return lines.withWatermark(at, late).dropDuplicatesWithinWatermark([line])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Stream: events by window and key, late ones up to a bound."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("events"))
