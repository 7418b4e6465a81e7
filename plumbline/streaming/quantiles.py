"""Quantiles per window by mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch, and how far the rank of a quantile may lie from the wanted one at that size, as a share of the values.
SKETCH_SIZE, RANK_ERROR = 400, 0.01


def windowed_sketches(events: DataFrame, ts: str, keys: list[str], value: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, keys, n_values, sketch) of a stream or a table; a few kilobytes a row however many values it stands for.

    Null values count nowhere; a window without any has no sketch.
    """
    timed = events.withWatermark(ts, lateness) if events.isStreaming else events
    return timed.groupBy(F.window(ts, window), *keys).agg(
        F.count(value).alias("n_values"), F.kll_sketch_agg_double(value, SKETCH_SIZE).alias("sketch")
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n_values", "sketch")


def rolled_up(sketched: DataFrame, start: str, keys: list[str], grain: str) -> DataFrame:
    """The sketches merged to a coarser ``grain`` (day, week, month); the rank error stays that of one sketch."""
    return sketched.groupBy(F.date_trunc(grain, start).alias(start), *keys).agg(
        F.sum("n_values").alias("n_values"), F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"))


def quantile(sketch: str, p: float) -> Column:
    """A value whose rank is ``p`` within the error; null without values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))
