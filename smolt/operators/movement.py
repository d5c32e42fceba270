"""Telemetry movement operators composed from the sequence windows.

All per-tag orderings use (ts, tie) so that simultaneous detections on
several receivers are ordered deterministically, and all go through
``windows.sequence_shift`` (one range exchange each, no task per tag).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smolt.functions.nullsafe import if_else, isin_safe, not_in_safe, null_or_in
from smolt.functions.scalars import paste, timediff, unit_speed
from smolt.operators import windows as W
from smolt.operators.aggregates import summarise_stats


def lag_timediff(df: DataFrame, tag: str = "tag", ts: str = "ts", tie: str = "tie",
                 out: str = "diff_time", units: str = "secs") -> DataFrame:
    """``difftime(ts, lag(ts), units)`` per tag (NULL on the first row)."""
    d = W.sequence_shift(df, [tag], ts, tie, lags={"__prev_ts": ts})
    return d.withColumn(out, timediff(F.col(ts), F.col("__prev_ts"), units)).drop("__prev_ts")


def lead_timediff(df: DataFrame, tag: str = "tag", ts: str = "ts", tie: str = "tie",
                  out: str = "time_next", units: str = "secs") -> DataFrame:
    """``difftime(lead(ts), ts, units)`` per tag (NULL on the last row)."""
    d = W.sequence_shift(df, [tag], ts, tie, leads={"__next_ts": ts})
    return d.withColumn(out, timediff(F.col("__next_ts"), F.col(ts), units)).drop("__next_ts")


def gap_filter(df: DataFrame, min_gap_secs: float = 45.0, tag: str = "tag", ts: str = "ts",
               tie: str = "tie", keep_first: bool = False) -> DataFrame:
    """Drop detections closer than ``min_gap_secs`` to the previous raw row
    of the same tag, then recompute the gap on the kept rows.

    One pass against the previous *raw* row (survey D4): a plain lag, no
    recursion. The first detection of a tag has no gap and is dropped
    unless ``keep_first`` (survey D3).
    """
    d = lag_timediff(df, tag, ts, tie, "__gap")
    cond = F.col("__gap") >= F.lit(float(min_gap_secs))
    if keep_first:
        cond = cond | F.col("__gap").isNull()
    kept = d.filter(cond).drop("__gap")
    return lag_timediff(kept, tag, ts, tie, "diff_time")


def transitions(df: DataFrame, site: str = "site", tag: str = "tag", ts: str = "ts",
                tie: str = "tie", prev: str = "prev_site", out: str = "transition") -> DataFrame:
    """``transition = ifelse(site == lag(site), F, T)``: NULL on a tag's
    first row (R's ``ifelse`` on NA)."""
    d = W.sequence_shift(df, [tag], ts, tie, lags={prev: site})
    return d.withColumn(out, if_else(F.col(site) == F.col(prev), False, True))


def direction(df: DataFrame, up_sites: Sequence[str], down_sites: Sequence[str],
              site: str = "site", tag: str = "tag", ts: str = "ts", tie: str = "tie") -> DataFrame:
    """``move_dir``: UP when the current site is upstream and the previous
    one downstream, else DOWN (``%in%`` never yields NA)."""
    d = W.sequence_shift(df, [tag], ts, tie, lags={"last_loc": site})
    up = isin_safe(site, up_sites) & isin_safe("last_loc", down_sites)
    return d.withColumn("move_dir", F.when(up, F.lit("UP")).otherwise(F.lit("DOWN")))


def movement_metrics(df: DataFrame, rkm: str = "rkm", site: str = "site", tag: str = "tag",
                     ts: str = "ts", tie: str = "tie", body_length_km: float = 0.0012) -> DataFrame:
    """Previous/next rkm, times, transition flag, distance and speeds."""
    d = W.sequence_shift(df, [tag], ts, tie,
                         lags={"__pts": ts, "prev_rkm": rkm, "__psite": site},
                         leads={"__nts": ts, "next_rkm": rkm})
    return d.select(
        *df.columns,
        timediff(F.col(ts), F.col("__pts")).alias("time_prev"),
        if_else(F.col(site) == F.col("__psite"), False, True).alias("transition"),
        "prev_rkm", "next_rkm",
        timediff(F.col("__nts"), F.col(ts)).alias("time_next"),
        (F.col("prev_rkm") - F.col(rkm)).alias("dist_traveled"),
    ).withColumns({
        "speed_bodyL_secs": unit_speed("dist_traveled", "time_prev", body_length_km),
        "time_diff_days": F.col("time_prev") / F.lit(86400.0),
        "speed_km_day": unit_speed("dist_traveled", "time_prev", per="days"),
    })


def segment_durations(df: DataFrame, upstream: Sequence[str], site: str = "site",
                      tag: str = "tag", ts: str = "ts", tie: str = "tie") -> DataFrame:
    """Time from the first detection at one site to the first detection at
    the next site, summarised per (to, from) pair.

    Transition rows only (``transition == TRUE``), lag again over them,
    statistics per pair; pairs into an upstream site or from NA/upstream
    are dropped after summarising, and the pair is labelled "from to to".
    """
    t = transitions(df, site, tag, ts, tie)
    t = t.filter(F.col("transition")).select(tag, site, ts, tie)
    s = W.sequence_shift(t, [tag], ts, tie, lags={"prev_location": site, "__pts": ts})
    s = s.select(F.col(site).alias("location_site"), "prev_location",
                 timediff(F.col(ts), F.col("__pts"), "days").alias("time_to"))
    g = summarise_stats(s, ["location_site", "prev_location"], "time_to")
    g = g.filter(not_in_safe("location_site", upstream)
                 & ~null_or_in("prev_location", upstream))
    return g.withColumn("prev_current", paste("prev_location", "location_site", sep=" to "))
