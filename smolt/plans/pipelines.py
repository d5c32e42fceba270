"""Named end-to-end pipelines (survey 2.13) as DataFrame-in/-out functions.

Each takes the tables it needs and the parameters the reference hard-codes
(thresholds, site sets, labels) and returns a lazy DataFrame; the query
catalogue binds them to the driver tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smolt.functions.nullsafe import count_distinct_na, isin_safe, not_in_safe, sum_strict
from smolt.functions.scalars import parse_date, recode, timediff
from smolt.operators import aggregates as A
from smolt.operators import joins as J
from smolt.operators import movement as M
from smolt.operators import reshape as R
from smolt.operators import windows as W


def pit_recapture(releases: DataFrame, recaptures: DataFrame, key: str, release_ts: str,
                  sample_ts: str, treatment: str, max_elapsed: float = 60.0,
                  units: str = "mins", exclude: Sequence[str] = (),
                  control: Sequence[str] = ("control",), control_label: str = "control",
                  treated_label: str = "archimedes") -> DataFrame:
    """Match recaptures to releases by tag, keep those sampled within
    ``max_elapsed`` (strictly less) of release, drop excluded treatments
    and label the release group."""
    j = recaptures.join(releases, key, "inner")
    return label_recaptures(j, release_ts, sample_ts, treatment, max_elapsed, units, exclude, control, control_label, treated_label)


def label_recaptures(matched: DataFrame, release_ts: str, sample_ts: str, treatment: str, max_elapsed: float = 60.0,
                     units: str = "mins", exclude: Sequence[str] = (), control: Sequence[str] = ("control",),
                     control_label: str = "control", treated_label: str = "archimedes") -> DataFrame:
    """Elapsed time, filters and release group of matched recaptures."""
    j = matched.withColumn("time_diff", timediff(F.col(sample_ts), F.col(release_ts), units))
    j = j.filter(F.col("time_diff") < F.lit(float(max_elapsed)))
    j = j.filter(not_in_safe(treatment, exclude))
    return j.withColumn("release_group", F.when(isin_safe(treatment, control), F.lit(control_label))
                        .otherwise(F.lit(treated_label)))


def pit_best_match(releases: DataFrame, recaptures: DataFrame, key: str, release_ts: str, sample_ts: str,
                   treatment: str, max_elapsed: float = 60.0, units: str = "mins", **how) -> DataFrame:
    """``pit_recapture`` where ids repeat: each recapture is matched to one
    release, the last of its id at or before the sample (ties by treatment,
    then by the other columns of ``releases``)."""
    rest = [c for c in releases.columns if c not in (key, release_ts, treatment)]
    best = J.last_before(recaptures, releases, key, sample_ts, release_ts, [treatment, *rest])
    best = best.where(F.col(release_ts).isNotNull())
    return label_recaptures(best, release_ts, sample_ts, treatment, max_elapsed, units, **how)


def injury_summary(recap: DataFrame, treatment: str, injury_cols: Sequence[str],
                   control: Sequence[str] = ("control",)) -> DataFrame:
    """Injury totals per injury x (control, pump), wide (``spread``).

    ``sum`` without ``na.rm``: a NULL flag makes the total NULL, as in R.
    """
    pump = F.when(isin_safe(treatment, control), F.lit("control")).otherwise(F.lit("pump"))
    long = R.unpivot_long(recap.select(pump.alias("pump"), *injury_cols), ["pump"],
                          key="injury", value="value")
    t = long.groupBy("injury", "pump").agg(sum_strict("value").alias("total"))
    return t.groupBy("injury").pivot("pump", ["control", "pump"]).agg(F.first("total"))


def scale_loss_classes(recap: DataFrame, treatment: str, klass: str,
                       control: Sequence[str] = ("control",)) -> DataFrame:
    pump = F.when(isin_safe(treatment, control), F.lit("control")).otherwise(F.lit("pump"))
    return recap.groupBy(pump.alias("pump"), F.col(klass).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def tag_release_meta(tags: DataFrame, events: DataFrame, keys: Sequence[str],
                     location: str, size: str, tag: str = "tag") -> DataFrame:
    """Full join of tag deployments and release events on the event key,
    then distinct tags (NULL counted, as ``length(unique())``) and mean
    size per release location."""
    j = J.full_join(tags, events, keys)
    return j.groupBy(location).agg(count_distinct_na(tag).alias("n_tags"),
                                   F.avg(size).alias("mean_size"))


def detection_clean(det: DataFrame, study_tags: DataFrame, releases: DataFrame,
                    sites: DataFrame, fish: DataFrame, bench_sites: Sequence[str] = (),
                    floodgate_sites: Sequence[str] = (), min_gap_secs: float = 45.0) -> DataFrame:
    """Cleaned detections (reference order of steps): study tags only, bench
    receivers out, after the tag's own release; one-pass gap filter and
    recomputed gap; site metadata and release group joined; floodgate
    receivers dropped last."""
    d = J.semi_join(det, study_tags, "tag")
    d = d.filter(not_in_safe("site", bench_sites))
    d = J.join_after(d, releases, "tag", "ts", "release_ts").drop("release_ts")
    d = M.gap_filter(d, min_gap_secs)
    d = J.join_dim(d, sites, "site").join(fish, "tag", "inner")
    return d.filter(not_in_safe("site", floodgate_sites))


def receiver_overlap(det: DataFrame, fish: DataFrame, site_a: str,
                     other: DataFrame) -> DataFrame:
    """Tags heard on receiver ``site_a`` but never in ``other``, counted by
    release group."""
    a = det.filter(F.col("site") == site_a).select("tag").distinct()
    only = J.anti_join_keep_null(a, other.select("tag"), "tag")
    return A.count_distinct(only.join(fish, "tag"), ["release_group"], "tag", "n_tags",
                            na_as_value=False)


def upstream_artifact_filter(det: DataFrame, up_sites: Sequence[str],
                             down_sites: Sequence[str], artifact_sites: Sequence[str]) -> DataFrame:
    """Drop upstream hits that follow a downstream one (signal carried
    through the floodgate): ``!(site %in% S & move_dir %in% 'UP')``."""
    d = M.direction(det, up_sites, down_sites)
    return d.filter(~(isin_safe("site", artifact_sites) & isin_safe("move_dir", ["UP"])))


def merge_arrays(local: DataFrame, river: DataFrame, releases: DataFrame,
                 river_label: str, release_label: str) -> DataFrame:
    """Local receivers + river-array detections + one release row per tag,
    stacked by name (``bind_rows`` / ``rbind``)."""
    loc = local.select("tag", "ts", F.col("site").alias("receiver"),
                       F.col("site").alias("location_site"), F.lit("local").alias("site_label"),
                       F.lit("detection").alias("type"))
    riv = river.select("tag", "ts", F.col("site").alias("receiver"),
                       F.upper("site").alias("location_site"), F.lit(river_label).alias("site_label"),
                       F.lit("detection").alias("type"))
    rel = releases.select("tag", F.col("release_ts").alias("ts"), F.lit("release").alias("receiver"),
                          F.lit(release_label).alias("location_site"),
                          F.lit(release_label).alias("site_label"), F.lit("release").alias("type"))
    return R.union_fill(loc, riv).unionByName(rel)


def detection_summary(merged: DataFrame, fish: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Distinct tags by location x release group, spread wide (a cell with
    no tag is NULL, as ``spread`` leaves it)."""
    j = merged.join(fish, "tag")
    c = j.groupBy("location_site", "release_group").agg(F.count_distinct("tag").alias("n"))
    return c.groupBy("location_site").pivot("release_group", list(groups)).agg(F.first("n"))


def non_study_tags(det: DataFrame, study_tags: DataFrame, sensor_cond,
                   drop_sites: Sequence[str] = ()) -> DataFrame:
    """Foreign tags heard more than once, with a sensor flag."""
    d = det.filter(not_in_safe("site", drop_sites))
    foreign = J.anti_join_keep_null(d, study_tags.select("tag"), "tag")
    counts = A.having_count(foreign, ["tag"], 1)
    sensors = foreign.filter(sensor_cond).select("tag")
    return J.exists_flag(counts, sensors, "tag", "sensor")


def residence_summary(det: DataFrame) -> DataFrame:
    """Per tag x site first/last detection and span (hours); median, min,
    max span per site (grouped by the site name, never by a double rkm)."""
    fl = A.first_last(det, ["tag", "site", "rkm"], "ts", "hours")
    return A.median_min_max(fl, ["site", "rkm"], "duration")


def long_residence_followup(det: DataFrame, site: str, min_hours: float,
                            later_sites: Sequence[str]) -> DataFrame:
    """Tags staying longer than ``min_hours`` at ``site`` and where they
    were detected further downstream (count per tag x site)."""
    fl = A.first_last(det, ["tag", "site"], "ts", "hours")
    stay = fl.filter((F.col("site") == site) & (F.col("duration") > min_hours)).select("tag")
    later = det.filter(isin_safe("site", later_sites))
    return A.count_rows(J.semi_join(later, stay, "tag"), ["tag", "site"])


def time_to_first(det: DataFrame, releases: DataFrame, fish: DataFrame, site: str,
                  units: str) -> DataFrame:
    """Release -> first detection at ``site`` per tag (``join_first_event``)."""
    at = det.filter(F.col("site") == site).select("tag", "ts", "tie")
    first = W.first_per_group(at, ["tag"], "ts", "tie").select("tag", F.col("ts").alias("first_ts"))
    t = J.elapsed_since(first, releases, "tag", "first_ts", "release_ts", "elapsed", units)
    return t.join(fish, "tag")


def discharge_long(wide: DataFrame, ids: Sequence[str], months: Sequence[str],
                   month_codes: Mapping[str, str], min_year: int, threshold: float) -> DataFrame:
    """Daily series wide by month -> long; date from year-month-day text
    (impossible dates -> NULL), day of year, missing values dropped, and
    the plotting selection (year >= ``min_year`` and value > ``threshold``)."""
    long = R.unpivot_long(wide, list(ids), list(months), key="month", value="discharge")
    long = long.withColumn("month2", recode("month", month_codes))
    txt = F.concat_ws("-", F.col("YEAR").cast("string"), F.col("month2"),
                      F.lpad(F.col("DD").cast("string"), 2, "0"))
    long = long.withColumn("date2", parse_date(txt))
    long = long.withColumn("doy", F.dayofyear("date2")).filter(F.col("discharge").isNotNull())
    return long.withColumn("in_plot", (F.col("YEAR") >= min_year) & (F.col("discharge") > threshold))
