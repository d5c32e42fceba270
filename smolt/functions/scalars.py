"""Scalar column functions (survey 2.9), all JVM-side built-ins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit of ``difftime(..., units=)``.
UNIT_SECONDS = {"secs": 1.0, "mins": 60.0, "hours": 3600.0, "days": 86400.0,
                "weeks": 604800.0}

# Tokens read as missing in numeric text columns (survey 2.1 null_tokens).
NULL_TOKENS = ("", "na", "NA", "n/a", "N/A", "NaN")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens(c, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Blank / ``na`` style tokens become NULL (trimmed, case-insensitive)."""
    c = _col(c)
    t = F.trim(c.cast("string"))
    low = {x.lower() for x in tokens}
    return F.when(F.lower(t).isin(sorted(low)) | t.isNull(), F.lit(None)).otherwise(t)


def paste(*cols, sep: str = " ") -> Column:
    """R ``paste``: NULL prints as the text ``NA`` (``concat_ws`` would skip it)."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def strip_prefix(c, sep: str = "-") -> Column:
    """``gsub('.*-', '', x)``: text after the last separator (greedy)."""
    return F.try_element_at(F.split(_col(c), re.escape(sep), -1), F.lit(-1))


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """``ymd`` / ``as.Date(format=)``: invalid dates (Feb 30) become NULL."""
    return F.try_to_date(_col(c).cast("string"), fmt)


def parse_ts(c, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm",
                                          "yyyy-MM-dd h:mm:ss a", "yyyy-MM-dd H:mm"),
             zone: str | None = None) -> Column:
    """First format that parses wins; ``zone`` names the zone of the clock text.

    The session clock is UTC, so a clock time recorded in a local zone is
    re-labelled with ``to_utc_timestamp`` (``force_tz``).
    """
    s = F.trim(_col(c).cast("string"))
    ts = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
    return tz_relabel(ts, zone) if zone else ts


def tz_relabel(c, zone: str) -> Column:
    """``force_tz``: keep the clock reading, declare it to be in ``zone``."""
    return F.to_utc_timestamp(_col(c), zone)


def tz_convert(c, zone: str) -> Column:
    """``with_tz``: same instant, clock reading of ``zone`` (display only)."""
    return F.from_utc_timestamp(_col(c), zone)


def epoch_micros(c) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column.

    NTZ values are read as UTC clock readings (the session zone is UTC).
    """
    return F.unix_micros(_col(c).cast("timestamp"))


def timediff(later, earlier, units: str = "secs") -> Column:
    """``difftime(later, earlier, units)`` as a double in ``units``."""
    k = UNIT_SECONDS[units]
    micros = epoch_micros(later) - epoch_micros(earlier)
    return micros.cast("double") / F.lit(k * 1e6)


def day_of_year(c) -> Column:
    return F.dayofyear(_col(c))


def recode(c, mapping: Mapping[str, str]) -> Column:
    """``fct_recode(x, new = 'old')``: mapped values replaced, others kept.

    ``mapping`` is old -> new. The literal map is folded into the plan;
    large label maps should be a broadcast join instead.
    """
    c = _col(c)
    if not mapping:
        return c
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def ceil_int(c) -> Column:
    return F.ceil(_col(c)).cast("long")


def inverse_logit(c) -> Column:
    """``plogis(x) = 1 / (1 + exp(-x))``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(c)))


def unit_speed(distance, seconds, body_length: float | None = None,
               per: str = "secs") -> Column:
    """Distance per time; optional body-length scaling; zero time -> NULL.

    R returns Inf for a zero time; a NULL is the relational equivalent.
    """
    d = _col(distance).cast("double")
    if body_length is not None:
        d = d / F.lit(float(body_length))
    t = _col(seconds).cast("double") / F.lit(UNIT_SECONDS[per])
    return F.try_divide(d, F.nullif(t, F.lit(0.0)))
