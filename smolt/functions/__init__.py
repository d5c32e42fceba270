"""Column expressions with the NULL, time and recoding rules of the survey."""

from smolt.functions.nullsafe import (
    count_distinct_na, if_else, isin_safe, not_in_safe, null_or_in, sum_strict,
)
from smolt.functions.scalars import (
    ceil_int, day_of_year, inverse_logit, paste, parse_date, parse_ts,
    recode, strip_prefix, timediff, tz_convert, tz_relabel, unit_speed,
    null_tokens,
)

__all__ = [
    "count_distinct_na", "if_else", "isin_safe", "not_in_safe", "null_or_in",
    "sum_strict", "ceil_int", "day_of_year", "inverse_logit", "paste",
    "parse_date", "parse_ts", "recode", "strip_prefix", "timediff",
    "tz_convert", "tz_relabel", "unit_speed", "null_tokens",
]
