"""Sinks (survey 2.1): CSV with an optional row number, and the
frequency-history text deck."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smolt.operators.sorting import global_row_number


def sink_csv(df: DataFrame, path: str, order: Sequence[str] | None = None,
             row_number: bool = False, mode: str = "overwrite") -> None:
    """``write.csv(df, file)``: header row; with ``row_number`` a leading
    1..N column over ``order`` (range-partitioned numbering, no single
    task). Written in parallel, one part file per partition."""
    out = global_row_number(df, list(order), "row_id") if row_number else df
    if row_number:
        out = out.select("row_id", *df.columns)
    out.write.mode(mode).option("header", True).csv(path)


def history_deck_lines(freq_wide: DataFrame, count_cols: Sequence[str]) -> DataFrame:
    """``history n_g1 n_g2 ...;`` lines of a frequency table, one per row."""
    parts = [F.col("ch")] + [F.col(c).cast("string") for c in count_cols]
    return freq_wide.select(F.concat(F.concat_ws(" ", *parts), F.lit(";")).alias("line"))


def sink_history_freq(freq_wide: DataFrame, count_cols: Sequence[str], path: str,
                      mode: str = "overwrite") -> None:
    """Write the frequency-reduced histories as text lines."""
    history_deck_lines(freq_wide, count_cols).write.mode(mode).text(path)
