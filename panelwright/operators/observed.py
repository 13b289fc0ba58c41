"""Counts taken in the pass that does the work.

A metric rides on the rows as they go by (`DataFrame.observe`); it can be read once the caller's own job has run. Nothing
is counted a second time. Should a cluster compute a stage again after a loss, the rows of that stage ride by twice:
where a count must hold under such losses, take it from the written table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.cleaning import in_box


def run(df: DataFrame) -> None:
    """Every row and column of the plan, kept nowhere."""
    df.write.format("noop").mode("overwrite").save()


def observed_row(df: DataFrame, seen: Observation, columns: str) -> DataFrame:
    """The metrics of a finished job as a table of one row. columns: a schema string of their names."""
    names = [c.split()[0] for c in columns.split(",")]
    return df.sparkSession.createDataFrame([tuple(seen.get[n] for n in names)], columns)


def keep_in_box(df: DataFrame, lat: str, lon: str, box: Mapping[str, float], seen: Observation) -> DataFrame:
    """Rows with coordinates in the box; `seen` gets rows_read, missing_rows, outside_rows and removed_rows."""
    inside, missing = in_box(F.col(lat), F.col(lon), box), F.col(lat).isNull() | F.col(lon).isNull()
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("rows_read"), F.count_if(missing).alias("missing_rows"),
        F.count_if(~inside & ~missing).alias("outside_rows"), F.count_if(~inside).alias("removed_rows"),
    )
    return counted.where(inside)


def row_counts(before: DataFrame, build: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame], None] = run) -> DataFrame:
    """Rows before and after `build`, counted while `sink` takes the result once (Q06)."""
    first, last = Observation(), Observation()
    one: Column = F.count(F.lit(1))
    sink(build(before.observe(first, one.alias("n"))).observe(last, one.alias("n")))
    a, b = first.get["n"], last.get["n"]
    return before.sparkSession.createDataFrame([(a, b, int(a == b))], "rows_before long, rows_after long, row_count_preserved int")
