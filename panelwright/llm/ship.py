"""Python on the executors: the package's own code goes along, so that workers need no installation."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

import panelwright

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark's own file distribution, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(panelwright.__file__).parent
    made = os.path.join(tempfile.mkdtemp(prefix="panelwright-code-"), "panelwright.zip")
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(made)
    _shipped.add(context.applicationId)


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in parts of at most so many bytes of text, or of one row, each with its texts (column `text`; a null is None).

    Only one part's texts are Python strings at a time.
    """
    sizes, at = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(), 0
    ends = np.cumsum(sizes, dtype=np.int64)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        part = batch.slice(at, to - at)
        yield part, strings(part.column(text))
        at = to


def strings(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def map_arrow(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
