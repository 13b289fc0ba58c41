"""Query registry: one column specification shapes both the Spark result and its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


# Both engines round by the same arithmetic. The offset lies just above one half, so that an exact tie
# and a tie that summation order moved by one unit in the last place round alike.
SCALE = {"f": 1e6, "m": 1e2}
TIE = 0.5001


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(p.split(":")) if ":" in p else (p, "s") for p in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """s string, i whole number, f number rounded to 6 places, m rounded to 2 places, d date."""
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind in "fm":
            c = F.floor(c.cast("double") * SCALE[kind] + F.lit(TIE)) / SCALE[kind]
        elif kind == "d":
            c = c.cast("date")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        if kind == "i":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind in "fm":
            out.append(f'FLOOR(CAST("{name}" AS DOUBLE) * {SCALE[kind]} + {TIE}) / {SCALE[kind]} AS "{name}"')
        elif kind == "d":
            out.append(f'CAST("{name}" AS DATE) AS "{name}"')
        else:
            out.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql}) AS shaped"


def with_ctes(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def query(name: str, spec: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a function from Tables to DataFrame together with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return shape(fn(Tables(spark, folder)), spec)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = shape_sql(with_ctes(sql, *ctes), spec)
        return fn

    return register
