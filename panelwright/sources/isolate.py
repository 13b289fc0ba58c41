"""Part files read on their own account: a broken file or record costs itself only (A10)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .files import list_files

CORRUPT = "_corrupt_record"
#: A group of files with a broken one among them is tried again in so many parts at once.
WAYS = 8
STATUS = "path string, rows_read long, corrupt_rows long, has_header boolean"
ERROR_LENGTH = 2_000


@dataclass(frozen=True)
class Isolated:
    """rows: good records of readable files with their `source_file`; corrupt: the other records, as they stand;
    status: one row for each listed file (path, length, status, rows_read, corrupt_rows, error)."""

    rows: DataFrame
    corrupt: DataFrame
    status: DataFrame


def scan_isolated(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, fmt: str = "csv", pattern: str = "*", options: dict | None = None) -> Isolated:
    """Read all files below `paths`; those that Spark cannot read to the end are named, with the reason, and left out.

    One strict job reads everything; only if it fails is its list of files cut up again and again, in WAYS parts side by
    side, until the broken ones stand alone. Files are counted by the job that read them whole, so a file that breaks
    off late (a truncated archive) adds no rows. Records that do not fit the schema are kept apart.

    A CSV record is a line, read by the schema's order. A line with an odd number of quotes has one that was never
    closed and does not fit. A CSV file must have the schema's header; one without it is unreadable. With the option
    multiLine, records are what Spark's reader takes them for, by its own judgement alone.

    An unreadable file has null counts, one without records has none of either;
    files of no bytes are not listed. Raises FileNotFoundError if there is no file.
    """
    found = [list_files(spark, p, pattern) for p in ([paths] if isinstance(paths, str) else paths)]
    listed = stage(reduce(DataFrame.unionByName, found).select("path", "length").distinct())
    files = sorted(r["path"] for r in listed.select("path").collect())
    if listed.isEmpty():
        raise FileNotFoundError(f"no part files in {paths}")
    full, read = with_record(schema), _reader(spark, schema, fmt, options or {})
    counted, broken = attempt(files, lambda group: stage(_counts(read(group), schema)))
    counts = reduce(DataFrame.unionByName, counted, spark.createDataFrame([], STATUS))
    broken |= {r["path"]: f"no header line {','.join(schema.names)}" for r in counts.where("not has_header").select("path").collect()}

    known = spark.createDataFrame(list(broken.items()), "path string, error string").select(same_path("path").alias("_e"), "error")
    counts = counts.select(same_path("path").alias("_c"), "rows_read", "corrupt_rows")
    status = listed.join(counts, same_path("path") == F.col("_c"), "left").join(known, same_path("path") == F.col("_e"), "left")
    bad = F.col("error").isNotNull()
    zero = lambda c: F.when(~bad, F.coalesce(c, F.lit(0))).alias(c)
    status = status.select("path", "length", F.when(bad, "unreadable").otherwise("read").alias("status"), zero("rows_read"), zero("corrupt_rows"), "error")

    left_out = {plain_path(p) for p in broken}
    good = [f for f in files if plain_path(f) not in left_out]
    columns = [*schema.names, F.element_at(F.split("_path", "/"), -1).alias("source_file")]
    rows = read(good).where("not _header") if good else read(files[:1]).limit(0) if files else spark.createDataFrame([], full.toDDL() + ", _wrong boolean, _path string")
    return Isolated(rows.where("not _wrong").select(*columns), rows.where("_wrong").select(*columns, CORRUPT), status)


def _reader(spark: SparkSession, schema: T.StructType, fmt: str, options: dict) -> Callable[[Sequence[str]], DataFrame]:
    """Rows of a group of files: the schema's columns, the record if it does not fit, _wrong, _header
    (the line is one, not a record), _sought (headers are looked for), _path."""
    full = with_record(schema)
    path = F.col("_metadata.file_path").alias("_path")
    strict = {"ignoreCorruptFiles": False}
    permissive = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

    def lines(group: Sequence[str]) -> DataFrame:
        text = spark.read.options(**strict).text(list(group)).select("value", path).where("value <> ''")
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
        names = F.regexp_replace("value", '^\ufeff|"', "") == ",".join(schema.names)
        kinds = {k: str(v) for k, v in (options | permissive).items()}
        parsed = text.select("value", "_path", names.alias("_header"), (quotes % 2 == 1).alias("_open"), F.from_csv("value", full.toDDL(), kinds).alias("_r"))
        wrong = F.col("_open") | F.col(f"_r.{CORRUPT}").isNotNull()
        return parsed.select("_r.*", (wrong & ~F.col("_header")).alias("_wrong"), "_header", "_path", "value").withColumns({CORRUPT: F.when(F.col("_wrong"), F.col("value")), "_sought": F.lit(True)}).drop("value")

    def records(group: Sequence[str]) -> DataFrame:
        extra = {} if fmt not in ("csv", "json") else permissive | ({"header": True, "enforceSchema": False} if fmt == "csv" else {})
        df = spark.read.format(fmt).schema(full if extra else schema).options(**strict, **extra, **options).load(list(group)).select("*", path)
        df = df if extra else df.withColumn(CORRUPT, F.lit(None).cast("string"))
        return df.withColumns({"_wrong": F.col(CORRUPT).isNotNull(), "_header": F.lit(False), "_sought": F.lit(False)})

    return lines if fmt == "csv" and str(options.get("multiLine", False)).lower() != "true" else records


def with_record(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def plain_path(path: str) -> str:
    return re.sub("^file:/*", "/", unquote(path))


def same_path(column: str) -> Column:
    """Listings and file metadata may spell one path in two ways."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def _counts(df: DataFrame, schema: T.StructType) -> DataFrame:
    """STATUS rows; every column of every record is decoded for them."""
    digest = F.bit_xor(F.xxhash64(*schema.names, CORRUPT)).alias("_digest")
    record, headed = ~F.col("_header"), F.bool_or(F.col("_header") | ~F.col("_sought"))
    counts = df.groupBy(F.col("_path").alias("path")).agg(F.count_if(record).alias("rows_read"), F.count_if("_wrong").alias("corrupt_rows"), headed.alias("has_header"), digest)
    return counts.where("_digest is not null").drop("_digest")


def attempt(files: Sequence[str], run: Callable[[Sequence[str]], DataFrame]) -> tuple[list[DataFrame], dict[str, str]]:
    """Results of `run` over groups of files that it can take, and the error of each file that it cannot take alone."""
    results, broken, groups = [], {}, [list(files)] if files else []

    def one(group: list[str]) -> DataFrame | Exception:
        try:
            return run(group)
        except (PySparkException, Py4JJavaError) as error:  # Spark's own account of a file; anything else is no fault of a file
            return error

    while groups:
        with ThreadPoolExecutor(WAYS) as pool:
            done = list(pool.map(one, groups))
        again = []
        for group, found in zip(groups, done, strict=True):
            if isinstance(found, DataFrame):
                results.append(found)
            elif len(group) == 1:
                broken[group[0]] = reason(found)[:ERROR_LENGTH]
            else:
                size = -(-len(group) // WAYS)
                again += [group[i : i + size] for i in range(0, len(group), size)]
        groups = again
    return results, broken


def reason(error: Exception) -> str:
    """The messages of an error and its causes, without the stack."""
    if not isinstance(error, Py4JJavaError):
        return str(error)
    said, cause = [], error.java_exception
    while cause is not None and len(said) < 9:
        said.append(str(cause.getMessage()).split("\n\tat ")[0])
        cause = cause.getCause()
    return "; ".join(dict.fromkeys(said))
