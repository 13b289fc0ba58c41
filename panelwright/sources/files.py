"""Scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import normalise_headers, project

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("unique_key", T.StringType()),
        T.StructField("created_date", T.StringType()),
        T.StructField("closed_date", T.StringType()),
        T.StructField("complaint_type", T.StringType()),
        T.StructField("descriptor", T.StringType()),
        T.StructField("borough", T.StringType()),
        T.StructField("latitude", T.StringType()),
        T.StructField("longitude", T.StringType()),
    ]
)


def scan_parts(
    spark: SparkSession,
    paths: str | Sequence[str],
    required: Sequence[str],
    optional: Sequence[str] = (),
    fmt: str = "csv",
    schema: T.StructType | None = None,
    exclude: str = "summary",
) -> DataFrame:
    """Read all part files of a glob as one table, all text unless a schema is given.

    Parts may differ in the order and number of their columns: each is read by its own header, and what a part lacks is
    null. Summary files are left out before anything is read (any case) and each row knows its file. Compressed CSV
    parts are one task each, so land them once as Parquet with `land` before heavy use.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    found = [r["path"] for p in listed for r in list_files(spark, p).select("path").collect()]
    kept = sorted(p for p in found if exclude.lower() not in p.rsplit("/", 1)[-1].lower())
    if not kept:
        raise FileNotFoundError(f"no part files in {paths}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    groups = by_header(spark, kept) if fmt == "csv" and schema is None else [kept]
    parts = [normalise_headers(reader.load(g).withColumn("source_file", F.col("_metadata.file_name"))) for g in groups]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return project(df, [*required, "source_file"], optional, str(paths))


def by_header(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """Text files with the same first line together: columns are bound by name within a group. One short read per file."""
    with ThreadPoolExecutor(16) as pool:
        heads = list(pool.map(lambda p: (spark.read.text(p).head(1) or [("",)])[0][0], paths))
    groups: dict[str, list[str]] = {}
    for path, head in zip(paths, heads, strict=True):
        if head:
            groups.setdefault(head, []).append(path)
    return list(groups.values())


def land(df: DataFrame, path: str, partition: Sequence[str] = (), overwrite: bool = False) -> str:
    """Parquet copy with an overwrite guard (A08); partitioned by month or split where asked.

    Rows are spread by the partition values plus their hash range before writing, and files roll over by
    row count, so neither many tiny files nor one huge file arises.
    """
    return write_table(df, path, "parquet", partition, overwrite, {"maxRecordsPerFile": 5_000_000})


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition: Sequence[str] = (),
    overwrite: bool = False,
    options: dict | None = None,
) -> str:
    """CSV, JSON or Parquet sink that refuses to replace data unless told to."""
    if partition:
        df = df.hint("rebalance", *partition)
    writer = df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists").options(**(options or {}))
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.save(path)
    return path


def month_key(ts: Column) -> Column:
    return F.date_format(F.to_date(ts), "yyyy-MM")


def read_polygons(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """GeoJSON features as property columns plus polygons -> rings -> points."""
    schema = "features array<struct<properties map<string,string>, geometry struct<type string, coordinates string>>>"
    feature = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    lower = F.map_from_entries(
        F.transform(F.map_entries("f.properties"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    )
    raw = feature.select(lower.alias("p"), F.col("f.geometry.type").alias("t"), F.col("f.geometry.coordinates").alias("c"))
    point = lambda x: F.struct(x[0].alias("lon"), x[1].alias("lat"))
    rings = lambda poly: F.transform(poly, lambda ring: F.transform(ring, point))
    single = F.from_json("c", "array<array<array<double>>>")
    multi = F.from_json("c", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("t") == "Polygon", F.array(rings(single))).when(F.col("t") == "MultiPolygon", F.transform(multi, rings))
    return raw.select(*[F.col("p")[n].alias(n) for n in properties], polygons.alias("polygons"))


ELEMENT = "struct<type string, id bigint, lat double, lon double, center struct<lat double, lon double>, tags map<string,string>>"
TAG_COLUMNS = ["name", "amenity", "leisure", "shop", "tourism", "railway", "public_transport", "highway", "operator", "brand", "opening_hours"]
ADDRESS_TAGS = {
    "addr:housenumber": "addr_housenumber",
    "addr:street": "addr_street",
    "addr:city": "addr_city",
    "addr:postcode": "addr_postcode",
}


def read_poi(spark: SparkSession, path: str, matched_key: str, source: str) -> DataFrame:
    """Nested element JSON as flat rows; ways and relations take their centre."""
    raw = spark.read.schema(f"elements array<{ELEMENT}>").option("multiLine", True).json(path)
    return flatten_poi(raw.select(F.explode("elements").alias("e")), matched_key, source)


def flatten_poi(elements: DataFrame, matched_key: str, source: str) -> DataFrame:
    """Rows of one struct column `e` to POI columns; rows without any position are dropped."""
    tags = F.col("e.tags")
    both = F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()
    at = lambda c: F.when(both, F.col(f"e.{c}")).otherwise(F.col(f"e.center.{c}"))
    return elements.select(
        F.col("e.type").alias("osm_type"),
        F.col("e.id").alias("osm_id"),
        at("lat").alias("lat"),
        at("lon").alias("lon"),
        F.lit(source).alias("source_bbox"),
        F.lit(matched_key).alias("matched_tag_key"),
        tags[matched_key].alias("matched_tag_value"),
        *[tags[c].alias(c) for c in TAG_COLUMNS],
        *[tags[k].alias(v) for k, v in ADDRESS_TAGS.items()],
        F.to_json(tags).alias("all_tags"),
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with size and time; the content column is pruned, so nothing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "modificationTime", "length")


def unseen_files(available: DataFrame, processed: DataFrame) -> DataFrame:
    """Files that no earlier run has recorded (A09); `file:/x` and `file:///x` are the same path."""
    same = lambda c: F.regexp_replace(c, "^file:/*", "/")
    known = processed.select(same(F.col("path")).alias("_known")).distinct()
    return available.join(known, same(F.col("path")) == F.col("_known"), "left_anti")


def file_report(df: DataFrame, file: str, bad_date: Column, missing_key: Column, matched: Column) -> DataFrame:
    """Rows read, used, with bad date, missing key and area match per file (A10)."""
    used = ~bad_date & ~missing_key
    return df.groupBy(file).agg(
        F.count("*").alias("rows_read"),
        F.count_if(used).alias("rows_used"),
        F.count_if(bad_date).alias("bad_date_rows"),
        F.count_if(missing_key).alias("missing_key_rows"),
        F.count_if(matched).alias("matched_rows"),
    )
