"""Append-only Parquet logs with explicit schemas; the last write of a key wins."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.functions import time as ft
from nimbora.operators.verification import add_run_init, keep_last

FORECASTS = "location string, model string, issued_at string, valid_time string, variable string, value double, source string, fetched_at string, run_init string"
OBSERVATIONS = "location string, time string, variable string, value double, source string, fetched_at string"
REANALYSIS = "location string, date string, variable string, value double, model string, fetched_at string"


def write_log(df: DataFrame, root: str, schema: str, partition: str, at: str = "fetched_at") -> None:
    """Appends rows in the schema's columns, missing ones as typed nulls, below partition=<date of `at`>."""
    fields = T.StructType.fromDDL(schema).fields
    have = set(df.columns)
    out = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    out.withColumn(partition, F.substring(at, 1, 10)).write.mode("append").partitionBy(partition).option("compression", "zstd").parquet(root)


def write_reanalysis(df: DataFrame, root: str) -> None:
    """Appends daily values in the schema's columns below model=<model>/location=<location>, so that readers of one series scan one folder."""
    fields = T.StructType.fromDDL(REANALYSIS).fields
    have = set(df.columns)
    out = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    out.write.mode("append").partitionBy("model", "location").option("compression", "zstd").parquet(root)


def column_types(spark: SparkSession, root: str, column: str) -> DataFrame:
    """(path, type): the type that each Parquet file below root gives a column; null where the file has no such column.

    Spark lists the files, and tasks read nothing of them but their footers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")

    def footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = []
            for path in frame.path:
                system, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                schema = pq.read_schema(inner, filesystem=system)
                kinds.append(str(schema.field(column).type) if column in schema.names else None)
            yield pd.DataFrame({"path": frame.path, "type": pd.Series(kinds, dtype=object)})

    return files.mapInPandas(footers, "path string, type string")


def _scan(spark: SparkSession, root: str, schema: str, partition: str | None = None, optional: str | None = None) -> DataFrame:
    """The rows of a log with the path and place of each. Files that hold the optional column in another type than text are read without it.

    There are two scans at most, however many files: the paths of files without the type, which the footers tell, prune the one scan to these and the
    other to all else before a file is opened. Spark's own index of the log holds these paths anyhow. Filters on the result reach both scans.
    """
    fields = f"{schema}, {partition} string" if partition else schema
    place = {"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}
    whole = spark.read.schema(fields).option("basePath", root).parquet(root)
    if optional is None:
        return whole.withColumns(place)
    odd = column_types(spark, root, optional).where(~F.coalesce("type", F.lit("string")).isin("string", "large_string")).select("path")
    odd = [r.path for r in odd.toLocalIterator()]
    if not odd:
        return whole.withColumns(place)
    untyped = F.col("_metadata.file_path").isin(*odd)
    rest = T.StructType([f for f in T.StructType.fromDDL(fields).fields if f.name != optional])
    without = spark.read.schema(rest).option("basePath", root).parquet(root).where(untyped).withColumns(place)
    return whole.where(~untyped).withColumns(place).unionByName(without, allowMissingColumns=True)


def read_forecasts(spark: SparkSession, root: str, variable: str, locations: Sequence[str] | None = None, sources: Sequence[str] | None = None, issued_from: str | None = None, cycles: dict[str, int] | None = None) -> DataFrame:
    """Forecasts of a variable with the start of their run (init_time, init_basis; see add_run_init); of rows with one (location, model, issued_at, valid_time) the last in path and row order.

    Files may lack run_init or hold it untyped. The filters reach the Parquet scan. issued_from prunes partitions by the date of the fetch, so use it for
    live rows only: backfilled rows lie under the date of their backfill. cycles: hours between the runs of models that don't run every six.
    """
    df = _scan(spark, root, FORECASTS, "issued_date", "run_init").where(F.col("variable") == variable)
    if locations is not None:
        df = df.where(F.col("location").isin(*locations))
    if sources is not None:
        df = df.where(F.col("source").isin(*sources))
    if issued_from is not None:
        df = df.where(F.col("issued_date") >= issued_from)
    times = {c: ft.to_utc_time(F.col(c)) for c in ("issued_at", "valid_time", "run_init")}
    df = df.drop("issued_date", "fetched_at", "variable").withColumns(times)
    df = keep_last(df, ["location", "model", "issued_at", "valid_time"], ["__path", "__row"]).drop("__path", "__row")
    return add_run_init(df.withColumn("__logged", F.col("run_init")), cycles).withColumnRenamed("__logged", "run_init")


def read_untyped(spark: SparkSession, root: str, schema: str, optional: str = "run_init") -> DataFrame:
    """A log of which some files hold an optional text column without a type: those are read without the column, in one scan beside that of all others."""
    return _scan(spark, root, schema, None, optional).drop("__path", "__row")


def read_observations(spark: SparkSession, root: str, variable: str, locations: Sequence[str] | None = None) -> DataFrame:
    """(location, time, value); of rows with one time the last in path and row order."""
    df = _scan(spark, root, OBSERVATIONS, "obs_date").where(F.col("variable") == variable)
    if locations is not None:
        df = df.where(F.col("location").isin(*locations))
    df = df.select("location", ft.to_utc_time(F.col("time")).alias("time"), "value", "__path", "__row")
    return keep_last(df, ["location", "time"], ["__path", "__row"]).drop("__path", "__row")


def read_reanalysis(spark: SparkSession, root: str, variables: Sequence[str], model: str = "era5_land") -> DataFrame:
    """(location, date, one column for each variable); of one date and variable the latest fetch."""
    df = spark.read.schema(REANALYSIS).parquet(root).where((F.col("model") == model) & F.col("variable").isin(*variables))
    best = df.groupBy("location", F.to_date("date").alias("date"), "variable").agg(F.max_by("value", "fetched_at").alias("value"))
    return best.groupBy("location", "date").pivot("variable", list(variables)).agg(F.first("value"))


def latest_run(df: DataFrame, by: Sequence[str] = ("location",)) -> DataFrame:
    """The rows of each group's newest issue time."""
    newest = df.groupBy(*by).agg(F.max("issued_at").alias("issued_at"))
    return df.join(newest, [*by, "issued_at"], "left_semi")


def settled_inits(before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, init) of domains whose run start was the same before and after a fetch; null else."""
    b, a = before.select("domain", F.col("init").alias("__b")), after.select("domain", F.col("init").alias("__a"))
    return b.join(a, "domain", "left").select("domain", F.when(F.col("__a") == F.col("__b"), F.col("__b")).alias("init"))


def content_digest(df: DataFrame) -> str:
    """A digest of the rows of df in whatever order, from one aggregation: how many there are, and sums of two independent hashes of each."""
    row = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    one, two = F.xxhash64(row), F.xxhash64(F.lit(1), row)
    halves = [F.sum(h) for x in (one, two) for h in (x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))]
    return hashlib.sha256(repr((df.columns, tuple(df.agg(F.count("*"), *halves).first()))).encode()).hexdigest()


def _files(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def versions(spark: SparkSession, root: str) -> list[tuple[int, dict]]:
    """(number, manifest) of the committed versions of a table below root, in order."""
    fs, conf = _files(spark)
    folder = fs.Path(f"{root}/_versions")
    system = folder.getFileSystem(conf)
    if not system.exists(folder):
        return []
    names = sorted(x.getPath().getName() for x in system.listStatus(folder))
    found = [n for n in names if re.fullmatch(r"\d{12}", n)]
    lines = {r[0].rpartition("/")[2]: r[1] for r in spark.read.text([f"{root}/_versions/{n}" for n in found]).select(F.col("_metadata.file_path"), "value").collect()} if found else {}
    return [(int(n), json.loads(lines[n])) for n in found]


def save_if_changed(df: DataFrame, root: str, stamp: str, order_by: Sequence[str]) -> bool:
    """Writes df as a new version of the table below root unless the newest version has the same rows; says whether it did.

    One aggregation decides: the digest of the rows against that in the newest manifest. The data are written aside and the version is committed by renaming its
    manifest to the next number, which fails where another writer has taken it. That writer's rows are then compared in the same way, so
    writers of equal rows leave one version.
    """
    spark, digest, data = df.sparkSession, content_digest(df), None
    fs, conf = _files(spark)
    while True:
        known = versions(spark, root)
        if known and known[-1][1]["digest"] == digest:
            if data is not None:
                path = fs.Path(f"{root}/{data}")
                path.getFileSystem(conf).delete(path, True)
            return False
        if data is None:
            data = f"data-{uuid.uuid4().hex}"
            df.sortWithinPartitions(*order_by).write.parquet(f"{root}/{data}")
        number = known[-1][0] + 1 if known else 1
        if commit_version(spark, root, number, {"stamp": stamp, "digest": digest, "data": data}):
            return True


def commit_version(spark: SparkSession, root: str, number: int, manifest: dict) -> bool:
    """Whether the manifest has become that of the version; not where there is one already."""
    fs, conf = _files(spark)
    mine, final = fs.Path(f"{root}/_versions/.{uuid.uuid4().hex}"), fs.Path(f"{root}/_versions/{number:012d}")
    system = mine.getFileSystem(conf)
    out = system.create(mine, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    options = spark.sparkContext._jvm.java.lang.reflect.Array.newInstance(spark.sparkContext._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(mine.toUri(), conf).rename(system.makeQualified(mine), system.makeQualified(final), options)
        return True
    except Py4JJavaError as e:
        system.delete(mine, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise


def latest_saved(spark: SparkSession, root: str) -> str | None:
    """The path of the newest version's rows."""
    known = versions(spark, root)
    return f"{root}/{known[-1][1]['data']}" if known else None


def month_chunks(spark: SparkSession, start: str, end: str, years: int = 1, months: int = 0) -> DataFrame:
    """(first, last) dates of consecutive spans of so many years and months from the start; the last one ends at the end."""
    a, b, step = F.to_date(F.lit(start)), F.to_date(F.lit(end)), 12 * years + months
    df = spark.range(1).select(F.explode(F.sequence(a, b, F.expr(f"interval {step} month"))).alias("first"))
    return df.select("first", F.least(F.date_sub(F.add_months("first", step), 1), b).alias("last"))


def calendar_months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(first, last) dates of each calendar month between two dates, the first and last cut at these."""
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    df = spark.range(1).select(F.explode(F.sequence(F.trunc(a, "month"), b, F.expr("interval 1 month"))).alias("month"))
    return df.select(F.greatest("month", a).alias("first"), F.least(F.last_day("month"), b).alias("last"))
