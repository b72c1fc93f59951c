"""Payloads of weather services as long tables. Each takes text columns, so files of any number are parsed in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.functions import time as ft

# The fields of the stations' services and what they are here, with the factor to our unit.
#: (variable, statistic) of a station export.
STATION_MAP = (
    ("air_temperature", "point", "temperature_2m", 1.0), ("relative_humidity", "point", "relative_humidity_2m", 1.0), ("snow_depth", "median", "snow_depth", 0.01),
)
#: Fields of a station's JSON readings.
STATION_FIELDS = {
    "airTempAvg": ("temperature_2m", 1.0), "hourlyPrecip": ("precipitation", 1.0), "snowHeight": ("snow_depth", 0.01), "newSnow": ("snowfall", 1.0),
    "windSpeedAvg": ("wind_speed_10m", 1.0), "windDirAvg": ("wind_direction_10m", 1.0),
}
#: Columns of a station's CSV, the first with a value counts.
CSV_COLUMNS = {
    "temperature_2m": (("air_temp", "CURRENT_AIR_TEMPERATURE1", "CURRENT_AIR_TEMPERATURE2"), 1.0),
    "relative_humidity_2m": (("rel_hum", "RELATIVE_HUMIDITY1"), 1.0),
    "snow_depth": (("snw_dpth", "HEIGHT_OF_SNOW"), 0.01),
    "snowfall": (("snwfl_amt_pst1hr", "STANDARD_SNOW"), 1.0),
    "precipitation": (("pcpn_amt_pst1hr", "PRECIPITATION_NEW"), 1.0),
    "wind_speed_10m": (("avg_wnd_spd_10m_pst10mts", "MEASURED_WIND_SPEED1", "ACTUAL_WIND_SPEED"), 1.0),
    "wind_gusts_10m": (("max_wnd_spd_10m_pst1hr", "MAXIMUM_MEASURED_WIND_SPEED1"), 1.0),
    "wind_direction_10m": (("avg_wnd_dir_10m_pst10mts", "MEASURED_WIND_DIRECTION1", "ACTUAL_WIND_DIRECTION"), 1.0),
}
#: Sums whose small negative readings are noise of the sensor.
NOT_NEGATIVE = ("precipitation", "snowfall")
MISSING = -9999.9


def parse_series_json(df: DataFrame, body: str, block: str = "hourly") -> DataFrame:
    """df plus (key, valid_time, value): every series of a block {"time": [...], "<key>": [...]}, without nulls."""
    arrays = F.from_json(F.get_json_object(body, f"$.{block}"), "map<string,array<string>>")
    rest = [c for c in df.columns if c != body]
    df = df.select(*rest, arrays.alias("__m")).select(*rest, F.try_element_at("__m", F.lit("time")).alias("__t"), F.explode("__m").alias("key", "__v")).where("key <> 'time'")
    df = df.select(*rest, "key", F.explode(F.arrays_zip("__t", "__v")).alias("__z"))
    return df.select(*rest, "key", ft.to_utc_time(F.col("__z.__t")).alias("valid_time"), F.col("__z.__v").try_cast("double").alias("value")).where("value is not null and valid_time is not null")


def split_keys(df: DataFrame, models: Sequence[str], key: str = "key") -> DataFrame:
    """df plus variable and model, where the key is <variable>_<model> for the longest model that fits; other rows go."""
    fit = F.filter(F.array(*[F.lit(m) for m in models]), lambda m: F.endswith(F.col(key), F.concat(F.lit("_"), m)))
    best = F.element_at(F.array_sort(fit, lambda a, b: F.length(a) - F.length(b)), -1)
    df = df.where(F.size(fit) > 0).withColumn("model", best)
    return df.withColumn("variable", F.expr(f"left({key}, length({key}) - length(model) - 1)"))


def parse_forecast_json(df: DataFrame, body: str, models: Sequence[str], variables: Sequence[str], source: str = "live") -> DataFrame:
    """Forecast rows of payloads with many models; df has location, issued_at and fetched_at."""
    long = split_keys(parse_series_json(df, body), models).where(F.col("variable").isin(*variables))
    return long.drop("key").withColumn("source", F.lit(source))


def parse_ensemble_json(df: DataFrame, body: str, model: str, variables: Sequence[str]) -> DataFrame:
    """Ensemble rows: <variable> is the control, member 00, and <variable>_memberNN the others."""
    long = parse_series_json(df, body)
    number = F.regexp_extract("key", r"_member(\d+)$", 1)
    long = long.withColumns({"variable": F.regexp_replace("key", r"_member\d+$", ""), "model": F.concat(F.lit(f"{model}_member"), F.when(number == "", "00").otherwise(F.lpad(number, 2, "0")))})
    return long.where(F.col("variable").isin(*variables)).drop("key")


def parse_previous_runs_json(df: DataFrame, body: str, variables: Sequence[str]) -> DataFrame:
    """Rows of <variable>_previous_dayN, issued N days before their valid time."""
    long = parse_series_json(df, body)
    days = F.nullif(F.regexp_extract("key", r"_previous_day(\d+)$", 1), F.lit("")).cast("int")
    long = long.withColumns({"days": days, "variable": F.regexp_replace("key", r"_previous_day\d+$", "")}).where(F.col("days").isNotNull() & F.col("variable").isin(*variables))
    return long.withColumns({"issued_at": F.col("valid_time") - F.make_dt_interval(days=F.col("days")), "source": F.lit("previous_runs")}).drop("key", "days")


def previous_run_fields(spark: SparkSession, variables: Sequence[str], offsets: Sequence[int]) -> DataFrame:
    """(field): every variable with every offset."""
    v, o = (F.explode(F.array(*[F.lit(x) for x in xs])) for xs in (variables, offsets))
    return spark.range(1).select(v.alias("v")).select("v", o.alias("o")).select(F.concat("v", F.lit("_previous_day"), F.col("o").cast("string")).alias("field"))


def parse_daily_json(df: DataFrame, body: str) -> DataFrame:
    """(date, variable, value) of an archive payload's daily block, without nulls."""
    return parse_series_json(df, body, "daily").select(*[c for c in df.columns if c != body], F.to_date("valid_time").alias("date"), F.col("key").alias("variable"), "value")


def parse_index_text(lines: DataFrame, line: str = "value") -> DataFrame:
    """(season, year, anom) of a table in columns divided by white space, without its header."""
    f = F.split(F.trim(line), r"\s+")
    return lines.select(F.get(f, F.lit(0)).alias("season"), F.get(f, F.lit(1)).try_cast("int").alias("year"), F.get(f, F.lit(2)).try_cast("double").alias("anom")).where("year is not null and anom is not null")


def parse_monthly_geojson(df: DataFrame, body: str) -> DataFrame:
    """(date, temp_mean) of a feature collection's properties, without missing values."""
    schema = "struct<features:array<struct<properties:struct<date:string,temp_mean__temp_moyenne:double>>>>"
    out = df.select(F.explode(F.from_json(body, schema)["features"]).alias("f")).select(F.col("f.properties.date").alias("date"), F.col("f.properties.temp_mean__temp_moyenne").alias("temp_mean"))
    return out.where(F.col("temp_mean").isNotNull() & (F.col("temp_mean") > MISSING))


def _reading(name: Column, value: Column) -> Column:
    """A reading in our unit, to 3 places; sums are not negative."""
    return F.round(F.when(name.isin(*NOT_NEGATIVE) & (value < 0), 0.0).otherwise(value), 3)


def unpivot_readings(df: DataFrame, ids: Sequence[str], columns: dict[str, tuple[Sequence[str], float]]) -> DataFrame:
    """(ids, variable, value): for each variable the first of its columns that has a value, times a factor, rounded to 3 places.

    Negative precipitation and snowfall become 0.
    """
    out = []
    for variable, (candidates, factor) in columns.items():
        present = [F.col(c).try_cast("double") for c in candidates if c in df.columns]
        if present:
            out.append(F.struct(F.lit(variable).alias("variable"), _reading(F.lit(variable), F.coalesce(*present) * F.lit(factor)).alias("value")))
    if not out:
        return df.select(*ids, F.lit(None).cast("string").alias("variable"), F.lit(None).cast("double").alias("value")).limit(0)
    return df.select(*ids, F.explode(F.array(*out)).alias("r")).select(*ids, "r.variable", "r.value").where("value is not null")


def read_station_csv(spark: SparkSession, path: str, columns: dict[str, tuple[Sequence[str], float]] = CSV_COLUMNS, tz: str = ft.LOCAL_TZ) -> DataFrame:
    """(time, variable, value) of CSV files with a banner, local times and the word None for nulls.

    Files are read by lines, so a long file is many tasks. Each file's own header, the first line with a column
    `time`, says where its columns are; what is above it has no time and falls away. Cells may be quoted. Local
    times that don't exist or exist twice are left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    is_header = F.col("value").rlike(r'(?:^|,)\s*"?time"?\s*(?:,|$)')
    headers = lines.where(is_header).groupBy("file").agg(F.min_by("value", "at").alias("header"))  # one row a file
    width = headers.agg(F.max(F.size(F.split("header", ",")))).first()[0]
    if width is None:
        raise ValueError(f"{path}: no column time")
    cells = lambda line: F.from_csv(line, ", ".join(f"c{i} string" for i in range(width)), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": "None"})
    listed = lambda row: F.array(*[row[f"c{i}"] for i in range(width)])
    headers = headers.select("file", listed(cells(F.col("header"))).alias("names"))
    rows = lines.where(~is_header).select("file", listed(cells(F.col("value"))).alias("cells")).join(headers, "file")
    wanted = sorted({c for names, _ in columns.values() for c in names} | {"time"})
    place = lambda name: F.nullif(F.array_position("names", name).cast("int"), F.lit(0)) - 1
    df = rows.select(*[F.nullif(F.get("cells", place(c)), F.lit("None")).alias(c) for c in wanted])
    df = df.withColumn("time", ft.local_to_utc(ft.to_utc_time(F.col("time")), tz)).where("time is not null")
    return unpivot_readings(df, ["time"], columns)


def parse_station_json(df: DataFrame, body: str, fields: dict[str, tuple[str, float]] = STATION_FIELDS, time: str = "measurementDateTime") -> DataFrame:
    """The other columns of df plus (time, variable, value): readings in JSON arrays of objects, one field a variable; rows without a time go."""
    rest = [c for c in df.columns if c != body]
    schema = "array<struct<" + ", ".join(f"`{f}`: string" for f in (time, *fields)) + ">>"
    rows = df.select(*rest, F.explode(F.from_json(body, schema)).alias("r")).select(*rest, "r.*").where(F.coalesce(time, F.lit("")) != "")
    rows = rows.withColumn("__time", ft.to_utc_time(F.col(time)))
    out = unpivot_readings(rows, [*rest, "__time"], {variable: ((field,), factor) for field, (variable, factor) in fields.items()})
    return out.withColumnRenamed("__time", "time")


def parse_station_export(df: DataFrame, mapping: Sequence[tuple[str, str, str, float]] = STATION_MAP) -> DataFrame:
    """(time, site_id, variable, value) of a station's export, without suspect readings, in our units to 3 places."""
    spark = df.sparkSession
    dim = spark.createDataFrame([*mapping], "variable string, statistic string, name string, factor double")
    df = df.where(F.coalesce("quality", F.lit("")) != "suspect").join(F.broadcast(dim), ["variable", "statistic"])  # a few rows
    value = F.round(F.col("value").try_cast("double") * F.col("factor"), 3)
    return df.select(ft.to_utc_time(F.col("time_utc")).alias("time"), "site_id", F.col("name").alias("variable"), value.alias("value")).where("value is not null and not isnan(value)")


def request_urls(spark: SparkSession, base: str, points: DataFrame, chunks: DataFrame, models: Sequence[str], known: Sequence[str]) -> DataFrame:
    """(location, model, first, last, url) of archive requests; unknown models are refused."""
    unknown = sorted(set(models) - set(known))
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    model = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    df = points.select("location", "latitude", "longitude", model).crossJoin(F.broadcast(chunks))  # a few spans
    url = F.format_string(f"{base}?latitude=%s&longitude=%s&models=%s&start_date=%s&end_date=%s", *[F.col(c).cast("string") for c in ("latitude", "longitude", "model", "first", "last")])
    return df.select("location", "model", "first", "last", url.alias("url"))


def to_json_rows(df: DataFrame, columns: Sequence[str | Column] | None = None) -> DataFrame:
    """(json): each row as JSON with its nulls; NaN becomes null."""
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    fixed = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in doubles else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"}).alias("json"))
