"""Fetched payloads as a data source, batch and stream, and the log that two passes over the requests give."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from nimbora.operators.series import missing_models
from nimbora.sources.logs import settled_inits
from nimbora.sources.parsers import parse_forecast_json

SCHEMA = "request string, pass int, status int, body string"


class Payload(InputPartition):
    """One answer to one request: the file pass=<n>/request=<id>/... below the folder."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _parts(path: str) -> dict[str, str]:
    return dict(p.split("=", 1) for p in path.split("/") if "=" in p)


def _listed(uri: str) -> list[str]:
    """The folder's payload files, in order; files whose names begin with "_" or "." are none."""
    system, root = _system(uri)
    found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and {"pass", "request"} <= set(_parts(f.path)))


def _read(uri: str, path: str) -> Iterator[tuple]:
    """The payload's row. What is no JSON object with a status has none, and counts as failed."""
    system, _ = _system(uri)
    with system.open_input_stream(path) as stream:
        text = stream.read().decode("utf-8", "replace")
    try:
        answer = json.loads(text)
        status, body = int(answer["status"]), answer.get("body")
    except (ValueError, KeyError, TypeError, AttributeError):
        status, body = None, None
    parts = _parts(path)
    yield parts["request"], int(parts["pass"]), status, body if body is None or isinstance(body, str) else json.dumps(body)


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.number = options["path"], options.get("pass")
        self.only = set(json.loads(options["only"])) if "only" in options else None

    def partitions(self) -> Sequence[InputPartition]:
        kept = [p for p in _listed(self.uri) if self.number is None or _parts(p)["pass"] == self.number]
        return [Payload(p) for p in kept if self.only is None or _parts(p)["request"] in self.only]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.uri, partition.path) if partition is not None and partition.value else iter(())


class PayloadStream(DataSourceStreamReader):
    """Payloads in the order of their names, which must ascend with their arrival. An offset is the last name that was given out."""

    def __init__(self, options: dict):
        self.uri, self.clean = options["path"], options.get("clean") == "true"

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": (_listed(self.uri) or [""])[-1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Payload(p) for p in _listed(self.uri) if start["last"] < p <= end["last"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.uri, partition.path)

    def commit(self, end: dict) -> None:
        """With option clean, payloads that are done with are removed."""
        if self.clean:
            system, _ = _system(self.uri)
            for p in _listed(self.uri):
                if p <= end["last"]:
                    system.delete_file(p)


class PayloadFolder(DataSource):
    """A folder of answers, one partition a request. Options: path; pass reads that pass only; only, a JSON list, reads these requests only."""

    @classmethod
    def name(cls) -> str:
        return "payload_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PayloadReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PayloadStream(dict(self.options))


def write_payloads(df: DataFrame, path: str) -> None:
    """Writes (request, pass, status, body) as the folder of one file a request that the data source reads."""
    body = F.to_json(F.struct("status", "body"))
    df.select("pass", "request", body.alias("value")).repartition("pass", "request").write.mode("append").partitionBy("pass", "request").text(path)


def read_payloads(spark: SparkSession, path: str, number: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
    spark.dataSource.register(PayloadFolder)
    options = {"path": path} | ({"pass": str(number)} if number is not None else {}) | ({"only": json.dumps(list(only))} if only is not None else {})
    return spark.read.format("payload_folder").options(**options).load()


def two_passes(spark: SparkSession, path: str, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, failed): the good answer to each of requests(request), of the first pass or else of the second, and the requests that have none with their last status.

    Of the second pass only the requests that failed in the first are read. Their ids come to the driver, which plans one partition for each request anyhow.
    """
    first = read_payloads(spark, path, 1)
    wanted = requests.select(F.col("request").cast("string").alias("request")).distinct()
    good = first.where("status = 200").join(wanted, "request", "left_semi")
    failing = [r.request for r in wanted.join(good, "request", "left_anti").collect()]
    second = read_payloads(spark, path, 2, failing)
    answers = good.unionByName(second.where("status = 200")).dropDuplicates(["request"])
    last = first.unionByName(second).groupBy("request").agg(F.max_by("status", "pass").alias("status"))
    failed = wanted.join(answers.select("request"), "request", "left_anti").join(last, "request", "left")
    return answers, failed


def logged_forecasts(answers: DataFrame, models: Sequence[str], variables: Sequence[str], before: DataFrame, after: DataFrame) -> DataFrame:
    """The log's rows of good answers, each with the start of its model's run where that was the same before and after the fetch; before and after have (domain, init)."""
    inits = settled_inits(before, after).select(F.col("domain").alias("model"), F.col("init").alias("run_init"))
    rows = parse_forecast_json(answers.select(F.col("request").alias("location"), "body"), "body", models, variables)
    return rows.join(inits, "model", "left")


def lost_models(log: DataFrame, answers: DataFrame, models: Sequence[str]) -> DataFrame:
    """(location, missing): the models that gave nothing at a location that was fetched."""
    model = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    return missing_models(answers.select(F.col("request").alias("location"), model), log)
