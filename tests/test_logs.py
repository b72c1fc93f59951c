"""Logs whose files disagree, versions of a table, and fetched payloads in batches and streams."""

import json
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from nimbora.sources import logs, payloads
from nimbora.streaming import ingest


def write(folder, name, run_init=None, kind=None, **columns):
    """One file of a log, with run_init of a type, or without the column."""
    row = {"location": "a", "model": "m", "issued_at": "2024-01-01T05:00:00Z", "valid_time": "2024-01-02T00:00:00Z", "variable": "t", "value": 1.0, "source": "live", "fetched_at": "2024-01-01T05:00:00Z"} | columns
    data = {k: [v] for k, v in row.items()} | ({"run_init": pa.array([run_init], kind)} if kind is not None else {})
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(data), folder / name)


def test_files_that_disagree_about_a_column(spark, tmp_path):
    """Typed, missing and untyped run starts, the untyped file last; later files win."""
    day = tmp_path / "issued_date=2024-01-01"
    write(day, "a.parquet", "2024-01-01T00:00:00Z", pa.string(), model="typed")
    write(day, "b.parquet", model="missing")
    write(day, "c.parquet", None, pa.null(), model="typed", value=2.0)
    write(day, "d.parquet", None, pa.null(), model="backfill", source="previous_runs")
    write(tmp_path / "issued_date=2024-01-02", "z.parquet", None, pa.int32(), model="other", variable="u")
    got = {r.model: r for r in logs.read_forecasts(spark, str(tmp_path), "t", cycles={"backfill": 12}).collect()}
    assert {m: (r.value, r.init_basis) for m, r in got.items()} == {"typed": (2.0, "estimated"), "missing": (1.0, "estimated"), "backfill": (1.0, "cycle")}
    assert got["backfill"].init_time.hour == 0 and got["missing"].run_init is None
    plan = logs.read_forecasts(spark, str(tmp_path), "t", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4  # the two scans, which the run starts' median reads once more
    assert plan.count("PushedFilters: [") == plan.count("EqualTo(variable,t)") == 4


def test_many_files_are_two_scans(spark, tmp_path):
    for i in range(300):
        write(tmp_path / f"issued_date=2024-01-{1 + i % 28:02d}", f"{i:04d}.parquet", *((None, pa.null()) if i % 3 else ("2024-01-01T00:00:00Z", pa.string())), model=f"m{i}")
    df = logs._scan(spark, str(tmp_path), logs.FORECASTS, "issued_date", "run_init")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    assert (df.count(), df.where("run_init is not null").count()) == (300, 100)


def test_types_of_a_column(spark, tmp_path):
    write(tmp_path, "a.parquet", "x", pa.string())
    write(tmp_path, "b.parquet")
    write(tmp_path, "c.parquet", None, pa.null())
    assert {r.path.rpartition("/")[2]: r.type for r in logs.column_types(spark, str(tmp_path), "run_init").collect()} == {"a.parquet": "string", "b.parquet": None, "c.parquet": "null"}


def test_digests_tell_rows_apart_in_any_order(spark):
    s = "a int, b string, c array<double>"
    rows = [(1, "x", [1.0, None]), (2, None, []), (None, "2", None), (2, None, [])]
    digest = lambda r, s=s: logs.content_digest(spark.createDataFrame(r, s).repartition(3))
    assert digest(rows) == digest(rows[::-1])
    others = [rows[:3], [*rows, rows[0]], [(1, "x", [None, 1.0]), *rows[1:]], [(1, "x", [1.0, None]), (None, None, []), (2, "2", None), (2, None, [])], rows + [(None, None, None)]]
    assert len({digest(r) for r in [rows, *others]}) == 6
    assert digest(rows) != digest(rows, s.replace("b string", "d string"))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "table")
    df = spark.createDataFrame([(i, f"x{i}") for i in range(20)], "a int, b string").repartition(3)
    assert logs.latest_saved(spark, root) is None
    assert [logs.save_if_changed(d, root, s, ["a"]) for d, s in ((df, "1"), (df.orderBy("b"), "2"), (df.where("a > 3"), "3"), (df, "4"))] == [True, False, True, True]
    assert [(n, m["stamp"]) for n, m in logs.versions(spark, root)] == [(1, "1"), (2, "3"), (3, "4")]
    assert spark.read.parquet(logs.latest_saved(spark, root)).count() == 20


def test_two_writers_leave_one_version(spark, tmp_path):
    root = str(tmp_path / "table")
    df = spark.range(50).withColumn("b", F.col("id") * 2)
    done = []
    writers = [threading.Thread(target=lambda: done.append(logs.save_if_changed(df, root, "s", ["id"]))) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done) == [False, True]
    assert len(logs.versions(spark, root)) == 1
    assert len(list((tmp_path / "table").glob("data-*"))) == 1
    assert not logs.commit_version(spark, root, 1, {"stamp": "late"})
    assert logs.versions(spark, root)[0][1]["stamp"] == "s"


def test_months(spark):
    got = [tuple(map(str, r)) for r in logs.calendar_months(spark, "2024-01-15", "2024-03-10").collect()]
    assert got == [("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-10")]
    got = [tuple(map(str, r)) for r in logs.month_chunks(spark, "2024-01-15", "2024-03-10", 0, 1).collect()]
    assert got == [("2024-01-15", "2024-02-14"), ("2024-02-15", "2024-03-10")]


def answer(values):
    return json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], **{f"t_{m}": v for m, v in values.items()}}})


@pytest.fixture
def folder(spark, tmp_path):
    good, half = answer({"gfs": [1.0, 2.0], "gem": [3.0, None]}), answer({"gfs": [5.0, 6.0]})
    rows = [("a", 1, 200, good), ("a", 2, 200, half), ("b", 1, 503, None), ("b", 2, 200, half), ("c", 1, 429, None), ("c", 2, 500, None), ("x", 1, 200, good)]
    path = str(tmp_path / "in")
    payloads.write_payloads(spark.createDataFrame(rows, payloads.SCHEMA), path)
    bad = tmp_path / "in" / "pass=1" / "request=e"
    bad.mkdir(parents=True)
    (bad / "part-0.txt").write_text("{not json")
    return path


def test_a_second_pass_over_what_failed(spark, folder):
    requests = spark.createDataFrame([(r,) for r in "abcde"], "request string")
    assert payloads.read_payloads(spark, folder).rdd.getNumPartitions() == 8
    assert {(r.request, r["pass"]) for r in payloads.read_payloads(spark, folder, 2, ["b", "c"]).collect()} == {("b", 2), ("c", 2)}
    answers, failed = payloads.two_passes(spark, folder, requests)
    assert {(r.request, r["pass"]) for r in answers.collect()} == {("a", 1), ("b", 2)}
    assert {r.request: r.status for r in failed.collect()} == {"c": 500, "d": None, "e": None}
    inits = lambda *m: spark.createDataFrame(list(m), "domain string, init string")
    log = payloads.logged_forecasts(answers, ["gfs", "gem"], ["t"], inits(("gfs", "1"), ("gem", "1")), inits(("gfs", "1"), ("gem", "2")))
    assert sorted((r.location, r.model, r.value, r.run_init) for r in log.collect()) == [("a", "gem", 3.0, None), ("a", "gfs", 1.0, "1"), ("a", "gfs", 2.0, "1"), ("b", "gfs", 5.0, "1"), ("b", "gfs", 6.0, "1")]
    assert {r.location: r.missing for r in payloads.lost_models(log, answers, ["gfs", "gem"]).collect()} == {"b": ["gem"]}


def test_payloads_as_a_stream(spark, tmp_path):
    """Each payload comes once, also over a restart; those that are done with can go."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    spark.dataSource.register(payloads.PayloadFolder)

    def arrive(name):
        place = source / "pass=1" / f"request={name}"
        place.mkdir(parents=True)
        (place / "part-0.txt").write_text(json.dumps({"status": 200, "body": name}))

    def run():
        stream = spark.readStream.format("payload_folder").option("path", str(source)).option("clean", "true").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.request for r in spark.read.schema(payloads.SCHEMA).parquet(out).collect())

    arrive("001")
    arrive("002")
    assert run() == ["001", "002"]
    arrive("003")
    assert run() == ["001", "002", "003"]
    arrive("004")
    assert run() == ["001", "002", "003", "004"]


def test_keep_last_tables_are_compacted(spark, tmp_path):
    """Snapshots take over what they cover; the read has few folders, and a batch that runs again counts once."""
    target, keys, order = str(tmp_path / "last"), ["k"], ["t"]
    schema = "k int, t int, v string"
    want = {}
    for b in range(9):
        rows = [(k, b - (k == 3), f"{b}-{k}") for k in range(b, b + 4)] + [(0, b if b != 5 else -1, f"late {b}")]
        source = str(tmp_path / "in")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.keep_last_table(ingest.read_stream(spark, source, schema), target, keys, order, str(tmp_path / "state"), compact_every=3).awaitTermination(60)
        for k in {r[0] for r in rows}:
            want[k] = max((r[1], r[2]) for r in rows if r[0] == k)
        assert {r.k: (r.t, r.v) for r in ingest.read_last(spark, target, keys, order).collect()} == want
    folders = sorted(p.name for p in (tmp_path / "last").iterdir())
    assert [n for n, _ in logs.versions(spark, target)] == [1, 2, 3] and logs.versions(spark, target)[-1][1]["upto"] == 7
    assert sum(f.startswith("snapshot-") for f in folders) == 2 and sum(f.startswith("batch_") for f in folders) == 4
    snapshot, upto, batches = ingest._parts(spark, target)
    assert len(snapshot) == 1 and upto == 7 and batches == [8]
    spark.createDataFrame([(0, 99, "again", 2)], schema + ", batch long").write.mode("overwrite").parquet(f"{target}/batch_{2:012d}")
    assert {r.k: (r.t, r.v) for r in ingest.read_last(spark, target, keys, order).collect()} == want
    assert not ingest.compact_last(spark, target, keys, order)


def test_two_compactions_leave_one_snapshot(spark, tmp_path):
    target = str(tmp_path / "last")
    for n in range(4):
        spark.createDataFrame([(1, n, n)], "k int, t int, batch long").write.parquet(f"{target}/batch_{n:012d}")
    done = []
    both = [threading.Thread(target=lambda: done.append(ingest.compact_last(spark, target, ["k"], ["t"]))) for _ in range(2)]
    for x in both:
        x.start()
    for x in both:
        x.join()
    assert sum(done) == 1 and [n for n, _ in logs.versions(spark, target)] == [1]
    assert [r.t for r in ingest.read_last(spark, target, ["k"], ["t"]).collect()] == [3]
