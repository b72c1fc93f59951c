"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.functions import scalar
from nimbora.functions import time as ft
from nimbora.operators import asof, blend, ensemble, history, resampling, series, verification
from nimbora.plans import draws_sql
from nimbora.plans import testbed as tb
from nimbora.sources import parsers
from nimbora.sources.logs import latest_run

_Q: dict = {}
_SQL: dict[str, str] = {}
YEARS = (1996, 1999)
#: Queries with a column `day`.
_DATED = {
    "m1_paired_days", "a17_daily_values", "w4_running_mean", "f15_percentile_rank", "w16_apply_offsets", "f20_percent_of_median", "a33_daily_table",
    "a34_circular_mean", "f10_calendar",
}
_OFF_TIES = 1e-7  # added before rounding: means of two-decimal values often lie on a tie, where engines differ


def _query(name: str, sql: str | None = None):
    """Registers a query; dates are shown as text on both sides, so that they compare alike everywhere."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"})

        _Q[name] = run
        if sql:
            _SQL[name] = f"SELECT * REPLACE (day::VARCHAR AS day) FROM ({sql})" if name in _DATED else sql
        return f

    return add


def _r(*columns: str, digits: int = 4) -> list[Column]:
    return [F.round(F.col(c) + _OFF_TIES, digits).alias(c) for c in columns]


def _rs(*columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c} + {_OFF_TIES:.7f}, {digits}) AS {c}" for c in columns)


def _quantiles(*percents: int) -> list[Column]:
    return [F.round(F.get("q", F.lit(i)) + _OFF_TIES, 4).alias(f"q{p}") for i, p in enumerate(percents)]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.align(tb.forecasts(spark, sf_dir), tb.observations(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.metrics_by_lead(pairs(spark, sf_dir), min_n=1)


_METRICS = "count(error) AS n, avg(abs(error)) AS mae, avg(error) AS bias, sqrt(avg(error * error)) AS rmse"

# ---- verification ----


@_query("j1_align_nearest", f"WITH {tb.PAIRS} SELECT location, model, issued_at, valid_time, source, value, observed, {_rs('error', 'abs_error', 'lead_hours')}, lead_day FROM pairs")
def _(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("location", "model", "issued_at", "valid_time", "source", "value", "observed", *_r("error", "abs_error", "lead_hours"), "lead_day")


@_query("p9_keep_last", f"WITH {tb.FC} SELECT * FROM fc")
def _(spark, sf_dir):
    return tb.forecasts(spark, sf_dir)


@_query("a2_metrics_by_lead", f"WITH {tb.PAIRS}, m AS (SELECT location, model, lead_day, {_METRICS} FROM pairs GROUP BY ALL) SELECT location, model, lead_day, n, {_rs('mae', 'bias', 'rmse')} FROM m WHERE n >= 20")
def _(spark, sf_dir):
    return verification.metrics_by_lead(pairs(spark, sf_dir)).select("location", "model", "lead_day", "n", *_r("mae", "bias", "rmse"))


@_query("a3_overall_metrics", f"WITH {tb.PAIRS}, m AS (SELECT location, model, {_METRICS} FROM pairs GROUP BY ALL) SELECT location, model, n, {_rs('mae', 'bias', 'rmse')} FROM m WHERE n >= 20")
def _(spark, sf_dir):
    return verification.overall_metrics(pairs(spark, sf_dir)).select("location", "model", "n", *_r("mae", "bias", "rmse"))


_SEASON = "CASE (month(valid_time) % 12) // 3 WHEN 0 THEN 'Winter' WHEN 1 THEN 'Spring' WHEN 2 THEN 'Summer' ELSE 'Fall' END"
_BIN = "CASE WHEN observed IS NULL THEN 'nan' WHEN observed <= -10 THEN '≤ −10' WHEN observed <= 0 THEN '−10 to 0' WHEN observed <= 10 THEN '0 to 10' ELSE '> 10' END"


@_query("a4_stratified_metrics", f"""WITH {tb.PAIRS}, s AS (SELECT *, {_SEASON} AS season, {_BIN} AS obs_temp FROM pairs WHERE lead_day = 1),
u AS (SELECT location, 'season' AS dimension, season AS stratum, model, error FROM s UNION ALL SELECT location, 'obs_temp', obs_temp, model, error FROM s UNION ALL SELECT location, 'part_of_day', part_of_day, model, error FROM s),
m AS (SELECT location, dimension, stratum, model, {_METRICS} FROM u GROUP BY ALL) SELECT location, dimension, stratum, model, n, {_rs('mae', 'bias', 'rmse')} FROM m WHERE n >= 10""")
def _(spark, sf_dir):
    return verification.stratified_metrics(verification.with_strata(pairs(spark, sf_dir)), min_n=10).select("location", "dimension", "stratum", "model", "n", *_r("mae", "bias", "rmse"))


@_query("w2_day_ahead", f"""WITH {tb.FC}, live AS (SELECT * FROM fc WHERE source = 'live' AND valid_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AND epoch_us(valid_time) - epoch_us(issued_at) >= 24 * 3600000000),
w AS (SELECT *, max(issued_at) OVER (PARTITION BY location, valid_time) AS newest FROM live)
SELECT location, model, issued_at, valid_time, source, value, round_even((epoch_us(valid_time) - epoch_us(issued_at)) / 8.64e10, 0)::INT AS lead_day FROM w WHERE issued_at = newest""")
def _(spark, sf_dir):
    stamp = lambda d: F.lit(d).cast("timestamp")
    df = verification.day_ahead(tb.forecasts(spark, sf_dir), stamp("2024-01-10"), stamp("2024-01-20"))
    return df.select("location", "model", "issued_at", "valid_time", "source", "value", "lead_day")


_CYCLE = "CASE model WHEN 'click' THEN 12 ELSE 6 END * 3600"


@_query("f8_run_init", f"""WITH {tb.FC}, i AS (SELECT *, CASE WHEN source = 'live' AND hour(valid_time) % 2 = 0 THEN issued_at - INTERVAL 4 HOUR END AS run_init, {_CYCLE} AS c FROM fc),
a AS (SELECT model, median((epoch_us(issued_at) - epoch_us(run_init)) / 1e6) FILTER (run_init IS NOT NULL) AS age FROM i GROUP BY model),
g AS (SELECT i.*, round_even((epoch_us(issued_at) / 1e6 - coalesce(age, 21600)) / c, 0)::BIGINT * c AS guess, floor(epoch_us(issued_at) / 1e6 / c)::BIGINT * c AS fl FROM i JOIN a USING (model))
SELECT location, model, issued_at, valid_time, source,
  CASE WHEN run_init IS NOT NULL THEN run_init WHEN source <> 'live' THEN make_timestamp(fl * 1000000) WHEN guess <= epoch_us(issued_at) / 1e6 THEN make_timestamp(guess * 1000000) ELSE make_timestamp(fl * 1000000) END AS init_time,
  CASE WHEN run_init IS NOT NULL THEN 'logged' WHEN source <> 'live' THEN 'cycle' ELSE 'estimated' END AS init_basis FROM g""")
def _(spark, sf_dir):
    fc = tb.forecasts(spark, sf_dir)
    fc = fc.withColumn("run_init", F.when((F.col("source") == "live") & (F.hour("valid_time") % 2 == 0), F.col("issued_at") - F.make_dt_interval(hours=F.lit(4))))
    return verification.add_run_init(fc, {"click": 12}).select("location", "model", "issued_at", "valid_time", "source", "init_time", "init_basis")


_MAE = "mae AS (SELECT location, lead_day, model, avg(abs_error) AS mae, count(*) AS size FROM pairs GROUP BY ALL HAVING count(*) >= 20), best AS (SELECT location, lead_day, arg_min(model, {m: mae, n: model}) AS best FROM mae GROUP BY ALL)"


@_query("m1_paired_days", f"""WITH {tb.PAIRS}, {_MAE}, ok AS (SELECT p.*, b.best FROM pairs p JOIN mae USING (location, lead_day, model) JOIN best b USING (location, lead_day))
SELECT a.location, a.lead_day, a.best, a.model, a.valid_time::DATE AS day, round(sum(a.abs_error) + 0.0000001, 4) AS a, round(sum(b.abs_error) + 0.0000001, 4) AS b, count(*) AS n
FROM ok a JOIN ok b ON a.location = b.location AND a.lead_day = b.lead_day AND a.issued_at = b.issued_at AND a.valid_time = b.valid_time AND a.model <> a.best AND b.model = b.best GROUP BY ALL""")
def _(spark, sf_dir):
    df = verification.paired_days(pairs(spark, sf_dir), ["location", "lead_day"])
    return df.select("location", "lead_day", "best", "model", "day", *_r("a", "b"), "n")


_COMPARED = f"WITH RECURSIVE {tb.PAIRS}, {_MAE}, {draws_sql.paired_rounds()}"
_MEASURES = ("mae_a", "mae_b", "diff", "diff_se", "pct", "pct_se")


@_query("m1_paired_comparison", f"{_COMPARED} SELECT location, lead_day, best, model, n, days, {_rs(*_MEASURES)} FROM compared")
def _(spark, sf_dir):
    df = verification.compare_models(pairs(spark, sf_dir), ["location", "lead_day"])
    return df.select("location", "lead_day", "best", "model", "n", "days", *_r(*_MEASURES))


@_query("m3_winners_by_lead", f"""{_COMPARED}, placed AS (SELECT mae.*, row_number() OVER (PARTITION BY location, lead_day ORDER BY mae.mae, model) AS k FROM mae),
x AS (SELECT placed.*, diff, diff_se, coalesce(c.n >= 20 AND days >= 10 AND diff > 2 * diff_se, false) AS clear FROM placed LEFT JOIN compared c USING (location, lead_day, model)),
g AS (SELECT location, lead_day, max(model) FILTER (k = 1) AS model, max(mae) FILTER (k = 1) AS mae, max(size) FILTER (k = 1) AS n, list_sort(list(model) FILTER (k = 1 OR NOT clear)) AS tied, count(*) AS models,
  max(model) FILTER (k = 2) AS runner_up, max(diff) FILTER (k = 2) AS margin, max(diff_se) FILTER (k = 2) AS margin_se FROM x GROUP BY ALL)
SELECT location, lead_day, model, n, array_to_string(tied, ',') AS tied, runner_up, {_rs('mae', 'margin', 'margin_se')}, len(tied) = 1 AND models > 1 AS decisive FROM g""")
def _(spark, sf_dir):
    df = verification.winners_by_lead(pairs(spark, sf_dir)).withColumn("tied", F.array_join("tied", ","))
    return df.select("location", "lead_day", "model", "n", "tied", "runner_up", *_r("mae", "margin", "margin_se"), "decisive")


@_query("a38_flips", f"""WITH {tb.PAIRS}, d AS (SELECT * FROM pairs WHERE lead_day = 1), o AS (SELECT location, model, avg(abs_error) AS mae FROM d GROUP BY ALL HAVING count(*) >= 10),
ob AS (SELECT location, arg_min(model, {{m: mae, n: model}}) AS overall FROM o GROUP BY ALL), s AS (SELECT location, part_of_day, model, avg(abs_error) AS mae FROM d GROUP BY ALL HAVING count(*) >= 10),
sb AS (SELECT location, part_of_day, arg_min(model, {{m: mae, n: model}}) AS model, min(mae) AS mae FROM s GROUP BY ALL) SELECT location, part_of_day, model, round(mae + 0.0000001, 4) AS mae, overall, model <> overall AS flips FROM sb JOIN ob USING (location)""")
def _(spark, sf_dir):
    df = verification.strata_flips(blend.with_part_of_day(pairs(spark, sf_dir)), min_n=10)
    return df.select("location", "part_of_day", "model", *_r("mae"), "overall", "flips")


@_query("o5_category_order", f"""WITH {tb.PAIRS}, s AS (SELECT part_of_day, count(*) AS n, avg(abs_error) AS mae FROM pairs GROUP BY 1)
SELECT part_of_day, list_position(['Night', 'Morning', 'Afternoon', 'Evening'], part_of_day)::INT AS ord, n, round(mae + 0.0000001, 4) AS mae FROM s""")
def _(spark, sf_dir):
    dim = spark.createDataFrame([("Night", 1), ("Morning", 2), ("Afternoon", 3), ("Evening", 4)], "part_of_day string, ord int")
    g = blend.with_part_of_day(pairs(spark, sf_dir)).groupBy("part_of_day").agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"))
    return g.join(F.broadcast(dim), "part_of_day").orderBy("ord").select("part_of_day", "ord", "n", *_r("mae"))  # four rows


# ---- blends ----

_COEF = """coef AS (SELECT location, model, lead_day, part_of_day, avg(error) AS bias, avg(abs_error) AS mae, count(*) AS n FROM pairs
  WHERE valid_time < TIMESTAMP '2024-01-21' AND valid_time >= TIMESTAMP '2024-01-11' GROUP BY ALL HAVING count(*) >= 3)"""
ASOF = "2024-01-21"


def _coef(spark, sf_dir):
    return blend.learn_coefficients(pairs(spark, sf_dir), F.lit(ASOF).cast("timestamp"), window_days=10, min_train=3)


@_query("a5_learn_coefficients", f"WITH {tb.PAIRS}, {_COEF} SELECT location, model, lead_day, part_of_day, n, {_rs('bias', 'mae')}, round(1 / pow(greatest(mae, 0.5), 2) + 0.0000001, 6) AS weight FROM coef")
def _(spark, sf_dir):
    return _coef(spark, sf_dir).select("location", "model", "lead_day", "part_of_day", "n", *_r("bias", "mae"), *_r("weight", digits=6))


@_query("a8_live_blend", f"""WITH {tb.PAIRS}, {_COEF}, live AS (SELECT * FROM pairs WHERE valid_time >= TIMESTAMP '2024-01-21'),
m AS (SELECT l.location, l.valid_time, l.lead_day, l.value - c.bias AS v, 1 / pow(greatest(c.mae, 0.5), 2) AS w FROM live l JOIN coef c USING (location, model, lead_day, part_of_day))
SELECT location, valid_time, lead_day, round(sum(v * w) / sum(w) + 0.0000001, 4) AS value, count(*) AS n_members FROM m GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, sf_dir):
    p = pairs(spark, sf_dir)
    df = blend.live_blend(p.where(F.col("valid_time") >= F.lit(ASOF).cast("timestamp")), _coef(spark, sf_dir))
    return df.select("location", "valid_time", "lead_day", *_r("value"), "n_members")


def _walk_sql(weight: str = "1 / pow(greatest(mae, 0.5), 2)") -> str:
    return f"""weeks AS (SELECT DISTINCT date_trunc('week', issued_at)::TIMESTAMP AS block FROM pairs),
coef AS (SELECT block, location, model, lead_day, part_of_day, avg(error) AS bias, avg(abs_error) AS mae FROM pairs JOIN weeks ON valid_time < block AND valid_time >= block - INTERVAL 10 DAY GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT p.*, c.bias, {weight} AS w FROM pairs p JOIN coef c ON date_trunc('week', p.issued_at) = c.block AND p.location = c.location AND p.model = c.model AND p.lead_day = c.lead_day AND p.part_of_day = c.part_of_day),
blend AS (SELECT location, issued_at, valid_time, lead_day, min(observed) AS observed, count(*) AS n_members, sum(w * (value - bias)) / sum(w) AS value FROM m GROUP BY ALL HAVING count(*) >= 2),
bp AS (SELECT *, value - observed AS error, abs(value - observed) AS abs_error FROM blend)"""


WALK = {"window_days": 10, "min_train": 3, "block": "week"}


@_query("a7_walk_forward_blend", f"WITH {tb.PAIRS}, {_walk_sql()} SELECT location, issued_at, valid_time, lead_day, n_members, {_rs('value', 'observed', 'error', 'abs_error')} FROM bp")
def _(spark, sf_dir):
    df = blend.walk_forward(pairs(spark, sf_dir), **WALK)
    return df.select("location", "issued_at", "valid_time", "lead_day", "n_members", *_r("value", "observed", "error", "abs_error"))


@_query("a9_residual_quantiles", f"WITH {tb.PAIRS} SELECT location, lead_day, round(quantile_cont(error, 0.1) + 0.0000001, 4) AS low, round(quantile_cont(error, 0.9) + 0.0000001, 4) AS high, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 50")
def _(spark, sf_dir):
    return blend.residual_quantiles(pairs(spark, sf_dir)).select("location", "lead_day", *_r("low", "high"), "n")


@_query("a10_band_coverage", f"""WITH {tb.PAIRS}, cut AS (SELECT location, quantile_cont(epoch_us(issued_at)::DOUBLE, 0.7) AS cut FROM pairs GROUP BY 1), j AS (SELECT * FROM pairs JOIN cut USING (location)),
band AS (SELECT location, lead_day, quantile_cont(error, 0.1) AS low, quantile_cont(error, 0.9) AS high FROM j WHERE epoch_us(issued_at) <= cut GROUP BY ALL HAVING count(*) >= 50)
SELECT location, round(avg((error BETWEEN low AND high)::INT) + 0.0000001, 4) AS coverage, count(*) AS n FROM j JOIN band USING (location, lead_day) WHERE epoch_us(issued_at) > cut GROUP BY 1""")
def _(spark, sf_dir):
    return blend.band_coverage(pairs(spark, sf_dir)).select("location", *_r("coverage"), "n")


@_query("m10_weighting_sweep", f"""WITH {tb.PAIRS}, {_walk_sql('1.0')} SELECT location, 'equal' AS scheme, count(*) AS n, round(avg(abs_error) + 0.0000001, 4) AS mae FROM bp GROUP BY 1""")
def _(spark, sf_dir):
    return blend.weighting_sweep(pairs(spark, sf_dir), **WALK).where("scheme = 'equal'").select("location", "scheme", "n", *_r("mae"))


@_query("m10_weighting_sweep_all")
def _(spark, sf_dir):
    return blend.weighting_sweep(pairs(spark, sf_dir), **WALK).select("location", "scheme", "n", *_r("mae"))


@_query("u1_pairs_and_blend", f"WITH {tb.PAIRS}, {_walk_sql()}, u AS (SELECT location, model, abs_error FROM pairs UNION ALL SELECT location, 'blend', abs_error FROM bp) SELECT location, model, count(*) AS n, round(avg(abs_error) + 0.0000001, 4) AS mae FROM u GROUP BY ALL")
def _(spark, sf_dir):
    p = pairs(spark, sf_dir)
    both = p.unionByName(blend.walk_forward(p, **WALK), allowMissingColumns=True)
    return both.groupBy("location", "model").agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae")).select("location", "model", "n", *_r("mae"))


# ---- ensembles ----

_SCORED = f"""{tb.OBS}, {tb.ENS}, fc AS (SELECT location, valid_time FROM ens), near AS ({tb.NEAR}),
sc AS (SELECT e.*, observed, len(members) AS n, list_avg(members) AS mean, list_stddev_samp(members) AS spread, list_aggregate(members, 'quantile_cont', 0.1) AS lo, list_aggregate(members, 'quantile_cont', 0.9) AS hi,
  list_avg(list_transform(members, lambda x: abs(x - observed))) - list_sum(list_transform(range(1, len(members) + 1), lambda i: (2 * i - len(members) - 1) * list_sort(members)[i])) / (len(members) * (len(members) - 1.0)) AS crps,
  round_even((epoch_us(e.valid_time) - epoch_us(issued_at)) / 8.64e10, 0)::INT AS lead_day FROM ens e JOIN near USING (location, valid_time) WHERE len(members) >= 15)"""


def _instances(spark, sf_dir):
    return ensemble.instance_scores(tb.ensembles(spark, sf_dir), tb.observations(spark, sf_dir), min_n=5)


@_query("a14_instance_scores", f"WITH {_SCORED} SELECT vec_id, issued_at, valid_time, lead_day, n::INT AS n_members, {_rs('observed', 'mean', 'spread', 'crps')}, observed BETWEEN lo AND hi AS inside FROM sc")
def _(spark, sf_dir):
    return _instances(spark, sf_dir).select("vec_id", "issued_at", "valid_time", "lead_day", "n_members", *_r("observed", "mean", "spread", "crps"), "inside")


@_query("a12_fair_crps", f"WITH {_SCORED} SELECT vec_id, round(crps + 0.0000001, 4) AS crps FROM sc")
def _(spark, sf_dir):
    return _instances(spark, sf_dir).select("vec_id", *_r("crps"))


_BIASED = f"{_SCORED}, b AS (SELECT s.*, (SELECT CASE WHEN count(*) >= 5 THEN avg(t.mean - t.observed) END FROM sc t WHERE t.lead_day = s.lead_day AND t.valid_time < s.issued_at AND t.valid_time >= s.issued_at - INTERVAL 30 DAY) AS bias FROM sc s)"


@_query("j14_causal_bias", f"WITH {_BIASED} SELECT vec_id, round(bias + 0.0000001, 4) AS bias FROM b")
def _(spark, sf_dir):
    return _instances(spark, sf_dir).select("vec_id", *_r("bias"))


@_query("a15_scores_by_lead", f"""WITH {_BIASED}, g AS (SELECT ensemble, lead_day, count(*) AS n, count(DISTINCT issued_at::DATE) AS days, avg(crps) AS crps, avg(abs(mean - observed)) AS mean_mae, avg(mean - observed) AS bias,
  sqrt(avg(spread * spread)) AS spread, avg((observed BETWEEN lo AND hi)::INT) AS coverage, count(bias) AS n_bc, count(DISTINCT CASE WHEN bias IS NOT NULL THEN issued_at::DATE END) AS d_bc, avg(abs(mean - bias - observed)) AS mean_mae_bc FROM b GROUP BY ALL)
SELECT ensemble, lead_day, n, days, {_rs('crps', 'mean_mae', 'bias', 'spread', 'coverage')}, CASE WHEN d_bc >= 5 THEN n_bc ELSE 0 END AS n_bc, CASE WHEN d_bc >= 5 AND n_bc >= 20 THEN round(mean_mae_bc + 0.0000001, 4) END AS mean_mae_bc FROM g WHERE n >= 20 AND days >= 5""")
def _(spark, sf_dir):
    df = ensemble.scores_by_lead(_instances(spark, sf_dir))
    return df.select("ensemble", "lead_day", "n", "days", *_r("crps", "mean_mae", "bias", "spread", "coverage"), F.col("n_bc").cast("long").alias("n_bc"), *_r("mean_mae_bc"))


@_query("j5_same_job", f"""WITH {tb.FC}, {tb.ENS}, f AS (SELECT DISTINCT location, issued_at + INTERVAL 1 HOUR - INTERVAL 20 MINUTE AS det FROM fc)
SELECT e.vec_id, max(det) AS det_issued FROM ens e LEFT JOIN f ON f.location = e.location AND det <= e.issued_at AND det >= e.issued_at - INTERVAL 30 MINUTE GROUP BY 1""")
def _(spark, sf_dir):
    fc = tb.forecasts(spark, sf_dir).withColumn("issued_at", F.col("issued_at") + F.make_dt_interval(mins=F.lit(40)))
    return ensemble.same_job(tb.ensembles(spark, sf_dir), fc).select("vec_id", "det_issued")


@_query("a15_rivals_by_lead")
def _(spark, sf_dir):
    p = pairs(spark, sf_dir)
    df = ensemble.rivals_by_lead(_instances(spark, sf_dir), p, sibling="click", blend="purchase")
    return df.select("location", "ensemble", "lead_day", "best_model", *_r("best_mae", "sibling_mae", "blend_mae", "blend_mae_bc"))


@_query("a16_mae_on_subset", f"""WITH {tb.PAIRS}, k AS (SELECT DISTINCT location, issued_at, valid_time FROM pairs WHERE model = 'click')
SELECT model, round(avg(abs_error) + 0.0000001, 4) AS mae, count(*) AS n FROM pairs SEMI JOIN k USING (location, issued_at, valid_time) GROUP BY 1 HAVING count(*) >= 0.05 * (SELECT count(*) FROM k)""")
def _(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return ensemble.mae_on_subset(p, p.where("model = 'click'"), ["location", "issued_at", "valid_time"], complete=0.05).select("model", *_r("mae"), "n")


# ---- history ----


def _hourly(spark, sf_dir):
    return tb.observations(spark, sf_dir).select("location", F.col("time").alias("ts"), F.col("value").alias("v"))


@_query("w5_qc_hourly", f"""WITH {tb.OBS}, r AS (SELECT location, time AS ts, value AS v FROM obs WHERE value BETWEEN 0.5 AND 100),
m AS (SELECT *, count(v) OVER w AS c, quantile_cont(v, 0.5) OVER w AS med FROM r WINDOW w AS (PARTITION BY location ORDER BY epoch_us(ts) RANGE BETWEEN 8999999999 PRECEDING AND 9000000000 FOLLOWING))
SELECT location, ts, CASE WHEN v < 2 THEN 0.0 ELSE v END AS v FROM m WHERE c < 3 OR abs(v - med) <= 30""")
def _(spark, sf_dir):
    return history.qc_hourly(_hourly(spark, sf_dir), limits=(0.5, 100.0), spike=(5, 30.0), noise_floor=2.0)


@_query("a17_daily_values", f"""WITH {tb.OBS} SELECT location, timezone('America/Vancouver', timezone('UTC', time))::DATE AS day, round(avg(value) + 0.0000001, 4) AS v, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) >= 20""")
def _(spark, sf_dir):
    return history.daily_values(_hourly(spark, sf_dir)).select("location", "day", *_r("v"), "n")


@_query("w4_running_mean", f"""WITH {tb.STATION}, sp AS (SELECT location, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM station GROUP BY 1),
j AS (SELECT sp.location, sp.day, v FROM sp LEFT JOIN station USING (location, day)), w AS (SELECT *, count(v) OVER x AS c, avg(v) OVER x AS m FROM j WINDOW x AS (PARTITION BY location ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT location, day, round(m + 0.0000001, 4) AS v FROM w WHERE c >= 5""")
def _(spark, sf_dir):
    return history.running_mean(tb.station_days(spark, sf_dir)).select("location", "day", *_r("v"))


_IN_WINTER = "(month(day) >= 11 OR month(day) <= 4)"
_WINTER = "(year(day) + CASE WHEN month(day) >= 11 THEN 1 ELSE 0 END)::INT"
_FIX = "CASE WHEN month(day) = 2 AND day(day) = 29 THEN 28 ELSE day(day) END"
_POS = f"date_diff('day', DATE '2001-11-01', make_date(2001 + CASE WHEN month(day) < 11 THEN 1 ELSE 0 END, month(day), {_FIX}))::INT"
_LONG = f"wl AS (SELECT location, {_WINTER} AS season_year, {_POS} AS pos, arg_min(v, day) AS v FROM station WHERE {_IN_WINTER} GROUP BY ALL)"


@_query("d13_season_long", f"WITH {tb.STATION}, {_LONG} SELECT location, season_year, pos, round(v + 0.0000001, 4) AS v FROM wl")
def _(spark, sf_dir):
    return history.season_long(tb.station_days(spark, sf_dir), "winter").select("location", "season_year", "pos", *_r("v"))


@_query("a29_season_matrix", f"WITH {tb.STATION}, {_LONG} SELECT location, season_year, 181 AS places, count(*) AS n, round(sum(v * (pos + 1)) + 0.0000001, 2) AS checksum FROM wl GROUP BY ALL")
def _(spark, sf_dir):
    m = history.season_matrix(history.season_long(tb.station_days(spark, sf_dir), "winter"), "winter")
    weighted = F.aggregate(F.transform("values", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return m.select("location", "season_year", F.size("values").alias("places"), F.size(F.filter("values", lambda v: v.isNotNull())).cast("long").alias("n"), F.round(weighted + _OFF_TIES, 2).alias("checksum"))


_POOL = f"pool AS (SELECT location, ((({tb.DOY} + o - 1) % 365 + 365) % 365 + 1)::INT AS doy, year(day) AS year, v FROM station, (SELECT unnest(generate_series(-7, 7)) AS o) WHERE year(day) BETWEEN {YEARS[0]} AND {YEARS[1]})"


@_query("a18_doy_climatology", f"""WITH {tb.STATION}, {_POOL}, ny AS (SELECT location, count(DISTINCT year) AS n_years FROM pool GROUP BY 1)
SELECT location, doy, round(quantile_cont(v, 0.1) + 0.0000001, 4) AS q10, round(quantile_cont(v, 0.25) + 0.0000001, 4) AS q25, round(quantile_cont(v, 0.5) + 0.0000001, 4) AS q50, round(quantile_cont(v, 0.75) + 0.0000001, 4) AS q75, round(quantile_cont(v, 0.9) + 0.0000001, 4) AS q90, count(*) AS n, n_years FROM pool JOIN ny USING (location) GROUP BY location, doy, n_years""")
def _(spark, sf_dir):
    df = history.doy_climatology(tb.station_days(spark, sf_dir), YEARS)
    return df.select("location", "doy", *_quantiles(10, 25, 50, 75, 90), "n", "n_years")


@_query("a19_doy_pools", f"WITH {tb.STATION}, {_POOL} SELECT location, doy, count(*) AS n, round(sum(v) + 0.0000001, 2) AS total FROM pool GROUP BY ALL")
def _(spark, sf_dir):
    return history.doy_pools(tb.station_days(spark, sf_dir), YEARS).groupBy("location", "doy").agg(F.count("*").alias("n"), F.round(F.sum("v") + _OFF_TIES, 2).alias("total"))


@_query("f15_percentile_rank", f"""WITH {tb.STATION}, {_POOL}, d AS (SELECT location, day, v, {tb.DOY} AS doy FROM station WHERE year(day) = 2000)
SELECT d.location, day, round(100.0 * (count(*) FILTER (p.v < d.v) + 0.5 * count(*) FILTER (p.v = d.v)) / count(*) + 0.0000001, 4) AS pct FROM d JOIN pool p USING (location, doy) GROUP BY ALL""")
def _(spark, sf_dir):
    days = tb.station_days(spark, sf_dir)
    return history.day_percentiles(days, days.where(F.year("day") == 2000), YEARS).select("location", "day", *_r("pct"))


_MEANS = f"""g AS (SELECT location, {_WINTER} AS year, avg(v) AS v, count(*) AS n FROM station WHERE {_IN_WINTER} GROUP BY ALL),
sm AS (SELECT * FROM g WHERE n >= 0.5 * date_diff('day', make_date(year - 1, 11, 1), make_date(year, 5, 1)))"""


@_query("a21_season_means", f"WITH {tb.STATION}, {_MEANS} SELECT location, year, round(v + 0.0000001, 4) AS v, n FROM sm")
def _(spark, sf_dir):
    return history.season_means(tb.station_days(spark, sf_dir), "winter", min_coverage=0.5).select("location", "year", *_r("v"), "n")


@_query("f16_rank_among", f"WITH {tb.STATION}, {_MEANS} SELECT location, year, round(v + 0.0000001, 4) AS v, rank() OVER (PARTITION BY location ORDER BY v DESC)::INT AS rank, count(*) OVER (PARTITION BY location) AS out_of FROM sm")
def _(spark, sf_dir):
    means = history.season_means(tb.station_days(spark, sf_dir), "winter", min_coverage=0.5)
    return history.rank_among(means, ["location"]).select("location", "year", *_r("v"), "rank", "out_of")


@_query("a21_year_means", f"WITH {tb.ALL_DAYS}, g AS (SELECT location, year(day)::INT AS year, avg(v) AS v, count(*) AS n FROM alldays GROUP BY ALL) SELECT location, year, round(v + 0.0000001, 4) AS v, n FROM g WHERE n >= 0.9 * date_diff('day', make_date(year, 1, 1), make_date(year + 1, 1, 1))")
def _(spark, sf_dir):
    return history.season_means(tb.all_days(spark, sf_dir), "year").select("location", "year", *_r("v"), "n")


@_query("a22_monthly_season_means", f"""WITH {tb.ALL_DAYS}, mo AS (SELECT location, date_trunc('month', day)::DATE AS day, avg(v) AS v FROM alldays GROUP BY ALL)
SELECT location, {_WINTER} AS year, round(avg(v) + 0.0000001, 4) AS v, count(*) AS n FROM mo WHERE {_IN_WINTER} GROUP BY ALL HAVING count(*) = 6""")
def _(spark, sf_dir):
    months = tb.all_days(spark, sf_dir).groupBy("location", F.trunc("day", "month").alias("day")).agg(F.avg("v").alias("v"))
    return history.monthly_season_means(months, "winter").select("location", "year", *_r("v"), "n")


@_query("a23_same_days_means", f"""WITH {tb.STATION}, {_LONG}, p AS (SELECT DISTINCT pos FROM wl WHERE season_year = 1999 AND location = '1-URGENT' AND pos < 60)
SELECT location, season_year, round(avg(v) + 0.0000001, 4) AS v, count(*) AS n FROM wl SEMI JOIN p USING (pos) GROUP BY ALL HAVING count(*) >= 0.8 * (SELECT count(*) FROM p)""")
def _(spark, sf_dir):
    long = history.season_long(tb.station_days(spark, sf_dir), "winter")
    so_far = long.where("season_year = 1999 and location = '1-URGENT' and pos < 60")
    return history.same_days_means(long, so_far.select("pos")).select("location", "season_year", *_r("v"), "n")


@_query("a24_window_means", f"WITH {tb.STATION} SELECT location, year(day)::INT AS year, round(avg(v) + 0.0000001, 4) AS v FROM station WHERE strftime(day, '%m-%d') BETWEEN '03-25' AND '04-07' GROUP BY ALL")
def _(spark, sf_dir):
    return history.window_means(tb.station_days(spark, sf_dir), "03-25", "04-07").select("location", "year", *_r("v"))


@_query("a25_season_band", f"""WITH {tb.STATION}, {_LONG}, x AS (SELECT location, season_year, (pos + o)::INT AS pos, v FROM wl, (SELECT unnest(generate_series(-3, 3)) AS o) WHERE pos + o BETWEEN 0 AND 180)
SELECT location, pos, round(quantile_cont(v, 0.1) + 0.0000001, 4) AS q10, round(quantile_cont(v, 0.5) + 0.0000001, 4) AS q50, round(quantile_cont(v, 0.9) + 0.0000001, 4) AS q90, count(DISTINCT season_year) AS seasons FROM x GROUP BY ALL HAVING count(DISTINCT season_year) >= 5""")
def _(spark, sf_dir):
    long = history.season_long(tb.station_days(spark, sf_dir), "winter")
    return history.season_band(long, "winter", min_seasons=5).select("location", "pos", *_quantiles(10, 50, 90), "seasons")


@_query("a26_average_line", f"WITH {tb.STATION}, {_LONG} SELECT location, pos, round(median(v) + 0.0000001, 4) AS v, count(*) AS seasons FROM wl GROUP BY ALL HAVING count(*) >= 5")
def _(spark, sf_dir):
    return history.average_line(history.season_long(tb.station_days(spark, sf_dir), "winter"), min_seasons=5).select("location", "pos", *_r("v"), "seasons")


_DIFF = f"{tb.ALL_DAYS}, {tb.MODEL}, d AS (SELECT s.location, s.day, m.v AS m, s.v AS s, s.v - m.v AS d FROM alldays s JOIN model m USING (location, day))"
_OFF = "ov AS (SELECT location, avg(d) AS overall FROM d GROUP BY 1), own AS (SELECT location, month(day) AS month, avg(d) AS o, count(*) AS n FROM d GROUP BY ALL), off AS (SELECT location, k::INT AS month, CASE WHEN coalesce(n, 0) >= 10 THEN o ELSE overall END AS offset_, coalesce(n, 0) AS n FROM ov CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS k) LEFT JOIN own USING (location) WHERE own.month = k)"


@_query("a20_monthly_offsets", f"WITH {_DIFF}, {_OFF} SELECT location, month, round(offset_ + 0.0000001, 4) AS offset, n FROM off")
def _(spark, sf_dir):
    return history.monthly_offsets(tb.model_days(spark, sf_dir), tb.all_days(spark, sf_dir)).select("location", "month", *_r("offset"), "n")


_KNOTS = "list_value(15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349, 380)"


@_query("w16_apply_offsets", f"""WITH {_DIFF}, {_OFF}, k AS (SELECT location, list(offset_ ORDER BY month) AS y FROM off GROUP BY 1),
x AS (SELECT location, day, v, list_append(y, y[1]) AS y, CASE WHEN {tb.DOY} < 15 THEN {tb.DOY} + 365 ELSE {tb.DOY} END AS p FROM model JOIN k USING (location)),
i AS (SELECT *, len(list_filter({_KNOTS}[1:12], lambda z: z <= p)) AS i FROM x)
SELECT location, day, round(v + y[i] + (y[i + 1] - y[i]) * (p - {_KNOTS}[i]) / ({_KNOTS}[i + 1] - {_KNOTS}[i]) + 0.0000001, 4) AS v FROM i""")
def _(spark, sf_dir):
    model = tb.model_days(spark, sf_dir)
    return history.apply_offsets(model, history.monthly_offsets(model, tb.all_days(spark, sf_dir))).select("location", "day", *_r("v"))


@_query("m5_band_coverage")
def _(spark, sf_dir):
    return history.adjusted_band_coverage(tb.model_days(spark, sf_dir), tb.all_days(spark, sf_dir))


@_query("m6_mean_change", f"""WITH {_DIFF}, s AS (SELECT *, d - avg(d) OVER (PARTITION BY location, month(day)) AS e FROM d)
SELECT location, round(avg(e) FILTER (day < DATE '1998-06-01') + 0.0000001, 4) AS before, round(avg(e) FILTER (day >= DATE '1998-06-01') + 0.0000001, 4) AS after, count(*) FILTER (day < DATE '1998-06-01') AS n_before, count(*) FILTER (day >= DATE '1998-06-01') AS n_after FROM s GROUP BY 1""")
def _(spark, sf_dir):
    d = history.difference(tb.model_days(spark, sf_dir), tb.all_days(spark, sf_dir), ["location"])
    return history.mean_change(d, F.lit("1998-06-01").cast("date")).select("location", *_r("before", "after"), "n_before", "n_after")


_STEPS = f"WITH RECURSIVE {_DIFF}, s AS (SELECT *, d - avg(d) OVER (PARTITION BY location, month(day)) AS e FROM d), {draws_sql.month_rounds('1998-06-01')} SELECT * FROM steps"


@_query("m6_step_change", _STEPS)
def _(spark, sf_dir):
    return resampling.step_change(tb.all_days(spark, sf_dir), tb.model_days(spark, sf_dir), "1998-06-01")


_YEARLY = "y AS (SELECT location, (year(day) * 2 + CASE WHEN month(day) > 6 THEN 1 ELSE 0 END)::INT AS year, avg(v) AS v FROM station GROUP BY ALL)"


def _half_years(spark, sf_dir):
    half = (F.year("day") * 2 + F.when(F.month("day") > 6, 1).otherwise(0)).alias("year")
    return tb.station_days(spark, sf_dir).groupBy("location", half).agg(F.avg("v").alias("v"))


@_query("m7_sen_slope", f"""WITH {tb.STATION}, {_YEARLY}, n AS (SELECT location, count(*) AS n, min(year) AS start, max(year) AS "end" FROM y GROUP BY 1 HAVING count(*) >= 8)
SELECT location, round(10 * median((b.v - a.v) / (b.year - a.year)) + 0.0000001, 4) AS slope, n, start, "end" FROM y a JOIN y b USING (location) JOIN n USING (location) WHERE a.year < b.year GROUP BY ALL""")
def _(spark, sf_dir):
    return resampling.sen_slope(_half_years(spark, sf_dir)).select("location", *_r("slope"), "n", "start", "end")


_TRENDS = f"WITH RECURSIVE {tb.STATION}, {_YEARLY}, {draws_sql.year_rounds('location')}"


@_query("m7_sen_slope_range", f"{_TRENDS} SELECT * FROM trends")
def _(spark, sf_dir):
    return resampling.sen_slope_range(_half_years(spark, sf_dir))


@_query("f19_trend_statement", f"{_TRENDS} SELECT {draws_sql.STATEMENT} FROM trends")
def _(spark, sf_dir):
    return resampling.trend_statement(resampling.sen_slope_range(_half_years(spark, sf_dir)))


@_query("m8_detrend", f"WITH {tb.STATION}, {_YEARLY}, l AS (SELECT location, regr_slope(v, year) AS s, regr_intercept(v, year) AS i FROM y GROUP BY 1) SELECT location, year, round(v - i - s * year + 0.0000001, 4) AS v FROM y JOIN l USING (location)")
def _(spark, sf_dir):
    return history.detrend(_half_years(spark, sf_dir)).select("location", "year", *_r("v"))


@_query("m9_permutation_test")
def _(spark, sf_dir):
    return resampling.permutation_test(_half_years(spark, sf_dir).withColumn("in_a", F.col("year") % 2 == 0))


_ENSO = "CASE WHEN anom <= -1 THEN 0 WHEN anom <= -0.5 THEN 1 WHEN anom < 0.5 THEN 2 WHEN anom < 1 THEN 3 ELSE 4 END"
_PHASES = "[" + ", ".join(f"'{p}'" for p in scalar.ENSO_CLASSES) + "]"


@_query("a28_enso_composite", f"""WITH {tb.STATION}, {_YEARLY}, w AS (SELECT DISTINCT year, ((year * 37) % 29 - 14) / 8.0 AS anom FROM y), j AS (SELECT location, {_ENSO} AS ord, v - 150 AS v FROM y JOIN w USING (year))
SELECT l.location, o::INT AS ord, ({_PHASES})[o + 1] AS phase, count(j.v) AS n, round(avg(j.v) + 0.0000001, 4) AS mean, count(*) FILTER (j.v > 0) AS above FROM (SELECT DISTINCT location FROM y) l CROSS JOIN (SELECT unnest(range(5)) AS o) LEFT JOIN j ON j.location = l.location AND j.ord = o GROUP BY ALL""")
def _(spark, sf_dir):
    y = _half_years(spark, sf_dir)
    winters = y.select("year").distinct().select("year", ((F.col("year") * 37 % 29 - 14) / 8.0).alias("anom"))
    return history.enso_composite(y.withColumn("v", F.col("v") - 150), winters).select("location", "ord", "phase", "n", *_r("mean"), "above")


@_query("w13_snow_milestones")
def _(spark, sf_dir):
    df = history.snow_milestones(history.running_mean(tb.station_days(spark, sf_dir)), threshold=140.0)
    return df.select("location", "season_year", "onset", *_r("peak"), "peak_day", "meltout")


@_query("a27_milestone_stats")
def _(spark, sf_dir):
    return history.milestone_stats(history.snow_milestones(history.running_mean(tb.station_days(spark, sf_dir)), threshold=140.0))


@_query("f20_percent_of_median", f"""WITH {tb.STATION}, {_POOL}, c AS (SELECT location, doy, quantile_cont(v, 0.5) AS median FROM pool GROUP BY ALL), s AS (SELECT *, {tb.DOY} AS doy,
 CASE WHEN month(day) >= 10 OR month(day) <= 6 THEN date_diff('day', DATE '2001-10-01', make_date(2001 + CASE WHEN month(day) < 10 THEN 1 ELSE 0 END, month(day), {_FIX})) END AS pos FROM station)
SELECT s.location, day, CASE WHEN median >= 0.2 AND pos >= 61 THEN round(v / median * 100 + 0.0000001, 3) END AS pct_of_median FROM s LEFT JOIN c ON s.location = c.location AND s.doy = c.doy""")
def _(spark, sf_dir):
    days = tb.station_days(spark, sf_dir)
    clim = history.doy_climatology(days, YEARS, quantiles=(0.5,)).select("location", "doy", F.col("q")[0].alias("median"))
    return history.percent_of_median(days, clim).select("location", "day", *_r("pct_of_median", digits=3))


# ---- series ----


@_query("w7_islands", f"""WITH {tb.OBS}, g AS (SELECT location, time AS ts, value AS v, coalesce(epoch_us(time) - epoch_us(lag(time) OVER w) > 3660000000, true)::INT AS new FROM obs WINDOW w AS (PARTITION BY location ORDER BY time)),
i AS (SELECT *, sum(new) OVER (PARTITION BY location ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g)
SELECT location, ts, island, round(quantile_cont(v, 0.5) OVER (PARTITION BY location, island ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + 0.0000001, 4) AS smooth FROM i""")
def _(spark, sf_dir):
    return series.smooth_in_islands(_hourly(spark, sf_dir), ["location"]).select("location", "ts", "island", *_r("smooth"))


@_query("w14_whole_hours", f"""WITH {tb.OBS}, l AS (SELECT location, epoch_us(time) / 1e6 AS t0, value AS v0, epoch_us(lead(time) OVER w) / 1e6 AS t1, lead(value) OVER w AS v1 FROM obs WINDOW w AS (PARTITION BY location ORDER BY time)),
h AS (SELECT *, unnest(generate_series(ceil(t0 / 3600)::BIGINT, floor(t1 / 3600)::BIGINT)) AS h FROM l WHERE t1 - t0 <= 5400)
SELECT location, make_timestamp(h * 3600000000) AS ts, round(min(v0 + (v1 - v0) * (h * 3600 - t0) / (t1 - t0)) + 0.0000001, 4) AS v FROM h GROUP BY ALL""")
def _(spark, sf_dir):
    return series.to_whole_hours(_hourly(spark, sf_dir)).select("location", "ts", *_r("v"))


@_query("w15_append_newer", f"""WITH {tb.OBS}, o AS (SELECT location, time AS ts, value AS v FROM obs), old AS (SELECT * FROM o WHERE ts < TIMESTAMP '2024-01-15'), l AS (SELECT location, max(ts) AS last FROM old GROUP BY 1)
SELECT * FROM old UNION ALL SELECT o.* FROM o JOIN l USING (location) WHERE ts > last""")
def _(spark, sf_dir):
    df = _hourly(spark, sf_dir)
    return series.append_newer(df.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp")), df)


@_query("a33_daily_table", f"WITH {tb.OBS} SELECT location, timezone('America/Vancouver', timezone('UTC', time))::DATE AS day, min(value) AS low, max(value) AS high, round(avg(value) + 0.0000001, 4) AS mean, round(sum(value) + 0.0000001, 2) AS total, count(*) AS n FROM obs GROUP BY ALL")
def _(spark, sf_dir):
    return series.daily_table(_hourly(spark, sf_dir), ["location"]).select("location", "day", "low", "high", *_r("mean"), *_r("total", digits=2), "n")


@_query("a34_circular_mean", f"""WITH {tb.OBS}, g AS (SELECT location, timezone('America/Vancouver', timezone('UTC', time))::DATE AS day, degrees(atan2(sum(sin(radians(value * 11))), sum(cos(radians(value * 11))))) AS a FROM obs GROUP BY ALL)
SELECT location, day, round(a - 360 * floor(a / 360) + 0.0000001, 3) AS direction, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[round((a - 360 * floor(a / 360)) / 45)::INT % 8 + 1] AS compass FROM g""")
def _(spark, sf_dir):
    df = _hourly(spark, sf_dir).withColumn("degrees", F.col("v") * 11)
    return series.wind_table(df, ["location"]).select("location", "day", *_r("direction", digits=3), "compass")


@_query("a35_stripes", f"WITH {tb.STATION}, {_YEARLY}, m AS (SELECT location, year, v - avg(v) OVER (PARTITION BY location) AS v FROM y), s AS (SELECT location, sqrt(avg(v * v)) AS r FROM m GROUP BY 1) SELECT location, year, round(greatest(-1, least(1, v / (2 * r))) + 0.0000001, 4) AS shade FROM m JOIN s USING (location)")
def _(spark, sf_dir):
    y = _half_years(spark, sf_dir)
    mean = y.groupBy("location").agg(F.avg("v").alias("mean"))
    return series.stripes(y.join(mean, "location").withColumn("v", F.col("v") - F.col("mean")), ["location"]).select("location", "year", *_r("shade"))


@_query("j18_grid", f"""WITH {tb.FC}, r AS (SELECT location, model, valid_time, value FROM (SELECT *, max(issued_at) OVER (PARTITION BY location, model, valid_time) AS n FROM fc) WHERE issued_at = n),
t AS (SELECT DISTINCT location, valid_time FROM r), s AS (SELECT DISTINCT location, model FROM r) SELECT t.location, s.model, t.valid_time, r.value FROM t JOIN s USING (location) LEFT JOIN r ON r.location = t.location AND r.model = s.model AND r.valid_time = t.valid_time""")
def _(spark, sf_dir):
    newest = latest_run(tb.forecasts(spark, sf_dir), ["location", "model", "valid_time"])
    return series.align_on_times(newest).select("location", "model", "valid_time", "value")


@_query("w18_thin_frames", """WITH f AS (SELECT DISTINCT 'cam' || (user_id % 3)::VARCHAR AS camera, date_trunc('minute', ts) AS time FROM events), r AS (SELECT *, time >= TIMESTAMP '2024-01-20' AS recent FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY camera, time::DATE ORDER BY abs(hour(time) * 60 + minute(time) - 1200), time DESC) AS k FROM r WHERE NOT recent) SELECT camera, time FROM r WHERE recent UNION ALL SELECT camera, time FROM o WHERE k = 1""")
def _(spark, sf_dir):
    return series.thin_frames(tb.frames(spark, sf_dir), F.lit("2024-02-19").cast("timestamp"))


@_query("o6_latest_frames", """WITH f AS (SELECT DISTINCT 'cam' || (user_id % 3)::VARCHAR AS camera, date_trunc('minute', ts) AS time FROM events) SELECT camera, time FROM f QUALIFY row_number() OVER (PARTITION BY camera ORDER BY time DESC) <= 50""")
def _(spark, sf_dir):
    return series.latest_frames(tb.frames(spark, sf_dir), 50)


_FREEZE = f"""{tb.OBS}, b AS (SELECT time, value / 10 - 3 AS tb FROM obs WHERE location = 'bottom'), t AS (SELECT time AS t2, value / 10 - 5 AS tt FROM obs WHERE location = 'top'),
p AS (SELECT b.time, tb, arg_min(tt, {{d: abs(epoch_us(t2) - epoch_us(b.time)), t: epoch_us(t2)}}) AS tt FROM b JOIN t ON t2 BETWEEN b.time - INTERVAL 30 MINUTE AND b.time + INTERVAL 30 MINUTE GROUP BY ALL),
f AS (SELECT *, CASE WHEN tb > tt THEN 740 + 410 * tb / (tb - tt) END AS h0, CASE WHEN tb > tt THEN 410 / pow(tb - tt, 2) * sqrt(tt * tt + tb * tb) END AS s FROM p)"""


@_query("f17_freezing_level", f"""WITH {_FREEZE} SELECT time, round(tb + 0.0000001, 4) AS t_bottom, round(tt + 0.0000001, 4) AS t_top, round(h0 + 0.0000001, 2) AS h0, round(h0 - s + 0.0000001, 2) AS lower, round(h0 + s + 0.0000001, 2) AS upper,
CASE WHEN h0 IS NULL THEN 'inversion' WHEN h0 < 740 THEN 'below' WHEN h0 > 1150 THEN 'above' ELSE 'interp' END AS regime, coalesce(2 * s <= 500 AND h0 BETWEEN 240 AND 1850, false) AS shown FROM f""")
def _(spark, sf_dir):
    obs = tb.observations(spark, sf_dir)
    at = lambda place, less: obs.where(F.col("location") == place).withColumn("value", F.col("value") / 10 - less)
    df = series.freezing_levels(series.pair_stations(at("bottom", 3), at("top", 5)))
    return df.select("time", *_r("t_bottom", "t_top"), *_r("h0", "lower", "upper", digits=2), "regime", "shown")


@_query("a32_cross_check", f"""WITH {_FREEZE}, e AS (SELECT time, h0 FROM f WHERE h0 IS NOT NULL), r AS (SELECT model, valid_time, value * 30 AS value FROM (SELECT 'x' AS l, * FROM ({f"SELECT event_type AS model, date_trunc('hour', ts) AS valid_time, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'view' GROUP BY ALL"}))),
n AS (SELECT model, valid_time, value, arg_min(h0, {{d: abs(epoch_us(time) - epoch_us(valid_time)), t: epoch_us(time)}}) AS h0 FROM r JOIN e ON time BETWEEN valid_time - INTERVAL 30 MINUTE AND valid_time + INTERVAL 30 MINUTE GROUP BY ALL)
SELECT model, count(*) AS n, round(avg(abs(value - h0)) + 0.0000001, 3) AS mae, round(avg(value - h0) + 0.0000001, 3) AS bias FROM n GROUP BY 1 HAVING count(*) >= 30""")
def _(spark, sf_dir):
    obs = tb.observations(spark, sf_dir)
    at = lambda place, less: obs.where(F.col("location") == place).withColumn("value", F.col("value") / 10 - less)
    levels = series.freezing_levels(series.pair_stations(at("bottom", 3), at("top", 5))).where("h0 is not null").select("time", "h0")
    rows = verification.keep_last(tb.raw_forecasts(spark, sf_dir).select("model", "valid_time", "value", "event_id"), ["model", "valid_time"], ["event_id"])
    rows = rows.select("model", "valid_time", (F.col("value") * 30).alias("value"))
    both = asof.nearest_asof(rows, levels, left_on="valid_time", right_on="time").withColumn("error", F.col("value") - F.col("h0"))
    return verification.metrics_by(both, ["model"], 30).select("model", "n", *_r("mae", "bias", digits=3))


@_query("a36_missing_models", f"""WITH {tb.FC}, g AS (SELECT DISTINCT location, model FROM fc WHERE valid_time < TIMESTAMP '2024-01-01 03:00:00'), e AS (SELECT l.location, m.model FROM (SELECT DISTINCT location FROM fc) l CROSS JOIN (SELECT DISTINCT model FROM fc) m)
SELECT location, string_agg(model, ',' ORDER BY model) AS missing FROM e ANTI JOIN g USING (location, model) GROUP BY 1""")
def _(spark, sf_dir):
    fc = tb.forecasts(spark, sf_dir)
    models = F.broadcast(fc.select("model").distinct())  # one row for each model
    expected = fc.select("location").distinct().crossJoin(models)
    return series.missing_models(expected, fc.where(F.col("valid_time") < F.lit("2024-01-01 03:00:00").cast("timestamp"))).withColumn("missing", F.array_join("missing", ","))


@_query("j7_unseen", f"WITH {tb.OBS} SELECT a.location, a.time, a.value FROM obs a ANTI JOIN (SELECT location, time FROM obs WHERE time < TIMESTAMP '2024-01-25') b USING (location, time)")
def _(spark, sf_dir):
    obs = tb.observations(spark, sf_dir)
    return series.unseen(obs, obs.where(F.col("time") < F.lit("2024-01-25").cast("timestamp")), ["location", "time"])


@_query("s12_parse_props", "SELECT event_id, 'k' AS key, (props->>'k')::DOUBLE AS value FROM events WHERE (props->>'k') IS NOT NULL")
def _(spark, sf_dir):
    df = tb.table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return df.select("event_id", "key", F.col("v").try_cast("double").alias("value")).where("value is not null")


def _parsed_forecasts(events: DataFrame) -> DataFrame:
    values = F.concat(F.lit("["), F.array_join(F.array(*[F.round(F.col("value") + h, 4).cast("string") for h in range(3)]), ","), F.lit("]"))
    body = F.format_string('{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], "t_gfs": %s, "t_gfs_hr": %s, "x_other": [1, null, 2]}}', values, values)
    got = parsers.parse_forecast_json(events.select("event_id", F.lit("a").alias("location"), body.alias("body")), "body", ["gfs", "gfs_hr"], ["t"])
    return got.select("event_id", "location", "model", "variable", "valid_time", *_r("value"))


@_query("s12_parse_forecast_json", """SELECT event_id, 'a' AS location, m AS model, 't' AS variable, make_timestamp(1704067200000000 + h * 3600000000) AS valid_time, round(value + h + 0.0000001, 4) AS value FROM events, (SELECT unnest(range(3)) AS h), (SELECT unnest(['gfs', 'gfs_hr']) AS m)""")
def _(spark, sf_dir):
    return _parsed_forecasts(tb.table(spark, sf_dir, "events"))


@_query("s12_parse_forecast_json_all", """SELECT event_id, 'a' AS location, m AS model, 't' AS variable, make_timestamp(1704067200000000 + h * 3600000000) AS valid_time, round(value + h + 0.0000001, 4) AS value FROM events, (SELECT unnest(range(3)) AS h), (SELECT unnest(['gfs', 'gfs_hr']) AS m) WHERE event_type = 'click'""")
def _(spark, sf_dir):
    return _parsed_forecasts(tb.table(spark, sf_dir, "events").where("event_type = 'click'"))


@_query("f10_calendar", """SELECT DISTINCT o_orderdate::DATE AS day, (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 11 THEN 1 ELSE 0 END)::INT AS winter, dayofyear(make_date(2001, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN 28 ELSE day(o_orderdate) END))::INT AS doy,
CASE WHEN month(o_orderdate) >= 11 OR month(o_orderdate) <= 4 THEN (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 11 THEN 1 ELSE 0 END)::INT ELSE year(o_orderdate)::INT END AS latest FROM orders""")
def _(spark, sf_dir):
    d = tb.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    day = F.col("day")
    return d.select("day", ft.season_year(day, "winter").alias("winter"), ft.day_of_year(day).alias("doy"), ft.latest_season(day, "winter").alias("latest"))


@_query("a37_counts_and_range", f"WITH {tb.FC} SELECT location, model, count(*) AS n, min(valid_time) AS first, max(valid_time) AS last, strftime(max(valid_time), '%Y-%m-%dT%H:%MZ') AS last_text FROM fc GROUP BY ALL")
def _(spark, sf_dir):
    g = tb.forecasts(spark, sf_dir).groupBy("location", "model").agg(F.count("*").alias("n"), F.min("valid_time").alias("first"), F.max("valid_time").alias("last"))
    return g.withColumn("last_text", ft.iso_minute(F.col("last")))


def _every() -> None:
    from nimbora.plans import log_catalog, report_catalog, stream_catalog  # noqa: F401  they register their queries here


def queries() -> dict:
    _every()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _every()
    return dict(_SQL)
