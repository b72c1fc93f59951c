"""Queries of whole reports and of corrected scores, registered beside the operators' own."""

from __future__ import annotations

from pyspark.sql import functions as F

from nimbora.functions import scalar
from nimbora.functions import time as ft
from nimbora.operators import blend, ensemble, history, resampling, series, verification
from nimbora.plans import catalog as c
from nimbora.plans import draws_sql, reports
from nimbora.plans import testbed as tb

_query, _r, _rs = c._query, c._r, c._rs
_TEXT_DAY = "* REPLACE (day::VARCHAR AS day)"


def _stamp(text: str):
    return F.lit(text).cast("timestamp")


# ---- corrected scores ----

_CORRECTED = f"""{c._BIASED}, bc AS (SELECT *, observed + bias AS y FROM b), cs AS (SELECT *, y BETWEEN lo AND hi AS inside_bc, CASE WHEN bias IS NOT NULL THEN list_avg(list_transform(members, lambda x: abs(x - y)))
  - list_sum(list_transform(range(1, len(members) + 1), lambda i: (2 * i - len(members) - 1) * list_sort(members)[i])) / (len(members) * (len(members) - 1.0)) END AS crps_bc FROM bc)"""


@_query("a14_corrected_scores", f"WITH {_CORRECTED} SELECT vec_id, {_rs('crps_bc')}, inside_bc FROM cs")
def _(spark, sf_dir):
    return c._instances(spark, sf_dir).select("vec_id", *_r("crps_bc"), "inside_bc")


_LEADS = f"""WITH {_CORRECTED}, g AS (SELECT location, ensemble, lead_day, count(*) AS n, count(DISTINCT issued_at::DATE) AS days, sqrt(avg(spread * spread)) / sqrt(avg(pow(mean - observed, 2))) AS spread_skill,
  count(bias) AS k, count(DISTINCT CASE WHEN bias IS NOT NULL THEN issued_at::DATE END) AS kd, avg(crps_bc) AS crps_bc, avg(inside_bc::INT) AS coverage_bc,
  sqrt(avg(spread * spread) FILTER (bias IS NOT NULL)) / sqrt(avg(pow(mean - bias - observed, 2))) AS spread_skill_bc FROM cs GROUP BY ALL HAVING count(*) >= 20 AND count(DISTINCT issued_at::DATE) >= 5)
SELECT location, ensemble, lead_day, n, round(spread_skill + 0.0000001, 4) AS spread_skill, CASE WHEN kd >= 5 AND k >= 20 THEN round(crps_bc + 0.0000001, 4) END AS crps_bc, CASE WHEN kd >= 5 AND k >= 20 THEN round(coverage_bc + 0.0000001, 4) END AS coverage_bc,
  CASE WHEN kd >= 5 AND k >= 20 THEN round(spread_skill_bc + 0.0000001, 4) END AS spread_skill_bc FROM g"""


@_query("a15_corrected_by_lead", _LEADS)
def _(spark, sf_dir):
    return ensemble.scores_by_lead(c._instances(spark, sf_dir)).select("location", "ensemble", "lead_day", "n", *_r("spread_skill", "crps_bc", "coverage_bc", "spread_skill_bc"))


def _rivals_sql(complete: float) -> str:
    return f"""WITH p AS (WITH {tb.PAIRS} SELECT * FROM pairs), e AS (WITH {c._BIASED} SELECT location, ensemble, lead_day, issued_at, valid_time, bias FROM b),
d AS (SELECT e.*, (SELECT max(p.issued_at) FROM p WHERE p.location = e.location AND p.issued_at <= e.issued_at AND p.issued_at >= e.issued_at - INTERVAL 30 MINUTE) AS det FROM e),
z AS (SELECT location, ensemble, lead_day, count(*) AS n, count(bias) AS n_bc FROM e GROUP BY ALL),
m AS (SELECT d.location, d.ensemble, d.lead_day, p.model, avg(abs_error) AS mae, count(*) AS m, avg(abs_error) FILTER (bias IS NOT NULL) AS mae_bc, count(bias) AS m_bc
  FROM d JOIN p ON p.location = d.location AND p.issued_at = det AND p.valid_time = d.valid_time GROUP BY ALL),
k AS (SELECT m.*, n, n_bc FROM m JOIN z USING (location, ensemble, lead_day) WHERE m >= {complete} * n),
r AS (SELECT location, ensemble, lead_day, arg_min(model, {{m: mae, n: model}}) AS best_model, min(mae) AS best_mae FROM k WHERE model <> 'purchase' GROUP BY ALL),
o AS (SELECT location, ensemble, lead_day, max(mae) FILTER (model = 'click') AS sibling_mae, max(mae) FILTER (model = 'purchase') AS blend_mae, max(mae_bc) FILTER (model = 'purchase' AND m_bc >= {complete} * n_bc AND n_bc >= 20) AS blend_mae_bc FROM k GROUP BY ALL)
SELECT location, ensemble, lead_day, best_model, {_rs('best_mae', 'sibling_mae', 'blend_mae', 'blend_mae_bc')} FROM z LEFT JOIN r USING (location, ensemble, lead_day) LEFT JOIN o USING (location, ensemble, lead_day)"""


def _rivals(spark, sf_dir, complete):
    df = ensemble.rivals_by_lead(c._instances(spark, sf_dir), c.pairs(spark, sf_dir), sibling="click", blend="purchase", complete=complete)
    return df.select("location", "ensemble", "lead_day", "best_model", *_r("best_mae", "sibling_mae", "blend_mae", "blend_mae_bc"))


@_query("a15_rivals_of_the_hour", _rivals_sql(ensemble.COMPLETE))
def _(spark, sf_dir):
    return _rivals(spark, sf_dir, ensemble.COMPLETE)


@_query("a15_rivals_when_any", _rivals_sql(0.0))
def _(spark, sf_dir):
    """The same where one forecast is enough to compete, so that rivals are found in sparse data."""
    return _rivals(spark, sf_dir, 0.0)


@_query("q4_ensemble_report", f"SELECT * FROM ({_LEADS}) LEFT JOIN ({_rivals_sql(0.0)}) USING (location, ensemble, lead_day)")
def _(spark, sf_dir):
    scores = ensemble.scores_by_lead(c._instances(spark, sf_dir)).select("location", "ensemble", "lead_day", "n", *_r("spread_skill", "crps_bc", "coverage_bc", "spread_skill_bc"))
    return scores.join(_rivals(spark, sf_dir, 0.0), ["location", "ensemble", "lead_day"], "left")  # one shared forecast is enough in these sparse data


# ---- comparisons, without their seeded ranges ----


@_query("m1_compared_means", f"""WITH {tb.PAIRS}, {c._MAE}, ok AS (SELECT p.*, b.best FROM pairs p JOIN mae USING (location, lead_day, model) JOIN best b USING (location, lead_day)),
s AS (SELECT a.location, a.lead_day, a.best, a.model, count(*) AS n, count(DISTINCT a.valid_time::DATE) AS days, avg(a.abs_error) AS mae_a, avg(b.abs_error) AS mae_b
  FROM ok a JOIN ok b ON a.location = b.location AND a.lead_day = b.lead_day AND a.issued_at = b.issued_at AND a.valid_time = b.valid_time AND a.model <> a.best AND b.model = b.best GROUP BY ALL)
SELECT location, lead_day, best, model, n, days, {_rs('mae_a', 'mae_b')}, round(mae_a - mae_b + 0.0000001, 4) AS diff, round((mae_b - mae_a) / mae_b * 100 + 0.0000001, 4) AS pct FROM s""")
def _(spark, sf_dir):
    df = verification.compare_models(c.pairs(spark, sf_dir), ["location", "lead_day"])
    return df.select("location", "lead_day", "best", "model", "n", "days", *_r("mae_a", "mae_b", "diff", "pct"))


@_query("m3_leaders_by_lead", f"""WITH {tb.PAIRS}, g AS (SELECT location, lead_day, model, avg(abs_error) AS mae, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 20), mae AS (SELECT *, row_number() OVER (PARTITION BY location, lead_day ORDER BY mae, model) AS k FROM g)
SELECT a.location, a.lead_day, a.model, round(a.mae + 0.0000001, 4) AS mae, a.n, b.model AS runner_up FROM mae a LEFT JOIN mae b ON a.location = b.location AND a.lead_day = b.lead_day AND b.k = 2 WHERE a.k = 1""")
def _(spark, sf_dir):
    return verification.winners_by_lead(c.pairs(spark, sf_dir)).select("location", "lead_day", "model", *_r("mae"), "n", "runner_up")


_MEMBERS = """weeks AS (SELECT DISTINCT date_trunc('week', issued_at)::TIMESTAMP AS block FROM pairs),
coef AS (SELECT block, location, model, lead_day, part_of_day, avg(error) AS bias, avg(abs_error) AS mae FROM pairs JOIN weeks ON valid_time < block AND valid_time >= block - INTERVAL 10 DAY GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT p.*, c.bias, greatest(c.mae, 0.5) AS f, row_number() OVER (PARTITION BY p.location, p.issued_at, p.valid_time, p.lead_day ORDER BY c.mae, p.model) AS rank
  FROM pairs p JOIN coef c ON date_trunc('week', p.issued_at) = c.block AND p.location = c.location AND p.model = c.model AND p.lead_day = c.lead_day AND p.part_of_day = c.part_of_day)"""
_SCHEMES = {"equal": ("1.0", 2), "1/mae": ("1 / f", 2), "1/mae^2": ("1 / pow(f, 2)", 2), "1/mae^3": ("1 / pow(f, 3)", 2), "softmax": ("exp(-f / 0.7)", 2), "top-3": ("CASE WHEN rank <= 3 THEN 1 / f END", 2), "best-1": ("CASE WHEN rank = 1 THEN 1.0 END", 1)}


@_query("m10_all_schemes", f"""WITH {tb.PAIRS}, {_MEMBERS}, s AS ({" UNION ALL ".join(f"SELECT *, '{name}' AS scheme, {w} AS w, {least} AS least FROM m" for name, (w, least) in _SCHEMES.items())}),
x AS (SELECT location, scheme, issued_at, valid_time, lead_day, min(observed) AS observed, sum(w * (value - bias)) / sum(w) AS value FROM s WHERE w IS NOT NULL GROUP BY location, scheme, issued_at, valid_time, lead_day, least HAVING count(*) >= least)
SELECT location, scheme, count(*) AS n, round(avg(abs(value - observed)) + 0.0000001, 4) AS mae FROM x GROUP BY ALL""")
def _(spark, sf_dir):
    return blend.weighting_sweep(c.pairs(spark, sf_dir), **c.WALK).select("location", "scheme", "n", *_r("mae"))


@_query("m10_regimes")
def _(spark, sf_dir):
    return blend.regime_sweep(c.pairs(spark, sf_dir), **c.WALK)


@_query("m6_step_of_means", f"""WITH {c._DIFF}, s AS (SELECT *, d - avg(d) OVER (PARTITION BY location, month(day)) AS e FROM d)
SELECT location, round(avg(e) FILTER (day >= DATE '1998-06-01') - avg(e) FILTER (day < DATE '1998-06-01'), 2) AS step, count(*) FILTER (day < DATE '1998-06-01') AS n_before, count(*) FILTER (day >= DATE '1998-06-01') AS n_after FROM s GROUP BY 1""")
def _(spark, sf_dir):
    return resampling.step_change(tb.all_days(spark, sf_dir), tb.model_days(spark, sf_dir), "1998-06-01").select("location", "step", "n_before", "n_after")


@_query("m9_difference_of_means", f"""WITH {tb.STATION}, {c._YEARLY} SELECT location, round(avg(v) FILTER (year % 2 = 0) - avg(v) FILTER (year % 2 = 1) + 0.0000001, 4) AS difference FROM y GROUP BY 1""")
def _(spark, sf_dir):
    return resampling.permutation_test(c._half_years(spark, sf_dir).withColumn("in_a", F.col("year") % 2 == 0)).select("location", *_r("difference"))


@_query("m4_pooled_days", f"""WITH {tb.PAIRS}, {c._walk_sql()}, {c._MAE}, rw AS (SELECT p.* FROM pairs p JOIN best b ON p.location = b.location AND p.lead_day = b.lead_day AND p.model = b.best),
l AS (SELECT a.location, a.lead_day FROM bp a JOIN rw r USING (location, lead_day, issued_at, valid_time) GROUP BY ALL HAVING count(*) >= 20)
SELECT {_TEXT_DAY} FROM (SELECT a.location, a.valid_time::DATE AS day, round(sum(a.abs_error) + 0.0000001, 4) AS a, round(sum(r.abs_error) + 0.0000001, 4) AS b, count(*) AS n
FROM (SELECT bp.* FROM bp SEMI JOIN l USING (location, lead_day)) a JOIN (SELECT rw.* FROM rw SEMI JOIN l USING (location, lead_day)) r ON a.location = r.location AND a.issued_at = r.issued_at AND a.valid_time = r.valid_time GROUP BY ALL)""")
def _(spark, sf_dir):
    p = c.pairs(spark, sf_dir)
    return reports.blend_against_best_pooled(p, blend.walk_forward(p, **c.WALK)).select("location", "day", *_r("a", "b"), "n")


@_query("a36_missing_by_hour", f"""WITH {tb.FC}, g AS (SELECT DISTINCT location, valid_time, model FROM fc), e AS (SELECT l.location, l.valid_time, m.model FROM (SELECT DISTINCT location, valid_time FROM fc) l CROSS JOIN (SELECT DISTINCT model FROM fc) m)
SELECT location, valid_time, string_agg(model, ',' ORDER BY model) AS missing FROM e ANTI JOIN g USING (location, valid_time, model) GROUP BY ALL""")
def _(spark, sf_dir):
    fc = tb.forecasts(spark, sf_dir)
    names = fc.agg(F.array_sort(F.collect_set("model")).alias("models"))  # one row: the models by name
    expected = fc.select("location", "valid_time").distinct().join(names).select("location", "valid_time", F.explode("models").alias("model"))
    return series.missing_models(expected, fc, ["location", "valid_time"]).withColumn("missing", F.array_join("missing", ","))


@_query("q20_model_availability", f"""WITH {tb.FC}, e AS (SELECT location, m.model FROM (SELECT DISTINCT location FROM fc) CROSS JOIN (SELECT DISTINCT model FROM fc UNION ALL SELECT 'retired') m), g AS (SELECT location, model, count(*) AS rows FROM fc GROUP BY ALL)
SELECT location, model, coalesce(rows, 0) AS rows, rows IS NOT NULL AS available FROM e LEFT JOIN g USING (location, model)""")
def _(spark, sf_dir):
    fc = tb.forecasts(spark, sf_dir)
    names = fc.agg(F.array_union(F.collect_set("model"), F.array(F.lit("retired"))).alias("models"))  # one row
    return reports.model_availability(fc.select("location").distinct().join(names).select("location", F.explode("models").alias("model")), fc)


# ---- verification and blends ----

_EVERY = f"WITH {tb.PAIRS}, {c._walk_sql()}, every AS (SELECT location, model, lead_day, error FROM pairs UNION ALL SELECT location, 'blend', lead_day, error FROM bp)"


@_query("q1_skill_by_lead", f"{_EVERY}, sk AS (SELECT location, model, lead_day, {c._METRICS} FROM every GROUP BY ALL) SELECT location, model, lead_day, n, {_rs('mae', 'bias', 'rmse')} FROM sk WHERE n >= 20")
def _(spark, sf_dir):
    report = reports.verification_report(tb.forecasts(spark, sf_dir), tb.observations(spark, sf_dir), **c.WALK)
    return report["by_lead"].select("location", "model", "lead_day", "n", *_r("mae", "bias", "rmse"))


@_query("q1_skill_overall", f"{_EVERY}, sk AS (SELECT location, model, {c._METRICS} FROM every GROUP BY ALL) SELECT location, model, n, {_rs('mae', 'bias', 'rmse')} FROM sk WHERE n >= 20")
def _(spark, sf_dir):
    report = reports.verification_report(tb.forecasts(spark, sf_dir), tb.observations(spark, sf_dir), **c.WALK)
    return report["overall"].select("location", "model", "n", *_r("mae", "bias", "rmse"))


@_query("q1_period", f"WITH {tb.PAIRS} SELECT location, min(valid_time) AS first, max(valid_time) AS last, count(*) AS n_pairs FROM pairs GROUP BY 1")
def _(spark, sf_dir):
    return reports.verification_report(tb.forecasts(spark, sf_dir), tb.observations(spark, sf_dir), **c.WALK)["period"]


_BAND = "band AS (SELECT location, lead_day, quantile_cont(error, 0.1) AS low, quantile_cont(error, 0.9) AS high, count(*) AS n FROM bp GROUP BY ALL HAVING count(*) >= 50)"


@_query("q1_band", f"WITH {tb.PAIRS}, {c._walk_sql()}, {_BAND} SELECT location, lead_day, {_rs('low', 'high')}, n FROM band")
def _(spark, sf_dir):
    report = reports.verification_report(tb.forecasts(spark, sf_dir), tb.observations(spark, sf_dir), **c.WALK)
    return report["band"].select("location", "lead_day", *_r("low", "high"), "n")


_LEARNED = """coef AS (SELECT location, model, lead_day, part_of_day, avg(error) AS bias, avg(abs_error) AS mae FROM pairs WHERE valid_time < TIMESTAMP '{asof}' AND valid_time >= TIMESTAMP '{asof}' - INTERVAL 10 DAY GROUP BY ALL HAVING count(*) >= 3),
parted AS (SELECT *, round_even((epoch_us(valid_time) - epoch_us(issued_at)) / 8.64e10, 0)::INT AS lead_day, CASE WHEN hour(timezone('America/Vancouver', timezone('UTC', valid_time))) < 6 THEN 'Night' WHEN hour(timezone('America/Vancouver', timezone('UTC', valid_time))) < 12 THEN 'Morning'
  WHEN hour(timezone('America/Vancouver', timezone('UTC', valid_time))) < 18 THEN 'Afternoon' ELSE 'Evening' END AS part_of_day FROM picked),
lb AS (SELECT l.location, l.valid_time, l.lead_day, sum((l.value - c.bias) / pow(greatest(c.mae, 0.5), 2)) / sum(1 / pow(greatest(c.mae, 0.5), 2)) AS value, count(*) AS n_members FROM parted l JOIN coef c USING (location, model, lead_day, part_of_day) GROUP BY ALL HAVING count(*) >= 2),
band AS (SELECT location, lead_day, quantile_cont(error, 0.1) AS low, quantile_cont(error, 0.9) AS high FROM pairs GROUP BY ALL HAVING count(*) >= 50)
SELECT lb.location, valid_time, lb.lead_day, n_members, round(value + 0.0000001, 4) AS value, round(value + low + 0.0000001, 4) AS lower, round(value + high + 0.0000001, 4) AS upper FROM lb LEFT JOIN band USING (location, lead_day)"""
_SHOWN = ("location", "valid_time", "lead_day", "n_members")


@_query("q2_live_blend", f"WITH {tb.PAIRS}, picked AS (SELECT * FROM (SELECT *, max(issued_at) OVER (PARTITION BY location) AS newest FROM (SELECT * FROM fc WHERE issued_at < TIMESTAMP '2024-01-25')) WHERE issued_at = newest), {_LEARNED.format(asof='2024-01-25')}")
def _(spark, sf_dir):
    p, fc = c.pairs(spark, sf_dir), tb.forecasts(spark, sf_dir)
    df = reports.live_blend_with_band(fc.where(F.col("issued_at") < _stamp("2024-01-25")), p, blend.residual_quantiles(p), _stamp("2024-01-25"), window_days=10, min_train=3)
    return df.select(*_SHOWN, *_r("value", "lower", "upper"))


_AHEAD = """picked AS (SELECT * FROM (SELECT *, max(issued_at) OVER (PARTITION BY location, valid_time) AS newest FROM fc WHERE source = 'live' AND valid_time BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-24' AND epoch_us(valid_time) - epoch_us(issued_at) >= 24 * 3600000000) WHERE issued_at = newest)"""


@_query("q3_past_day_ahead_blend", f"WITH {tb.PAIRS}, {_AHEAD}, {_LEARNED.format(asof='2024-01-20')}")
def _(spark, sf_dir):
    p = c.pairs(spark, sf_dir)
    df = reports.past_day_ahead_blend(tb.forecasts(spark, sf_dir), p, blend.residual_quantiles(p), _stamp("2024-01-20"), _stamp("2024-01-24"), window_days=10, min_train=3)
    return df.select(*_SHOWN, *_r("value", "lower", "upper"))


_ARRAYS = """t AS (SELECT DISTINCT location, valid_time FROM picked), s AS (SELECT DISTINCT location, model FROM picked),
g AS (SELECT t.location, s.model, t.valid_time, p.value FROM t JOIN s USING (location) LEFT JOIN picked p ON p.location = t.location AND p.model = s.model AND p.valid_time = t.valid_time)
SELECT location, model, string_agg(strftime(valid_time, '%Y-%m-%dT%H:%MZ'), ',' ORDER BY valid_time) AS times, string_agg(coalesce(printf('%.2f', value), ''), ',' ORDER BY valid_time) AS "values" FROM g GROUP BY ALL"""


def _as_text(df):
    """Arrays as text; a gap in the values is empty."""
    values = F.transform("values", lambda v: F.when(v.isNull(), "").otherwise(F.format_string("%.2f", v)))
    return df.select("location", "model", F.array_join("times", ",").alias("times"), F.array_join(values, ",").alias("values"))


@_query("q6_forecast_grid", f"WITH {tb.FC}, picked AS (SELECT * FROM (SELECT *, max(issued_at) OVER (PARTITION BY location) AS newest FROM (SELECT * FROM fc WHERE issued_at < TIMESTAMP '2024-01-25')) WHERE issued_at = newest), {_ARRAYS}")
def _(spark, sf_dir):
    fc = tb.forecasts(spark, sf_dir).where(F.col("issued_at") < _stamp("2024-01-25"))
    return _as_text(reports.forecast_grid(fc, _stamp("2024-01-01"), _stamp("2024-03-01")))


@_query("q7_past_forecast_grid", f"WITH {tb.FC}, {_AHEAD}, {_ARRAYS}")
def _(spark, sf_dir):
    return _as_text(reports.past_forecast_grid(tb.forecasts(spark, sf_dir), _stamp("2024-01-20"), _stamp("2024-01-24")))


@_query("q5_freezing_level_report", f"""WITH {c._FREEZE}, sh AS (SELECT time, h0, h0 - s AS lower, h0 + s AS upper, CASE WHEN h0 < 740 THEN 'below' WHEN h0 > 1150 THEN 'above' ELSE 'interp' END AS regime FROM f WHERE coalesce(2 * s <= 500 AND h0 BETWEEN 240 AND 1850, false)),
g AS (SELECT *, coalesce(epoch_us(time) - epoch_us(lag(time) OVER (ORDER BY time)) > 3660000000, true)::INT AS new FROM sh), i AS (SELECT *, sum(new) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT time AS ts, round(quantile_cont(h0, 0.5) OVER (PARTITION BY island ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + 0.0000001, 2) AS smooth, round(lower + 0.0000001, 2) AS lower, round(upper + 0.0000001, 2) AS upper, regime FROM i""")
def _(spark, sf_dir):
    obs = tb.observations(spark, sf_dir)
    at = lambda place, less: obs.where(F.col("location") == place).withColumn("value", F.col("value") / 10 - less)
    return reports.freezing_level_report(at("bottom", 3), at("top", 5)).select("ts", *_r("smooth", "lower", "upper", digits=2), "regime")


_READINGS = """rd AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'top' ELSE 'bottom' END AS location, CASE WHEN user_id % 3 = 0 THEN 's1' ELSE 's2' END AS site_id, CASE WHEN event_type = 'view' THEN 'snow_depth' ELSE 'temperature_2m' END AS variable, ts AS time, value, event_id FROM events)"""


@_query("q8_recent_observations", f"""WITH {_READINGS}, w AS (SELECT * FROM rd WHERE time >= TIMESTAMP '2024-01-20'), k AS (SELECT location, variable, arg_max(site_id, {{t: time, s: site_id}}) AS site FROM w WHERE variable = 'snow_depth' GROUP BY ALL)
SELECT w.location, w.variable, time, value FROM w LEFT JOIN k ON w.location = k.location AND w.variable = k.variable WHERE site IS NULL OR site = site_id""")
def _(spark, sf_dir):
    df = tb.table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "top").otherwise("bottom").alias("location"), F.when(F.col("user_id") % 3 == 0, "s1").otherwise("s2").alias("site_id"),
        F.when(F.col("event_type") == "view", "snow_depth").otherwise("temperature_2m").alias("variable"), F.col("ts").cast("timestamp").alias("time"), "value",
    )
    return series.recent_observations(df, _stamp("2024-01-27"))


@_query("q9_frame_manifest", """WITH f AS (SELECT DISTINCT 'cam' || (user_id % 3)::VARCHAR AS camera, date_trunc('minute', ts) AS time FROM events), r AS (SELECT *, time >= TIMESTAMP '2024-01-20' AS recent FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY camera, time::DATE ORDER BY abs(hour(time) * 60 + minute(time) - 1200), time DESC) AS k FROM r WHERE NOT recent), a AS (SELECT camera, time FROM r WHERE recent UNION ALL SELECT camera, time FROM o WHERE k = 1)
SELECT camera, time, camera || '/' || strftime(time, '%Y/%m/%d/%H%M') || '.jpg' AS key, time = max(time) OVER (PARTITION BY camera) AS is_latest FROM a""")
def _(spark, sf_dir):
    return series.frame_manifest(tb.frames(spark, sf_dir), _stamp("2024-02-19"))


# ---- seasons ----

_SMOOTH = """sp AS (SELECT location, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM {days} GROUP BY 1), jj AS (SELECT sp.location, sp.day, v FROM sp LEFT JOIN {days} USING (location, day)),
ww AS (SELECT *, count(v) OVER x AS c, avg(v) OVER x AS m FROM jj WINDOW x AS (PARTITION BY location ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)), rm AS (SELECT location, day, m AS v FROM ww WHERE c >= 5)"""
_STATION_SMOOTH = f"{tb.STATION}, {_SMOOTH.format(days='station')}"


@_query("q10_season_lines", f"WITH {_STATION_SMOOTH} SELECT location, {c._WINTER} AS season_year, {c._POS} AS pos, round(arg_min(v, day) + 0.0000001, 4) AS v FROM rm WHERE {c._IN_WINTER} GROUP BY ALL")
def _(spark, sf_dir):
    return reports.season_chart(tb.station_days(spark, sf_dir), "winter", c.YEARS)["lines"].select("location", "season_year", "pos", *_r("v"))


@_query("q10_season_average", f"WITH {_STATION_SMOOTH}, l AS (SELECT location, {c._WINTER} AS season_year, {c._POS} AS pos, arg_min(v, day) AS v FROM rm WHERE {c._IN_WINTER} GROUP BY ALL) SELECT location, pos, round(median(v) + 0.0000001, 4) AS v, count(*) AS seasons FROM l GROUP BY ALL HAVING count(*) >= 4")
def _(spark, sf_dir):
    return reports.season_chart(tb.station_days(spark, sf_dir), "winter", c.YEARS, min_seasons=4)["average"].select("location", "pos", *_r("v"), "seasons")


@_query("q11_season_summary", f"""WITH {tb.LONG_DAYS}, station AS (SELECT * FROM longd), {c._LONG}, p AS (SELECT location, pos FROM wl WHERE season_year = 2010), sm AS (SELECT wl.location, season_year, avg(v) AS v, count(*) AS n FROM wl SEMI JOIN p USING (location, pos) GROUP BY ALL),
nd AS (SELECT location, count(*) AS need FROM p GROUP BY 1), k AS (SELECT sm.* FROM sm JOIN nd USING (location) WHERE n >= 0.8 * need), r AS (SELECT *, rank() OVER (PARTITION BY location ORDER BY v DESC)::INT AS rank, count(*) OVER (PARTITION BY location) AS out_of FROM k)
SELECT r.location, round(r.v + 0.0000001, 4) AS v, rank, out_of, round(100.0 * (count(o.v) FILTER (o.v < r.v) + 0.5 * count(o.v) FILTER (o.v = r.v)) / nullif(count(o.v), 0) + 0.0000001, 4) AS pct
FROM r LEFT JOIN (SELECT * FROM k WHERE season_year <> 2010 AND season_year BETWEEN 1996 AND 2019) o USING (location) WHERE r.season_year = 2010 GROUP BY r.location, r.v, rank, out_of""")
def _(spark, sf_dir):
    return reports.season_summary(tb.long_days(spark, sf_dir), "winter", 2010, (1996, 2019)).select("location", *_r("v"), "rank", "out_of", *_r("pct"))


@_query("q12_unusual_days", f"""WITH {tb.STATION}, {c._POOL}, dd AS (SELECT location, day, v, {tb.DOY} AS doy FROM station WHERE year(day) = 2000),
u AS (SELECT dd.location, day, 100.0 * (count(*) FILTER (p.v < dd.v) + 0.5 * count(*) FILTER (p.v = dd.v)) / count(*) AS pct FROM dd JOIN pool p USING (location, doy) GROUP BY ALL)
SELECT {_TEXT_DAY} FROM (SELECT location, day, round(pct + 0.0000001, 4) AS pct, CASE WHEN pct < 10 THEN 'much below' WHEN pct < 25 THEN 'below' WHEN pct < 75 THEN 'near normal' WHEN pct < 90 THEN 'above' ELSE 'much above' END AS label FROM u)""")
def _(spark, sf_dir):
    days = tb.station_days(spark, sf_dir)
    return reports.unusual_days(days, days.where(F.year("day") == 2000), c.YEARS).select("location", "day", *_r("pct"), "label")


_SNOW = f"""base AS (SELECT location, day, v, (year(day) + (month(day) >= 10)::INT)::INT AS season_year, month(day) >= 12 OR month(day) <= 4 AS cold FROM rm WHERE month(day) >= 10 OR month(day) <= 6),
gp AS (SELECT *, coalesce(day - lag(day) OVER o, 0) AS gap, CASE WHEN cold THEN coalesce(day - max(CASE WHEN cold THEN day END) OVER (PARTITION BY location, season_year ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS cold_gap,
  max((v < 140)::INT) OVER (PARTITION BY location, season_year ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lower_before FROM base WINDOW o AS (PARTITION BY location, season_year ORDER BY day)),
wd AS (SELECT *, max(gap) OVER (PARTITION BY location, season_year ORDER BY day ROWS UNBOUNDED PRECEDING) AS widest, first_value(day) OVER (PARTITION BY location, season_year ORDER BY v DESC, day) AS top_day FROM gp),
ms AS (SELECT location, season_year, arg_min({{d: day, w: widest, l: lower_before}}, day) FILTER (v >= 140) AS onx, arg_min({{d: day, w: widest}}, day) FILTER (day > top_day AND v < 140) AS offx, max(v) AS top, min(top_day) AS top_day,
  count(*) FILTER (cold) >= 0.8 * 151 AND max(cold_gap) <= 14 AS ok FROM wd GROUP BY ALL),
stones AS (SELECT location, season_year, CASE WHEN onx.w <= 14 AND onx.l = 1 THEN onx.d END AS onset, CASE WHEN ok THEN round(top + 0.0000001, 4) END AS peak, CASE WHEN ok THEN top_day END AS peak_day, CASE WHEN offx.w <= 14 THEN offx.d END AS meltout FROM ms)"""


def _stones(spark, sf_dir):
    return history.snow_milestones(history.running_mean(tb.station_days(spark, sf_dir)), threshold=140.0)


@_query("q14_snow_milestones", f"WITH {_STATION_SMOOTH}, {_SNOW} SELECT location, season_year, onset::VARCHAR AS onset, peak, peak_day::VARCHAR AS peak_day, meltout::VARCHAR AS meltout FROM stones")
def _(spark, sf_dir):
    return _stones(spark, sf_dir).select("location", "season_year", "onset", *_r("peak"), "peak_day", "meltout")


_SNOW_POS = "date_diff('day', DATE '2001-10-01', make_date(2001 + CASE WHEN month(d) < 10 THEN 1 ELSE 0 END, month(d), CASE WHEN month(d) = 2 AND day(d) = 29 THEN 28 ELSE day(d) END))::INT"


@_query("q14_milestone_stats", f"""WITH {_STATION_SMOOTH}, {_SNOW}, st AS (SELECT location, 'onset' AS milestone, onset AS d FROM stones UNION ALL SELECT location, 'peak_day', peak_day FROM stones UNION ALL SELECT location, 'meltout', meltout FROM stones)
SELECT location, milestone, median({_SNOW_POS}) AS median, min({_SNOW_POS}) AS min, max({_SNOW_POS}) AS max, count(*) AS n FROM st WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 4""")
def _(spark, sf_dir):
    return history.milestone_stats(_stones(spark, sf_dir))


@_query("w11_first_and_last", f"WITH {tb.STATION}, {c._LONG} SELECT location, season_year, min(pos) AS first, round(arg_min(v, pos) + 0.0000001, 4) AS first_v, max(pos) AS last, round(arg_max(v, pos) + 0.0000001, 4) AS last_v, count(*) AS n FROM wl GROUP BY ALL")
def _(spark, sf_dir):
    long = history.season_long(tb.station_days(spark, sf_dir), "winter")
    return series.first_and_last(long, ["location", "season_year"]).select("location", "season_year", "first", *_r("first_v"), "last", *_r("last_v"), "n")


@_query("o3_next_days", f"WITH {tb.STATION}, n AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY day) AS k FROM station WHERE day > DATE '1997-05-05') SELECT {_TEXT_DAY} FROM (SELECT location, day, round(v + 0.0000001, 4) AS v FROM n WHERE k <= 7)")
def _(spark, sf_dir):
    return series.next_days(tb.station_days(spark, sf_dir), F.lit("1997-05-05").cast("date")).select("location", "day", *_r("v"))


@_query("j17_keys_of_any", f"WITH {tb.STATION}, {tb.MODEL}, w AS (SELECT DISTINCT day FROM model) SELECT day::VARCHAR AS day FROM w WHERE day IN (SELECT day FROM station WHERE location = '1-URGENT') OR day IN (SELECT day FROM station WHERE location = '5-LOW')")
def _(spark, sf_dir):
    station = tb.station_days(spark, sf_dir)
    days = tb.model_days(spark, sf_dir).select("day").distinct()
    return series.keys_of_any(days, [station.where("location = '1-URGENT'"), station.where("location = '5-LOW'")], ["day"])


@_query("w19_place_today", f"SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, CASE WHEN {c._IN_WINTER} THEN {c._POS} END AS place FROM (SELECT o_orderdate, o_orderdate::DATE AS day FROM orders)")
def _(spark, sf_dir):
    d = tb.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return d.select("day", ft.place_today(F.col("day"), "winter").alias("place"))


@_query("f22_content_id", "SELECT event_id, md5('=' || user_id::VARCHAR || chr(1) || '=' || event_type || chr(1) || coalesce('=' || props, '-')) AS id FROM events")
def _(spark, sf_dir):
    return tb.table(spark, sf_dir, "events").select("event_id", scalar.content_id(F.col("user_id"), F.col("event_type"), F.col("props")).alias("id"))


# ---- station and model ----

_INTERPOLATED = f"""k AS (SELECT location, list(offset_ ORDER BY month) AS y FROM off GROUP BY 1), x AS (SELECT location, day, v, list_append(y, y[1]) AS y, CASE WHEN {tb.DOY} < 15 THEN {tb.DOY} + 365 ELSE {tb.DOY} END AS p FROM model JOIN k USING (location)),
i AS (SELECT *, len(list_filter({c._KNOTS}[1:12], lambda z: z <= p)) AS i FROM x), adj AS (SELECT location, day, v + y[i] + (y[i + 1] - y[i]) * (p - {c._KNOTS}[i]) / ({c._KNOTS}[i + 1] - {c._KNOTS}[i]) AS v FROM i)"""


@_query("m5_adjusted_coverage", f"""WITH {c._DIFF}, n AS (SELECT location, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 120), r AS (SELECT location, day, row_number() OVER (PARTITION BY location ORDER BY day) - 1 AS k FROM d),
cut AS (SELECT r.location, r.day AS cut FROM r JOIN n USING (location) WHERE k = floor(n * 0.7)), off AS (WITH early AS (SELECT d.* FROM d JOIN cut USING (location) WHERE day < cut), {c._OFF.replace(' FROM d ', ' FROM early ')} SELECT * FROM off), {_INTERPOLATED},
test AS (SELECT d.*, {tb.DOY} AS doy FROM d JOIN cut USING (location) WHERE day >= cut), yrs AS (SELECT location, min(year(day)) AS y0, max(year(day)) AS y1 FROM test GROUP BY 1),
pool AS (SELECT adj.location, ((({tb.DOY} + o - 1) % 365 + 365) % 365 + 1)::INT AS doy, v FROM adj JOIN yrs USING (location), (SELECT unnest(generate_series(-7, 7)) AS o) WHERE year(day) BETWEEN y0 AND y1),
q AS (SELECT location, doy, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM pool GROUP BY ALL)
SELECT location, round(avg((s < lo)::INT), 3) AS below, round(avg((s > hi)::INT), 3) AS above, count(*) AS n_days FROM test JOIN q USING (location, doy) GROUP BY 1""")
def _(spark, sf_dir):
    return reports.station_adjustment(tb.all_days(spark, sf_dir), tb.model_days(spark, sf_dir))["coverage_daily"]


@_query("q18_overlap", f"WITH {c._DIFF} SELECT location, count(*) AS n_overlap, count(*) < 1095 AS provisional FROM d GROUP BY 1")
def _(spark, sf_dir):
    return reports.station_adjustment(tb.all_days(spark, sf_dir), tb.model_days(spark, sf_dir))["overlap"]


@_query("q18_step", c._STEPS)
def _(spark, sf_dir):
    return reports.station_adjustment(tb.all_days(spark, sf_dir), tb.model_days(spark, sf_dir), since="1998-06-01")["step"]


_LOCAL_DAY = "timezone('America/Vancouver', timezone('UTC', valid_time))::DATE"


@_query("q19_blend_daily_means", f"""WITH {tb.PAIRS}, {c._walk_sql()}, {_BAND}, wb AS (SELECT bp.location, valid_time, value, value + low AS lower, value + high AS upper FROM bp LEFT JOIN band USING (location, lead_day))
SELECT {_TEXT_DAY} FROM (SELECT location, {_LOCAL_DAY} AS day, round(avg(value) + 0.0000001, 4) AS value, round(avg(lower) + 0.0000001, 4) AS lower, round(avg(upper) + 0.0000001, 4) AS upper FROM wb GROUP BY ALL HAVING count(value) >= 20 AND count(lower) >= 20 AND count(upper) >= 20)""")
def _(spark, sf_dir):
    blended = blend.walk_forward(c.pairs(spark, sf_dir), **c.WALK)
    return reports.blend_daily_means(blend.with_band(blended, blend.residual_quantiles(blended))).select("location", "day", *_r("value", "lower", "upper"))


def _winters(spark, sf_dir):
    years = c._half_years(spark, sf_dir).select("year").distinct()
    return years.select("year", ((F.col("year") * 37 % 29 - 14) / 8.0).alias("anom"))


@_query("q17_enso_classes", f"""WITH {tb.STATION}, {c._YEARLY}, l AS (SELECT location, regr_slope(v, year) AS s, regr_intercept(v, year) AS i FROM y GROUP BY 1), w AS (SELECT DISTINCT year, ((year * 37) % 29 - 14) / 8.0 AS anom FROM y),
j AS (SELECT location, {c._ENSO} AS ord, v - i - s * year AS v FROM y JOIN l USING (location) JOIN w USING (year))
SELECT l.location, o::INT AS ord, ({c._PHASES})[o + 1] AS phase, count(j.v) AS n, round(avg(j.v) + 0.0000001, 4) AS mean, count(*) FILTER (j.v > 0) AS above FROM (SELECT DISTINCT location FROM y) l CROSS JOIN (SELECT unnest(range(5)) AS o) LEFT JOIN j ON j.location = l.location AND j.ord = o GROUP BY ALL""")
def _(spark, sf_dir):
    classes, _ = reports.enso_card(c._half_years(spark, sf_dir), _winters(spark, sf_dir))
    return classes.select("location", "ord", "phase", "n", *_r("mean"), "above")


@_query("q17_enso_tests")
def _(spark, sf_dir):
    return reports.enso_card(c._half_years(spark, sf_dir), _winters(spark, sf_dir))[1]


def _long_view(spark, sf_dir):
    model = tb.long_days(spark, sf_dir).withColumn("v", F.col("v") - 0.002 * F.datediff("day", F.lit("1995-01-01").cast("date")))
    return reports.long_view({"rising": tb.long_days(spark, sf_dir), "falling": model}, ("winter", "year"))


_SEASONS = f"""yr AS (SELECT year(day)::INT AS year, 'year' AS kind, source, avg(v) AS v, count(*) AS n, date_diff('day', make_date(year(day)::INT, 1, 1), make_date(year(day)::INT + 1, 1, 1)) AS need FROM src GROUP BY ALL UNION ALL
SELECT {c._WINTER} AS year, 'winter', source, avg(v), count(*), date_diff('day', make_date({c._WINTER} - 1, 11, 1), make_date({c._WINTER}, 5, 1)) FROM src WHERE {c._IN_WINTER} GROUP BY ALL), y AS (SELECT year, kind, source, v FROM yr WHERE n >= 0.9 * need)"""


_LONG = f"{tb.LONG_DAYS}, src AS (SELECT day, v, 'rising' AS source FROM longd UNION ALL SELECT day, v - 0.002 * (day - DATE '1995-01-01'), 'falling' FROM longd), {_SEASONS}"


@_query("q16_long_view_slopes", f"""WITH {_LONG},
n AS (SELECT kind, source, count(*) AS n, min(year) AS start, max(year) AS "end" FROM y GROUP BY ALL HAVING count(*) >= 8)
SELECT kind, source, round(10 * median((b.v - a.v) / (b.year - a.year)), 2) AS slope, n, start, "end" FROM y a JOIN y b USING (kind, source) JOIN n USING (kind, source) WHERE a.year < b.year GROUP BY ALL""")
def _(spark, sf_dir):
    return _long_view(spark, sf_dir)[0].select("kind", "source", "slope", "n", "start", "end")


@_query("q16_long_view", f"WITH RECURSIVE {_LONG}, {draws_sql.year_rounds('kind, source')} SELECT kind, {draws_sql.STATEMENT} FROM trends GROUP BY kind")
def _(spark, sf_dir):
    return _long_view(spark, sf_dir)[1]


# ---- snow charts ----

_SNOWED = f"""{tb.LONG_DAYS}, snowed AS (SELECT location, day, arg_min(v, day) AS v, (year(day) + (month(day) >= 10)::INT)::INT AS season_year, date_diff('day', DATE '2001-10-01', make_date(2001 + CASE WHEN month(day) < 10 THEN 1 ELSE 0 END, month(day), {c._FIX}))::INT AS pos FROM longd WHERE month(day) >= 10 OR month(day) <= 6 GROUP BY ALL),
sl AS (SELECT location, season_year, pos, arg_min(v, day) AS v FROM snowed GROUP BY ALL), ps AS (SELECT sl.* FROM sl SEMI JOIN (SELECT location, season_year FROM sl GROUP BY ALL HAVING count(*) >= 0.3 * 273) USING (location, season_year) WHERE season_year <> 2016)"""


@_query("q13_snow_band", f"""WITH {_SNOWED}, x AS (SELECT location, season_year, (pos + o)::INT AS pos, v FROM ps, (SELECT unnest(generate_series(-3, 3)) AS o) WHERE pos + o BETWEEN 0 AND 272)
SELECT location, pos, {", ".join(f"round(quantile_cont(v, {q}) + 0.0000001, 4) AS q{round(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))}, count(DISTINCT season_year) AS seasons FROM x GROUP BY ALL HAVING count(DISTINCT season_year) >= 8""")
def _(spark, sf_dir):
    return reports.snow_chart(tb.long_days(spark, sf_dir), 2016)["band"].select("location", "pos", *c._quantiles(10, 25, 50, 75, 90), "seasons")


@_query("q13_snow_past", f"WITH {_SNOWED} SELECT location, season_year, count(*) AS days, round(sum(v) + 0.0000001, 2) AS total FROM ps GROUP BY ALL")
def _(spark, sf_dir):
    past = reports.snow_chart(tb.long_days(spark, sf_dir), 2016)["past"]
    return past.groupBy("location", "season_year").agg(F.count("v").alias("days"), F.sum("v").alias("total")).select("location", "season_year", "days", *_r("total", digits=2))


@_query("q13_snow_summary", f"""WITH {_SNOWED}, cur AS (SELECT location, max(pos) AS pos, arg_max(v, pos) AS depth FROM sl WHERE season_year = 2016 GROUP BY 1),
nr AS (SELECT ps.location, season_year, avg(v) AS nv FROM ps JOIN cur ON cur.location = ps.location AND abs(ps.pos - cur.pos) <= 1 GROUP BY ALL)
SELECT cur.location, cur.pos, round(depth + 0.0000001, 4) AS depth, CASE WHEN count(nv) >= 4 THEN (count(*) FILTER (nv > depth) + 1)::BIGINT END AS rank, CASE WHEN count(nv) >= 4 THEN count(nv) + 1 END AS n_seasons,
  CASE WHEN count(nv) >= 4 AND cur.pos >= 61 AND median(nv) >= 20 THEN round(100 * depth / median(nv) + 0.0000001, 2) END AS pct_of_median FROM cur LEFT JOIN nr USING (location) GROUP BY cur.location, cur.pos, depth""")
def _(spark, sf_dir):
    return reports.snow_chart(tb.long_days(spark, sf_dir), 2016)["summary"].select("location", "pos", *_r("depth"), "rank", "n_seasons", *_r("pct_of_median", digits=2))


_RATIO = f"""{tb.LONG_DAYS}, {{pool}}, md AS (SELECT location, doy, quantile_cont(v, 0.5) AS median FROM pool GROUP BY ALL),
rt AS (SELECT s.location, s.day, s.v / median * 100 AS v FROM (SELECT *, {tb.DOY} AS doy, CASE WHEN month(day) >= 10 OR month(day) <= 6 THEN date_diff('day', DATE '2001-10-01', make_date(2001 + CASE WHEN month(day) < 10 THEN 1 ELSE 0 END, month(day), {c._FIX})) END AS pos FROM longd) s JOIN md USING (location, doy) WHERE median >= 0.2 AND pos >= 61)""".format(pool=c._POOL.replace("FROM station", "FROM longd").replace(str(c.YEARS[0]), "1996").replace(str(c.YEARS[1]), "2019"))
_RATIO_POOL = c._POOL.replace("pool AS", "rp AS").replace("FROM station", "FROM rt").replace(str(c.YEARS[0]), "1996").replace(str(c.YEARS[1]), "2019")


@_query("q15_snowpack_band", f"""WITH {_RATIO}, {_RATIO_POOL} SELECT location, doy, {", ".join(f"round(quantile_cont(v, {q}) + 0.0000001, 3) AS q{round(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))}, count(*) AS n FROM rp GROUP BY ALL""")
def _(spark, sf_dir):
    band = reports.modelled_snowpack(tb.long_days(spark, sf_dir), 2016, (1996, 2019))["band"]
    return band.select("location", "doy", *[F.round(F.get("q", F.lit(i)) + c._OFF_TIES, 3).alias(f"q{p}") for i, p in enumerate((10, 25, 50, 75, 90))], "n")


@_query("q15_snowpack_summary", f"""WITH {_RATIO}, {_RATIO_POOL}, la AS (SELECT location, max(day) AS day, arg_max(v, day) AS v FROM rt WHERE year(day) + (month(day) >= 10)::INT = 2016 GROUP BY 1)
SELECT {_TEXT_DAY} FROM (SELECT la.location, day, round(la.v + 0.0000001, 3) AS pct_of_median, round(100.0 * (count(*) FILTER (rp.v < la.v) + 0.5 * count(*) FILTER (rp.v = la.v)) / count(*) + 0.0000001, 3) AS percentile
FROM (SELECT *, {tb.DOY} AS doy FROM la) la JOIN rp USING (location, doy) GROUP BY la.location, day, la.v)""")
def _(spark, sf_dir):
    return reports.modelled_snowpack(tb.long_days(spark, sf_dir), 2016, (1996, 2019))["summary"].select("location", "day", *_r("pct_of_median", "percentile", digits=3))


# ---- the rest of a station's adjustment and of the skill report ----


@_query("q18_offsets", f"WITH {c._DIFF}, {c._OFF} SELECT location, month, round(offset_ + 0.0000001, 4) AS offset, n FROM off")
def _(spark, sf_dir):
    return reports.station_adjustment(tb.all_days(spark, sf_dir), tb.model_days(spark, sf_dir))["offsets"].select("location", "month", *_r("offset"), "n")


_SMOOTH_DIFF = f"""{tb.ALL_DAYS.replace("alldays AS", "rawdays AS")}, {tb.MODEL.replace("model AS", "rawmodel AS")}, alldays AS (WITH {_SMOOTH.format(days="rawdays")} SELECT location, day, v FROM rm), model AS (WITH {_SMOOTH.format(days="rawmodel")} SELECT location, day, v FROM rm),
d AS (SELECT s.location, s.day, m.v AS m, s.v AS s, s.v - m.v AS d FROM alldays s JOIN model m USING (location, day))"""


@_query("q18_coverage_7day", c._SQL["m5_adjusted_coverage"].replace(c._DIFF, _SMOOTH_DIFF))
def _(spark, sf_dir):
    return reports.station_adjustment(tb.all_days(spark, sf_dir), tb.model_days(spark, sf_dir))["coverage_7day"]


@_query("q1_strata", c._SQL["a4_stratified_metrics"])
def _(spark, sf_dir):
    strata = reports.verification_report(tb.forecasts(spark, sf_dir), tb.observations(spark, sf_dir), strata_n=10, **c.WALK)["strata"]
    return strata.select("location", "dimension", "stratum", "model", "n", *_r("mae", "bias", "rmse"))


@_query("q1_coverage", f"""WITH {tb.PAIRS}, {c._walk_sql()}, ct AS (SELECT location, quantile_cont(epoch_us(issued_at)::DOUBLE, 0.7) AS cut FROM bp GROUP BY 1), jn AS (SELECT * FROM bp JOIN ct USING (location)),
bd AS (SELECT location, lead_day, quantile_cont(error, 0.1) AS low, quantile_cont(error, 0.9) AS high FROM jn WHERE epoch_us(issued_at) <= cut GROUP BY ALL HAVING count(*) >= 20)
SELECT location, round(avg((error BETWEEN low AND high)::INT) + 0.0000001, 4) AS coverage, count(*) AS n FROM jn JOIN bd USING (location, lead_day) WHERE epoch_us(issued_at) > cut GROUP BY 1""")
def _(spark, sf_dir):
    report = reports.verification_report(tb.forecasts(spark, sf_dir), tb.observations(spark, sf_dir), band_n=20, **c.WALK)
    return report["coverage"].select("location", *_r("coverage"), "n")


# Queries of the operators that give the same rows as a report.
for _name, _same in (("m5_band_coverage", "m5_adjusted_coverage"), ("a27_milestone_stats", "q14_milestone_stats"), ("w13_snow_milestones", "q14_snow_milestones"), ("a15_rivals_by_lead", "a15_rivals_of_the_hour"), ("m10_weighting_sweep_all", "m10_all_schemes")):
    c._SQL[_name] = c._SQL[_same]
