"""The seeded draws of the resampling operators as tables in SQL: numpy's default generator (PCG64, XSL-RR output, 32-bit halves)."""

from __future__ import annotations

import numpy as np

_MASK = "18446744073709551615::UHUGEINT"
_FULL = 1 << 128


def _halves(x: int) -> str:
    return f"{x >> 64}::UHUGEINT, {x & (1 << 64) - 1}::UHUGEINT"


def words(need: str, seed: int = 0, levels: int = 32) -> str:
    """CTEs up to `words(place, w)`: the generator's 32-bit words, at least as many as the SQL expression `need` says.

    States are doubled: those of the first 2^j places give those of the next 2^j by one jump of 2^j. To be used
    after WITH RECURSIVE.
    """
    fixed = np.random.PCG64(seed).state["state"]
    start, step = fixed["state"], fixed["inc"]
    jump = (0x2360ED051FC65DA44385DF649FCCF645, step)  # the generator's multiplier, a fixed value
    first, jumps = (start * jump[0] + jump[1]) % _FULL, []
    for j in range(levels):
        jumps.append(f"({j}, {_halves(jump[0])}, {_halves(jump[1])})")
        jump = jump[0] * jump[0] % _FULL, (jump[0] * jump[1] + jump[1]) % _FULL
    low = f"((al * lo) & {_MASK}) + cl"
    high = f"((al * lo) >> 64::UHUGEINT) + ((ah * lo) & {_MASK}) + ((al * hi) & {_MASK}) + ch"
    return f"""jump(j, ah, al, ch, cl) AS (VALUES {", ".join(jumps)}),
state(level, k, hi, lo) AS (SELECT 0, 0::BIGINT, {_halves(first)} UNION ALL
  SELECT level + 1, CASE WHEN d = 0 THEN k ELSE k + (1::BIGINT << level) END, CASE WHEN d = 0 THEN hi ELSE ({high} + (({low}) >> 64::UHUGEINT)) & {_MASK} END, CASE WHEN d = 0 THEN lo ELSE ({low}) & {_MASK} END
  FROM state JOIN jump ON j = level, (VALUES (0), (1)) AS half(d) WHERE (2::BIGINT << level) < {need} + 1000),
longs AS (SELECT k, ((xor(hi, lo) >> (hi >> 58::UHUGEINT)) | (xor(hi, lo) << (64::UHUGEINT - (hi >> 58::UHUGEINT)))) & {_MASK} AS x FROM state WHERE level = (SELECT max(level) FROM state)),
words AS (SELECT 2 * k + h AS place, CASE WHEN h = 0 THEN x & 4294967295::UHUGEINT ELSE x >> 32::UHUGEINT END::UBIGINT AS w FROM longs, (VALUES (0), (1)) AS half(h))"""


def picks(name: str, wanted: str, after: str = "0") -> str:
    """CTE `name`(key, d, pick, place): draw number d below each key's bound, of `wanted`(key, below, draws), from the word at `after` on."""
    return f"""{name} AS (SELECT * FROM (SELECT key, draws, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS d, ((w * below::UBIGINT) >> 32::UBIGINT)::BIGINT AS pick, place
  FROM words JOIN {wanted} ON place >= {after} AND place < {after} + draws + 1000 WHERE ((w * below::UBIGINT) & 4294967295::UBIGINT) >= (4294967296 - below) % below) WHERE d < draws)"""


def paired_rounds(rounds: int = 400) -> str:
    """CTE `compared` of verification.compare_models by location and lead day; from `pairs`, `mae` and `best`."""
    keys = "location, lead_day, best, model"
    return f"""ok AS (SELECT p.*, b.best FROM pairs p JOIN mae USING (location, lead_day, model) JOIN best b USING (location, lead_day)),
daily AS (SELECT a.location, a.lead_day, a.best, a.model, a.valid_time::DATE AS day, sum(a.abs_error) AS a, sum(b.abs_error) AS b, count(*) AS n
  FROM ok a JOIN ok b ON a.location = b.location AND a.lead_day = b.lead_day AND a.issued_at = b.issued_at AND a.valid_time = b.valid_time AND a.model <> a.best AND b.model = b.best GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY day) - 1 AS i FROM daily),
every AS (SELECT {keys}, count(*) AS days, sum(a) AS a, sum(b) AS b, sum(n) AS n FROM daily GROUP BY ALL),
wanted AS (SELECT DISTINCT days AS key, days AS below, {rounds} * days AS draws FROM every),
{words("(SELECT max(draws) FROM wanted)")}, {picks("p", "wanted")},
totals AS (SELECT e.location, e.lead_day, e.best, e.model, p.d // e.days AS round, sum(num.a) AS a, sum(num.b) AS b, sum(num.n) AS n
  FROM every e JOIN p ON p.key = e.days JOIN num ON num.location = e.location AND num.lead_day = e.lead_day AND num.best = e.best AND num.model = e.model AND num.i = p.pick GROUP BY ALL),
spread AS (SELECT {keys}, stddev_samp((a - b) / n) AS diff_se, stddev_samp((1 - a / b) * 100) AS pct_se FROM totals GROUP BY ALL),
compared AS (SELECT {keys}, n::BIGINT AS n, days, a / n AS mae_a, b / n AS mae_b, (a - b) / n AS diff, diff_se, (1 - a / b) * 100 AS pct, pct_se FROM every JOIN spread USING ({keys}))"""


def month_rounds(cut: str, rounds: int = 2000, least: int = 90) -> str:
    """CTE `steps` of resampling.step_change by location; from `s`(location, day, e)."""
    mean = lambda side: f"SELECT key, d // m{side} AS round, sum(num.s) / sum(num.n) AS mean FROM p{side} JOIN sides ON key = location JOIN num ON num.location = key AND num.late = {side} AND num.i = pick GROUP BY ALL"
    return f"""months AS (SELECT location, (day >= DATE '{cut}')::INT AS late, date_trunc('month', day) AS month, sum(e) AS s, count(*) AS n FROM s GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY location, late ORDER BY month) - 1 AS i FROM months),
sides AS (SELECT location, sum(late)::BIGINT AS m1, sum(1 - late)::BIGINT AS m0, sum(n) FILTER (late = 1)::BIGINT AS n_after, sum(n) FILTER (late = 0)::BIGINT AS n_before,
  sum(s) FILTER (late = 1) / sum(n) FILTER (late = 1) - sum(s) FILTER (late = 0) / sum(n) FILTER (late = 0) AS step FROM months GROUP BY 1),
wanted1 AS (SELECT location AS key, m1 AS below, {rounds} * m1 AS draws FROM sides WHERE n_before >= {least} AND n_after >= {least}),
{words(f"(SELECT {rounds} * max(m0 + m1) FROM sides)")}, {picks("p1", "wanted1")},
wanted0 AS (SELECT location AS key, m0 AS below, {rounds} * m0 AS draws, CASE WHEN m1 = 1 THEN 0 ELSE last + 1 END AS start FROM sides JOIN (SELECT key AS location, max(place) AS last FROM p1 GROUP BY 1) USING (location)),
{picks("p0", "wanted0", "start")}, r1 AS ({mean(1)}), r0 AS ({mean(0)}),
steps AS (SELECT location, round(step, 2) AS step, round(lo, 2) AS lo, round(hi, 2) AS hi, n_before, n_after
  FROM sides JOIN (SELECT key AS location, quantile_cont(r1.mean - r0.mean, 0.05) AS lo, quantile_cont(r1.mean - r0.mean, 0.95) AS hi FROM r1 JOIN r0 USING (key, round) GROUP BY 1) USING (location))"""


def year_rounds(by: str, rounds: int = 2000, block: int = 3) -> str:
    """CTE `trends` of resampling.sen_slope_range by the given columns; from `y`(by, year, v)."""
    return f"""size AS (SELECT {by}, count(*) AS n, min(year)::INT AS start, max(year)::INT AS "end" FROM y GROUP BY ALL HAVING count(*) >= 8),
num AS (SELECT {by}, year, v, row_number() OVER (PARTITION BY {by} ORDER BY year, v) - 1 AS i FROM y SEMI JOIN size USING ({by})),
wanted AS (SELECT DISTINCT n AS key, n - {block} + 1 AS below, {rounds} * ceil(n / {block})::BIGINT AS draws FROM size),
{words("(SELECT max(draws) FROM wanted)")}, {picks("p", "wanted")},
blocks AS (SELECT {by}, n, d // ceil(n / {block})::BIGINT AS round, d % ceil(n / {block})::BIGINT * {block} + o AS pos, pick + o AS i FROM size JOIN p ON key = n, (SELECT unnest(range({block})) AS o)),
drawn AS (SELECT {by}, round, pos, year, v FROM blocks JOIN num USING ({by}, i) WHERE pos < n),
medians AS (SELECT {by}, round, median((b.v - a.v) / (b.year - a.year)) AS s FROM drawn a JOIN drawn b USING ({by}, round) WHERE a.pos < b.pos AND a.year <> b.year GROUP BY ALL),
central AS (SELECT {by}, median((b.v - a.v) / (b.year - a.year)) AS s FROM num a JOIN num b USING ({by}) WHERE a.i < b.i AND a.year <> b.year GROUP BY ALL),
bounds AS (SELECT {by}, quantile_cont(s, 0.05) AS lo, quantile_cont(s, 0.95) AS hi FROM medians GROUP BY ALL),
trends AS (SELECT {by}, round(10 * s, 2) AS slope, round(10 * lo, 2) AS lo, round(10 * hi, 2) AS hi, n, start, "end" FROM size JOIN central USING ({by}) JOIN bounds USING ({by}))"""


STATEMENT = """CASE WHEN count(slope) = 0 THEN 'unknown' WHEN bool_and(lo > 0) THEN 'warming' WHEN bool_and(hi < 0) THEN 'cooling' ELSE 'no clear trend' END AS verdict,
  min(slope) AS min_slope, max(slope) AS max_slope, count(slope) AS n_sources"""
