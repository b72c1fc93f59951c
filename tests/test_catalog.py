"""Every query with SQL gives the rows that DuckDB gives."""

import inspect

import duckdb
import pandas as pd
import pytest

from nimbora.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "None"
        v = v.tolist() if hasattr(v, "tolist") else v
        return repr(float(v) if isinstance(v, int) and not isinstance(v, bool) else v)

    df = df[sorted(df.columns)].astype(object)
    for c in df.columns:
        df[c] = [one(v) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    got = shown(catalog.queries()[name](spark, SF).toPandas())
    want = shown(duck.sql(catalog.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    catalog.queries()[name](spark, SF).collect()


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, SF).count() > 0


def test_forecast_json_of_every_click_is_parsed(spark, duck):
    """Three times and two models of each click event, whatever its id."""
    clicks = duck.sql("SELECT count(*) AS n, max(event_id) AS last FROM events WHERE event_type = 'click'").df().iloc[0]
    got = catalog.queries()["s12_parse_forecast_json_all"](spark, SF)
    assert clicks["last"] >= 500 and got.count() == 6 * clicks["n"]


def test_resampling_runs_the_whole_number_of_rounds(spark, monkeypatch):
    """The registered queries leave the numbers of rounds at the operators' defaults, which are the reference's."""
    asked = []
    for name in ("sen_slope_range", "permutation_test"):
        f = getattr(catalog.resampling, name)
        monkeypatch.setattr(catalog.resampling, name, lambda df, f=f, **options: asked.append(inspect.signature(f).bind(df, **options)) or f(df, **options))
    for name in ("m7_sen_slope_range", "f19_trend_statement", "m9_permutation_test"):
        catalog.queries()[name](spark, SF)
    for bound in asked:
        bound.apply_defaults()
    assert [x.arguments.get("n_boot", x.arguments.get("n_perm")) for x in asked] == [2000, 2000, 5000]
