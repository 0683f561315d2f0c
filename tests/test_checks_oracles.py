"""Parameter validation, table checks, and every SQL-expressible registered
query against its DuckDB oracle on the smallest shipped data."""

import hashlib
import math

import duckdb
import pytest

from vigil.operators import checks
from vigil.params import AnalysisParams, EvalParams, FeatureParams

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# ---- H2

@pytest.mark.parametrize("params,match", [
    (AnalysisParams(evaluation=EvalParams(primary_top_k=7)), "primary_top_k"),
    (AnalysisParams(evaluation=EvalParams(aggregation="median")), "aggregation"),
    (AnalysisParams(features=FeatureParams(families=("self_z",))), "family_computed of z"),
    (AnalysisParams(features=FeatureParams(families=("self_z", "bogus"))), "family_known of features"),
])
def test_invalid_parameters_rejected(params, match):
    with pytest.raises(ValueError, match=match):
        checks.validate(params)


def test_window_must_lie_inside_data():
    with pytest.raises(ValueError, match="test_window_start"):
        checks.validate(AnalysisParams(), n_days=20)
    checks.validate(AnalysisParams(), n_days=30)


def test_unknown_target_group(spark):
    from vigil.operators.scenarios import scenario_table
    users = spark.createDataFrame([(1, "a")], "user_id long, group string")
    sc = scenario_table(spark, [dict(name="exfil", target_group="zzz", n_victims=1)])
    with pytest.raises(ValueError, match="no users in the group"):
        checks.check_target_groups(sc, users)


# ---- H3-H9 on the shipped data

@pytest.fixture(scope="module")
def activity(spark):
    from vigil.plans.catalog import _activity
    return _activity(spark, SF)


def test_keys_unique_and_ranges(activity):
    assert checks.key_violations(activity).count() == 0
    r = checks.range_checks(activity).collect()[0]
    assert 0 <= r["min_day"] <= r["max_day"] <= 29
    assert all(r[f"negative_{c}"] == 0 for c in ("bytes", "logins", "hosts", "fails"))


def test_profile_and_trajectory(activity):
    p = checks.profile(activity).collect()[0]
    assert p["rows"] == 15 * 30 and p["users"] == 15        # the complete grid
    t = checks.trajectory(activity, 0, 0, 29).collect()
    assert [r["day"] for r in t] == sorted(r["day"] for r in t) and len(t) > 0


# ---- registered queries vs oracle SQL

def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(_norm(r[i]) for i in order)
                                         for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _sql_names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("name", _sql_names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_every_query_has_a_callable_and_oracles_are_a_subset():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
