"""The user-day roll-up and its complete grid."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigil.sources.activity import complete_days, event_days, user_day_from_events, user_day_grid, users_without_group

EVENTS = "ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _at(day, hour=3):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(_at(2), 1, "view", 1.5, "a"), (_at(2), 1, "error", 2.0, "a"), (_at(5), 1, "view", 1.0, None),
            (_at(9), 2, "click", 4.0, "b"), (_at(3), 9, "view", 1.0, "x"), (_at(3), 9, "view", 1.0, "y"),
            (_at(4), 8, "view", 1.0, "y"), (None, 1, "view", 1.0, "a"), (_at(30), None, "view", 1.0, "a")]
    events = spark.createDataFrame(rows, EVENTS)
    customers = spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (8, None)], "c_custkey long, c_mktsegment string")
    return events, customers


def test_every_user_has_every_day(tables):
    events, customers = tables
    assert event_days(events) == (2, 9)
    grid = user_day_grid(events, customers).where("group IS NOT NULL").collect()
    assert sorted((r.user_id, r.day) for r in grid) == [(u, d) for u in (1, 2) for d in range(2, 10)]
    full = {(r.user_id, r.day): tuple(r[3:7]) for r in grid}
    assert full[1, 2] == (3, 1, 1, 1) and full[1, 5] == (1, 1, 0, 0) and full[2, 9] == (4, 0, 1, 0)
    assert all(v == (0, 0, 0, 0) for k, v in full.items() if k not in {(1, 2), (1, 5), (2, 9)})
    assert {r.group for r in grid if r.user_id == 1} == {"A"} and not any(r.is_anomaly for r in grid)


def test_rows_there_pass_through(tables):
    events, customers = tables
    rolled = user_day_from_events(events, customers)
    grid = complete_days(rolled, 0, 40)
    assert rolled.exceptAll(grid).count() == 0
    assert grid.groupBy("user_id").count().where("count <> 41").count() == 0
    assert complete_days(rolled.limit(0), 0, 40).count() == 0
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 2 * rolled._jdf.queryExecution().executedPlan().toString().count("Join")   # none of its own


def test_empty_log(spark, tables):
    events, customers = tables
    assert event_days(events.limit(0)) is None
    assert user_day_grid(events.limit(0), customers).count() == 0


def test_users_without_group_are_counted(tables):
    row = users_without_group(*tables).first()
    assert (row.users, row.users_without_group, row.events_without_group) == (4, 2, 3)


def test_sum_no_longer_ranks_users_by_days_seen(spark):
    """Two users with the same total, one on one day and one on ten, have as many rows."""
    events = spark.createDataFrame([(_at(0), 1, "view", 10.0, "a"), *[(_at(d), 2, "view", 1.0, "a") for d in range(10)]], EVENTS)
    customers = spark.createDataFrame([(1, "A"), (2, "A")], "c_custkey long, c_mktsegment string")
    rows = user_day_grid(events, customers).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    assert {tuple(r) for r in rows.collect()} == {(1, 10, 10), (2, 10, 10)}
