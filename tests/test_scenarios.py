"""Scenario overlay: victim draws, overlay rules, labels, errors."""

import hashlib

import pandas as pd
import pytest

from helpers import activity_df
from vigil.operators import checks
from vigil.operators.scenarios import plant, scenario_table
from vigil.params import DEFAULT_SCENARIOS

START = 10
GROUPS = {"engineer": 12, "finance": 25, "sales": 12, "exec": 12}


def _activity_rows(n_days=17):
    rows, uid = [], 0
    for g, n in GROUPS.items():
        for _ in range(n):
            for d in range(n_days):
                rows.append((uid, g, d, 1000 + 10 * uid + d, 5 + d % 3, 8, d % 2, False, ""))
            uid += 1
    return rows


SCEN = tuple(dict(s, n_victims=3) for s in DEFAULT_SCENARIOS)


@pytest.fixture(scope="module")
def planted(spark):
    act = activity_df(spark, _activity_rows())
    out, victims = plant(act, scenario_table(spark, SCEN), seed=42, test_window_start=START)
    return act.toPandas(), out.toPandas(), victims.toPandas()


def test_every_attack_has_its_victims(planted):
    _, _, v = planted
    assert v.groupby("attack_type").size().to_dict() == {s["name"]: 3 for s in SCEN}


def test_victims_disjoint(planted):
    _, _, v = planted
    assert v["user_id"].is_unique


def test_victims_from_target_group(planted):
    before, _, v = planted
    grp = before.drop_duplicates("user_id").set_index("user_id")["group"]
    for s in SCEN:
        ids = v[v.attack_type == s["name"]]["user_id"]
        assert (grp.loc[ids] == s["target_group"]).all()


def test_draw_matches_sequential_md5_order(planted):
    """Brute force: attacks in order, md5('42|attack|user') ascending, excluding
    earlier picks (finance is shared by two attacks)."""
    before, _, v = planted
    users = before.drop_duplicates("user_id")[["user_id", "group"]]
    used = set()
    for s in SCEN:
        cand = users[(users.group == s["target_group"]) & ~users.user_id.isin(used)].copy()
        cand["k"] = [hashlib.md5(f"42|{s['name']}|{u}".encode()).hexdigest() for u in cand.user_id]
        pick = cand.sort_values(["k", "user_id"]).head(3)["user_id"].tolist()
        assert sorted(v[v.attack_type == s["name"]]["user_id"]) == sorted(pick)
        used.update(pick)


def test_labelled_row_count(planted):
    _, out, _ = planted
    # 3 victims x (3 + 2 + 3 + 2 + 5) days
    assert out["is_anomaly"].sum() == 3 * 15


def test_labels_only_in_test_window_and_clean_rows_empty(planted):
    _, out, _ = planted
    assert (out[out.is_anomaly]["day"] >= START).all()
    assert (out[~out.is_anomaly]["anomaly_type"] == "").all()


def test_overlay_rules(planted):
    before, out, v = planted
    b = before.set_index(["user_id", "day"])
    o = out.set_index(["user_id", "day"])
    vic = v.groupby("attack_type")["user_id"].apply(list).to_dict()
    for u in vic["exfil"]:
        for d in range(START, START + 3):
            assert o.loc[(u, d), "bytes"] == b.loc[(u, d), "bytes"] * 15
        assert o.loc[(u, START + 3), "bytes"] == b.loc[(u, START + 3), "bytes"]
    for u in vic["cred_theft"]:
        for d in (START, START + 1):
            assert o.loc[(u, d), "logins"] == b.loc[(u, d), "logins"] + 10
            assert o.loc[(u, d), "fails"] == b.loc[(u, d), "fails"] + 5
    for u in vic["lateral"]:
        for d in range(START, START + 3):
            assert o.loc[(u, d), "hosts"] == b.loc[(u, d), "hosts"] + 80
    for u in vic["subtle_exfil"]:
        for d in (START + 4, START + 5):
            assert o.loc[(u, d), "bytes"] == b.loc[(u, d), "bytes"] * 5
    for u in vic["slow_ramp"]:
        hist = b.loc[u].loc[:START - 1, "bytes"]
        base = int(hist.median())
        ramp = [o.loc[(u, START + 2 + i), "bytes"] for i in range(5)]
        assert ramp == [int(base * (1.5 + 0.5 * i)) for i in range(5)]
        assert ramp == sorted(ramp)
        assert (o.loc[(u, START + 2), "anomaly_type"]) == "slow_ramp"


def test_untouched_users_unchanged(planted):
    before, out, v = planted
    clean = ~before.user_id.isin(v.user_id)
    cols = ["user_id", "day", "bytes", "logins", "hosts", "fails"]
    a = before[clean][cols].sort_values(["user_id", "day"]).reset_index(drop=True)
    b = out[~out.user_id.isin(v.user_id)][cols].sort_values(["user_id", "day"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_label_checks_clean(spark, planted):
    _, out, v = planted
    res = checks.label_violations(spark.createDataFrame(out), spark.createDataFrame(v), START)
    assert {r["check"]: r["violations"] for r in res.collect()} == {
        "early_labels": 0, "wrong_type": 0, "unlisted_labels": 0,
        "dirty_clean_rows": 0, "shared_victims": 0}


def test_days_beyond_data_touch_nothing(spark):
    act = activity_df(spark, _activity_rows(n_days=12))      # window start 10 → days 10, 11
    out, _ = plant(act, scenario_table(spark, SCEN), seed=1, test_window_start=START)
    pdf = out.toPandas()
    assert (pdf[pdf.is_anomaly]["day"] <= 11).all()
    assert pdf["is_anomaly"].sum() == 3 * (2 + 2 + 2 + 0 + 0)


def test_too_few_users_raises(spark):
    act = activity_df(spark, _activity_rows(n_days=4))
    scen = (dict(DEFAULT_SCENARIOS[4], n_victims=13),)        # exec has 12 users
    with pytest.raises(ValueError, match="victims, its group"):
        plant(act, scenario_table(spark, scen), seed=0, test_window_start=2)


def test_unknown_attack_raises(spark):
    act = activity_df(spark, _activity_rows(n_days=4))
    scen = (dict(name="teleport", target_group="exec", n_victims=1, duration_days=1),)
    with pytest.raises(ValueError, match="no overlay rule"):
        plant(act, scenario_table(spark, scen), seed=0, test_window_start=2)


def test_victim_share_counts(spark):
    act = activity_df(spark, _activity_rows(n_days=4))
    scen = (dict(DEFAULT_SCENARIOS[0], n_victims=None, victim_share=0.25),)
    _, v = plant(act, scenario_table(spark, scen), seed=0, test_window_start=2)
    assert v.count() == 3          # floor(0.25 * 12)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_draw_with_much_exclusion_matches_brute_force(spark, monkeypatch, digits):
    """Five attacks take most of one group in turn; every prefix length draws the same users."""
    from vigil.operators import scenarios
    monkeypatch.setattr(scenarios, "PREFIX_DIGITS", digits)
    users = spark.createDataFrame([(u, "finance" if u % 3 else "sales") for u in range(120)], "user_id long, group string")
    names = ["exfil", "cred_theft", "lateral", "subtle_exfil", "slow_ramp"]
    counts = [30, 20, 15, 10, 5]
    table = scenario_table(spark, [dict(name=n, target_group="finance", n_victims=k, duration_days=1, days_offset=[0])
                                   for n, k in zip(names, counts)])
    got = scenarios.pick_victims(users, table, seed=7).collect()
    left, expected = [u for u in range(120) if u % 3], []
    for n, k in zip(names, counts):
        order = sorted(left, key=lambda u: (hashlib.md5(f"7|{n}|{u}".encode()).hexdigest(), u))
        expected += [(n, u) for u in order[:k]]
        left = order[k:]
    assert sorted((r.attack_type, r.user_id) for r in got) == sorted(expected) and not left


def test_draw_sorts_no_group(spark):
    """Only the prefix that holds the last victim is ranked."""
    from vigil.operators import scenarios
    users = spark.range(0, 20_000).selectExpr("id AS user_id", "'finance' AS group")
    table = scenario_table(spark, [dict(name="exfil", target_group="finance", n_victims=9_000, duration_days=1)])
    assert scenarios.pick_victims(users, table, seed=1).select("user_id").distinct().count() == 9_000
    cand = users.selectExpr("0 AS ordinal", "user_id", "CAST(conv(substring(md5(concat('1|exfil|', user_id)), 1, 4), 16, 10) AS INT) AS _prefix")
    (last, before), = scenarios._cutoffs(cand, {0: 9_000}).values()
    inside = cand.where(f"_prefix = {last}").count()
    assert before < 9_000 <= before + inside and inside < 20
