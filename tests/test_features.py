"""Feature families on hand-built fixtures (ramp user, edge cases)."""

import numpy as np
import pytest

from helpers import activity_df, brute_trailing_spearman, ramp_dataset
from vigil.operators.features import compute_features, family_columns
from vigil.params import FAMILY_ORDER, RAW_COLUMNS, FeatureParams

N_DAYS = 15


@pytest.fixture(scope="module")
def features_pdf(spark):
    df = activity_df(spark, ramp_dataset(N_DAYS))
    return compute_features(df).toPandas()


def test_row_count_preserved(features_pdf):
    assert len(features_pdf) == 12 * N_DAYS


def test_all_family_columns_present(features_pdf):
    for fam in FAMILY_ORDER:
        for c in family_columns(fam, RAW_COLUMNS):
            assert c in features_pdf.columns
    # 9 input + 76 derived
    assert len(features_pdf.columns) == 85


def test_ramp_user_has_positive_spearman(features_pdf):
    u = features_pdf[features_pdf.user_id == 0].sort_values("day")
    assert u[u.day >= 5]["bytes_spearman"].min() > 0.9
    assert (features_pdf["bytes_spearman_pos"] >= 0).all()


def test_ramp_user_has_positive_slope(features_pdf):
    u = features_pdf[features_pdf.user_id == 0].sort_values("day")
    late = u[u.day >= 5]
    assert (late["bytes_ramp_slope"] > 0).all()
    assert np.allclose(late["bytes_ramp_slope"], 50.0)
    assert (late["bytes_ramp_signal"] > 0).all()


def test_diff_matches_day_over_day(features_pdf):
    u = features_pdf[features_pdf.user_id == 0].sort_values("day")
    assert np.allclose(u[u.day >= 1]["bytes_diff1"], 50.0)
    assert u[u.day == 0]["bytes_diff1"].isna().all()


def test_first_day_self_stats_null(features_pdf):
    d0 = features_pdf[features_pdf.day == 0]
    assert d0["bytes_mean_self"].isna().all()
    d1 = features_pdf[features_pdf.day == 1]
    assert d1["bytes_std_self"].isna().all()      # one-row sample std


def test_self_z_matches_pandas(features_pdf):
    for uid, g in features_pdf.groupby("user_id"):
        g = g.sort_values("day")
        x = g["hosts"].astype(float)
        mean = x.expanding().mean().shift(1)
        std = x.expanding().std().shift(1)
        z = (x - mean) / (std + 1e-6)
        np.testing.assert_allclose(g["hosts_z_self"], z, rtol=1e-9, equal_nan=True)


def test_spearman_matches_brute_force(features_pdf):
    for uid, g in features_pdf.groupby("user_id"):
        g = g.sort_values("day")
        for c in RAW_COLUMNS:
            np.testing.assert_allclose(g[f"{c}_spearman"], brute_trailing_spearman(g[c].to_numpy()),
                                       atol=1e-12)


def test_robust_median_is_lower_median_of_past(features_pdf):
    for uid, g in features_pdf.groupby("user_id"):
        g = g.sort_values("day").reset_index(drop=True)
        for i in range(1, len(g)):
            past = np.sort(g["logins"].iloc[:i].to_numpy())
            assert g["logins_med_self"].iloc[i] == past[(len(past) - 1) // 2]


def test_mad_uses_each_rows_own_median(features_pdf):
    g = features_pdf[features_pdf.user_id == 3].sort_values("day").reset_index(drop=True)
    x = g["bytes"].astype(float).to_numpy()
    med = g["bytes_med_self"].to_numpy(dtype=float)
    dev = np.abs(x - med)                     # NaN on row 0
    for i in range(3, len(g)):
        past = np.sort(dev[1:i])
        expected = 1.4826 * past[(len(past) - 1) // 2]
        assert g["bytes_mad_self"].iloc[i] == pytest.approx(expected)


def test_rolling_uses_seven_rows_before(features_pdf):
    g = features_pdf[features_pdf.user_id == 0].sort_values("day").reset_index(drop=True)
    i = 10
    window = g["bytes"].iloc[i - 7:i].astype(float)
    assert g["bytes_roll7_max"].iloc[i] == window.max()
    assert g["bytes_roll7_mean"].iloc[i] == pytest.approx(window.mean())
    assert g["bytes_roll7_std"].iloc[i] == pytest.approx(window.std())


def test_peer_leave_one_out_matches_brute_force(features_pdf):
    for (grp, day), g in features_pdf.groupby(["group", "day"]):
        x = g["bytes"].astype(float).to_numpy()
        for k in range(len(x)):
            others = np.delete(x, k)
            row = g.iloc[k]
            assert row["bytes_mean_peer_loo"] == pytest.approx(others.mean())
            assert row["bytes_std_peer_loo"] == pytest.approx(others.std(ddof=1), abs=1e-9)


def test_peer_groups_of_one_and_two(spark):
    rows = [(1, "a", 0, 10, 1, 1, 0, False, ""),
            (2, "b", 0, 10, 1, 1, 0, False, ""), (3, "b", 0, 14, 1, 1, 0, False, "")]
    pdf = compute_features(activity_df(spark, rows), families=["peer_z"]).toPandas()
    one = pdf[pdf.user_id == 1].iloc[0]
    assert np.isnan(one["bytes_mean_peer_loo"]) and np.isnan(one["bytes_z_peer_loo"])
    assert one["bytes_std_peer_loo"] == 0.0
    two = pdf[pdf.user_id == 2].iloc[0]
    assert two["bytes_mean_peer_loo"] == 14.0 and two["bytes_std_peer_loo"] == 0.0
    assert two["bytes_z_peer_loo"] == pytest.approx(-4.0 / 1e-6)


def test_all_equal_history_gives_zero_spread(spark):
    rows = [(1, "a", d, 5, 2, 3, 0, False, "") for d in range(6)]
    pdf = compute_features(activity_df(spark, rows)).toPandas().sort_values("day")
    assert (pdf["bytes_std_self"].iloc[2:] == 0).all()
    assert (pdf["bytes_mad_self"].iloc[3:] == 0).all()
    assert (pdf["bytes_spearman"] == 0).all()
    late = pdf.iloc[1:]
    assert (late["bytes_ramp_slope"] == 0).all() and (late["bytes_ramp_r2"] == 1).all()
    assert (late["bytes_ramp_signal"] == 0).all()


def test_ties_and_missing_days_in_windows(spark):
    vals = [3, 3, 1, 3, 2, 2, 5, 1, 1, 4]
    days = [0, 1, 2, 4, 5, 9, 10, 11, 15, 16]      # gaps: windows count rows
    rows = [(7, "g", d, v, v, v, v, False, "") for d, v in zip(days, vals)]
    pdf = compute_features(activity_df(spark, rows), families=["spearman", "ramp"]).toPandas()
    pdf = pdf.sort_values("day")
    np.testing.assert_allclose(pdf["bytes_spearman"], brute_trailing_spearman(vals), atol=1e-12)
    # ramp regresses on the real day value over the last 7 rows
    for i in range(1, len(vals)):
        lo = max(0, i - 6)
        slope = np.polyfit(days[lo:i + 1], vals[lo:i + 1], 1)[0]
        assert pdf["bytes_ramp_slope"].iloc[i] == pytest.approx(slope, abs=1e-9)


def test_unknown_family_rejected(spark):
    df = activity_df(spark, ramp_dataset(3))
    with pytest.raises(ValueError, match="Unknown feature family"):
        compute_features(df, families=["self_z", "nope"])


def test_history_bound_option(spark):
    df = activity_df(spark, ramp_dataset(10))
    pdf = compute_features(df, FeatureParams(history_rows=3), families=["self_z"]).toPandas()
    g = pdf[pdf.user_id == 0].sort_values("day")
    # mean of the previous 3 rows only
    assert g["bytes_mean_self"].iloc[6] == pytest.approx(np.mean([850, 900, 950]))


def test_floating_measures_use_float_paths(spark):
    """Double-typed measures: published leave-one-out formula and built-in
    regression aggregates, checked against brute force."""
    from pyspark.sql import types as T
    rng = np.random.default_rng(3)
    rows = []
    for uid in range(8):
        for day in range(9):
            rows.append((uid, "g" if uid < 5 else "h", day, float(rng.normal(10, 2)),
                         float(rng.normal(5, 1)), 1.5, 0.0, False, ""))
    schema = T.StructType([
        T.StructField("user_id", T.LongType()), T.StructField("group", T.StringType()),
        T.StructField("day", T.IntegerType()), T.StructField("bytes", T.DoubleType()),
        T.StructField("logins", T.DoubleType()), T.StructField("hosts", T.DoubleType()),
        T.StructField("fails", T.DoubleType()), T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("anomaly_type", T.StringType())])
    pdf = compute_features(spark.createDataFrame(rows, schema),
                           families=["peer_z", "ramp", "spearman"]).toPandas()
    for (grp, day), g in pdf.groupby(["group", "day"]):
        x = g["bytes"].to_numpy()
        for k in range(len(x)):
            others = np.delete(x, k)
            assert g.iloc[k]["bytes_mean_peer_loo"] == pytest.approx(others.mean())
            assert g.iloc[k]["bytes_std_peer_loo"] == pytest.approx(others.std(ddof=1), abs=1e-9)
    u = pdf[pdf.user_id == 2].sort_values("day").reset_index(drop=True)
    for i in range(1, len(u)):
        lo = max(0, i - 6)
        slope = np.polyfit(u["day"][lo:i + 1], u["logins"][lo:i + 1], 1)[0]
        assert u["logins_ramp_slope"].iloc[i] == pytest.approx(slope, abs=1e-9)
    np.testing.assert_allclose(u["logins_spearman"], brute_trailing_spearman(u["logins"].to_numpy()),
                               atol=1e-12)
    assert (u["hosts_ramp_slope"].iloc[1:] == 0).all()          # constant measure
    assert (pdf["hosts_std_peer_loo"] == 0).all()


def test_tie_heavy_random_users_match_brute_force(spark):
    """Many users with small integer values (ties everywhere) and gaps."""
    rng = np.random.default_rng(11)
    rows = []
    for uid in range(60):
        days = np.sort(rng.choice(20, size=int(rng.integers(1, 16)), replace=False))
        for d in days:
            v = [int(rng.integers(0, 4)) for _ in range(4)]
            rows.append((uid, f"g{uid % 4}", int(d), *v, False, ""))
    pdf = compute_features(activity_df(spark, rows),
                           families=["robust_z", "peer_z", "spearman", "ramp"]).toPandas()
    for uid, g in pdf.groupby("user_id"):
        g = g.sort_values("day").reset_index(drop=True)
        x = g["fails"].to_numpy()
        np.testing.assert_allclose(g["fails_spearman"], brute_trailing_spearman(x), atol=1e-12)
        for i in range(1, len(g)):
            past = np.sort(x[:i])
            assert g["fails_med_self"].iloc[i] == past[(len(past) - 1) // 2]
            lo = max(0, i - 6)
            if np.ptp(g["day"].iloc[lo:i + 1]) > 0:
                slope = np.polyfit(g["day"].iloc[lo:i + 1], x[lo:i + 1], 1)[0]
                assert g["fails_ramp_slope"].iloc[i] == pytest.approx(slope, abs=1e-9)
    for (grp, day), g in pdf.groupby(["group", "day"]):
        x = g["hosts"].astype(float).to_numpy()
        for k in range(len(x)):
            others = np.delete(x, k)
            if len(others) >= 2:
                assert g.iloc[k]["hosts_std_peer_loo"] == pytest.approx(others.std(ddof=1), abs=1e-12)


def test_spearman_with_nulls_and_ties(spark):
    """A null inside the window gives 0.0, and no value leaves [-1, 1]."""
    rng = np.random.default_rng(21)
    rows = [(uid, "g", d, None if rng.random() < 0.15 else int(rng.integers(0, 5)), 1, 1, 1, False, "")
            for uid in range(20) for d in range(14)]
    rows += [(99, "g", d, v, 1, 1, 1, False, "") for d, v in enumerate([1, None, 2, 3])]
    pdf = compute_features(activity_df(spark, rows), families=["spearman"]).toPandas()
    assert pdf["bytes_spearman"].abs().max() <= 1
    for uid, g in pdf.groupby("user_id"):
        v = [None if x is None or x != x else x for x in g.sort_values("day")["bytes"].tolist()]
        np.testing.assert_allclose(g.sort_values("day")["bytes_spearman"], brute_trailing_spearman(v), atol=1e-12)
    assert (pdf[pdf.user_id == 99]["bytes_spearman"] == 0).all()


def test_past_medians_against_sorting():
    """Ties, nulls, days out of order, an empty history and one value."""
    import pyarrow as pa

    from vigil.functions.orderstats import past_median_and_mad, prefix_medians
    rng = np.random.default_rng(5)
    days, values = [[], [3]], [[], [7]]
    for _ in range(200):
        n = int(rng.integers(1, 25))
        days.append(rng.permutation(n).tolist())
        values.append([None if rng.random() < 0.2 else int(rng.integers(0, 6)) for _ in range(n)])
    got = past_median_and_mad(pa.array(days, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64())))

    def lower(past):
        return sorted(past)[(len(past) - 1) // 2] if past else None

    for d, v, r in zip(days, values, got.to_pylist()):
        past, devs, med, mad = [], [], {}, {}
        for i in np.argsort(d, kind="stable"):
            med[i], mad[i] = lower(past), lower(devs)
            if v[i] is not None:
                if past:
                    devs.append(abs(v[i] - med[i]))
                past.append(v[i])
        assert r["med"] == [med[i] for i in range(len(d))]
        assert r["mad"] == [mad[i] for i in range(len(d))]
    assert prefix_medians(np.array([np.nan, 1.0, 2.0])).tolist() == [-1, 0, 1, 2]


def test_long_history_in_near_linear_time(spark):
    """10,000 days of one user: exact medians, and four times the days well under 16 times the work."""
    import time

    from vigil.functions.orderstats import prefix_medians
    rng = np.random.default_rng(6)
    x = rng.integers(0, 10**6, 10_000)
    rows = [(1, "g", d, int(v), 1, 1, 0, False, "") for d, v in enumerate(x)]
    pdf = compute_features(activity_df(spark, rows), families=["robust_z"]).toPandas().sort_values("day")
    for i in (1, 2, 777, 5000, 9999):
        assert pdf["bytes_med_self"].iloc[i] == np.sort(x[:i])[(i - 1) // 2]

    def seconds(n):
        v = rng.normal(size=n)
        best = []
        for _ in range(3):
            start = time.perf_counter()
            prefix_medians(v)
            best.append(time.perf_counter() - start)
        return min(best)
    assert seconds(80_000) < 10 * seconds(20_000)


def test_bounded_look_back_keeps_the_window_form(spark):
    df = activity_df(spark, ramp_dataset(10))
    bounded = compute_features(df, FeatureParams(history_rows=50), families=["robust_z"]).toPandas()
    whole = compute_features(df, families=["robust_z"]).toPandas()
    key = ["user_id", "day"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (bounded, whole))
    np.testing.assert_array_equal(a["bytes_med_self"].to_numpy(float), b["bytes_med_self"].to_numpy(float))
    np.testing.assert_allclose(a["bytes_rz_self"], b["bytes_rz_self"], equal_nan=True)
