"""Isolation forest properties, feature-set resolution and seed summary."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import forest
from vigil.operators.evaluate import evaluate_users, user_totals
from vigil.operators.forest import (
    drawn_rows,
    fit_forests,
    max_depth_for,
    node_table,
    path_adjustment,
    run_table,
    sample_rows,
    score_runs,
    score_summary,
    scoring_table,
    top_rows_by_type,
    with_run_names,
)
from vigil.operators.sweep import config_columns, resolve_columns, run_sweep, summarize
from vigil.params import FEATURE_SETS, EvalParams, ForestParams


def _outlier_matrix(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(0.0, 1.0, size=(200, 3)), np.full((5, 3), 50.0)])
    rows = [(i, 0, i >= 200, "x" if i >= 200 else "", *map(float, X[i])) for i in range(205)]
    return spark.createDataFrame(rows, "user_id long, day int, is_anomaly boolean, "
                                       "anomaly_type string, a double, b double, c double")


CFG = {"abc": ["a", "b", "c"], "c_then_a": ["c", "a"]}
COLUMNS = ["a", "b", "c"]
FP = ForestParams(n_trees=100, max_samples=256, seeds=(0, 7))


def _scores(spark, matrix, cfg=CFG, params=FP, columns=COLUMNS):
    n = matrix.count()
    trees = fit_forests(matrix, cfg, params, n)
    runs = run_table(spark, cfg, params, columns)
    scored = score_runs(matrix, scoring_table(trees, runs, params), runs, params, columns,
                        min(params.max_samples, n), n)
    return trees, with_run_names(scored, runs), scored


def test_planted_outliers_score_highest(spark):
    _, scored, _ = _scores(spark, _outlier_matrix(spark))
    pdf = scored.where("config = 'abc' AND seed = 0").toPandas()
    top5 = set(pdf.nlargest(5, "score")["user_id"])
    assert top5 == {200, 201, 202, 203, 204}
    assert ((pdf["score"] > 0) & (pdf["score"] <= 1)).all()


def test_scores_equal_a_walk_by_hand(spark):
    """Every row led down every tree's node rows one by one."""
    matrix = _outlier_matrix(spark)
    params = ForestParams(n_trees=7, max_samples=64, seeds=(3,))
    trees, scored, _ = _scores(spark, matrix, params=params)
    nodes = {(r.config, r.tree, r.node): r for r in node_table(trees).collect()}
    rows = {r.user_id: r for r in matrix.collect()}
    for r in scored.collect():
        length = 0.0
        for t in range(7):
            n = nodes[r.config, t, 1]
            while n.feature >= 0:
                value = rows[r.user_id][CFG[r.config][n.feature]]
                n = nodes[r.config, t, n.left if value <= n.threshold else n.right]
            length += n.depth + float(path_adjustment([n.size])[0])
        assert r.score == pytest.approx(2.0 ** (-length / 7 / path_adjustment([64])[0]), abs=1e-6)


def test_model_depends_on_its_own_key_only(spark):
    """Partitions, tree blocks, other feature sets and other seeds change no tree."""
    m = _outlier_matrix(spark)
    key = lambda t: sorted(map(str, node_table(t).where("seed = 7 AND config = 'c_then_a'").collect()))
    base = key(fit_forests(m.repartition(1), CFG, FP))
    assert base == key(fit_forests(m.repartition(11, "user_id"), CFG, FP))
    assert base == key(fit_forests(m, CFG, ForestParams(n_trees=100, seeds=(7,), trees_per_block=33)))
    assert base == key(fit_forests(m, {"c_then_a": CFG["c_then_a"]}, FP))
    few = key(fit_forests(m, CFG, ForestParams(n_trees=10, seeds=(0, 7))))
    assert few == [r for r in base if int(r.split("tree=")[1].split(",")[0]) < 10]


def test_trees_use_min_psi_rows_and_bounded_depth(spark):
    nodes = node_table(fit_forests(_outlier_matrix(spark), {"abc": ["a", "b", "c"], "a_only": ["a"]}, FP)).toPandas()
    roots = nodes[nodes.node == 1]
    assert (roots["size"] == 205).all()                       # psi = min(256, N)
    assert nodes["depth"].max() <= int(np.ceil(np.log2(205)))
    assert len(roots) == 2 * 100 * 2
    a_only = nodes[(nodes.config == "a_only") & (nodes.feature >= 0)]
    assert (a_only["feature"] == 0).all()
    of = nodes.set_index(["config", "seed", "tree", "node"])["size"]
    split = nodes[nodes.feature >= 0]
    keys = list(zip(split.config, split.seed, split.tree))
    left = of.loc[[(*k, n) for k, n in zip(keys, split.left)]].to_numpy()
    right = of.loc[[(*k, n) for k, n in zip(keys, split.right)]].to_numpy()
    assert (left + right == split["size"].to_numpy()).all() and left.min() > 0 and right.min() > 0


@pytest.mark.parametrize("n_rows", [20_000, 600_000])
def test_one_sampling_law_at_every_size(spark, n_rows):
    """Rows enter trees independently at one rate; every tree keeps its psi smallest hashes."""
    big = spark.range(0, n_rows).select(F.col("id").alias("user_id"), F.lit(0).alias("day"))
    p = ForestParams(n_trees=40, max_samples=256, seeds=(3, 4))
    drawn = drawn_rows(big, n_rows, p).select("seed", "tree", "user_id").toPandas()
    per_tree = drawn.groupby(["seed", "tree"]).size()
    assert len(per_tree) == 80 and abs(per_tree.mean() - 512) < 5 * (512 / 80) ** 0.5
    assert not drawn.duplicated().any()
    # rows that enter two trees of a seed: pairs of trees x rate squared x rows
    times = drawn.groupby(["seed", "user_id"]).size()
    pairs, expected = (times * (times - 1) / 2).sum(), 2 * 780 * 512 ** 2 / n_rows
    assert abs(pairs - expected) < 6 * expected ** 0.5
    kept = sample_rows(big, n_rows, p).groupBy("seed", "tree").count().toPandas()
    assert len(kept) == 80 and (kept["count"] == 256).all()


def test_small_table_is_drawn_whole(spark):
    big = spark.range(0, 300).select(F.col("id").alias("user_id"), F.lit(0).alias("day"))
    p = ForestParams(n_trees=5, max_samples=256, seeds=(1,))
    assert drawn_rows(big, 300, p).groupBy("tree").count().where("count = 300").count() == 5


def test_short_tree_raises(spark):
    matrix = spark.range(0, 5000).select(F.col("id").alias("user_id"), F.lit(0).alias("day"), F.rand(1).alias("a"))
    p = ForestParams(n_trees=20, max_samples=256, seeds=(0,), oversample=0.9)
    with pytest.raises(Exception, match="drew fewer than 256"):
        fit_forests(matrix, {"a": ["a"]}, p, 5000).count()


def test_scoring_runs_without_python_and_once(spark):
    """One walk, one exchange of the rows, no Python; the user roll-up stays in its stage."""
    matrix = _outlier_matrix(spark)
    _, _, scored = _scores(spark, matrix, params=ForestParams(n_trees=3, seeds=(0,)))
    users = user_totals(scored, 0, "sum", ("_block", "run"), keyed=True)
    plan = users._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Generate explode") == 2
    victims = spark.createDataFrame([("x", 200)], "attack_type string, user_id long")
    params = EvalParams(test_window_start=0)
    plan = evaluate_users(users, matrix, victims, params, ("run",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2 and "Python" not in plan


def test_sweep_checks_alignment(spark, monkeypatch):
    from vigil.operators import sweep
    matrix = _outlier_matrix(spark).withColumnsRenamed({"a": "bytes", "b": "logins", "c": "hosts"}) \
        .withColumn("fails", F.lit(0.0))
    victims = spark.createDataFrame([("exfil", 200)], "attack_type string, user_id long")
    sets = {"baseline": ()}
    args = (matrix, victims, ForestParams(n_trees=5, seeds=(0, 1)), EvalParams(test_window_start=0), sets)
    assert run_sweep(*args).count() == 2
    whole = sweep.score_runs
    monkeypatch.setattr(sweep, "score_runs", lambda m, *a: whole(m.where("user_id <> 17"), *a))
    with pytest.raises(ValueError, match="204 rows scored of 205"):
        run_sweep(*args)


def test_path_adjustment_values():
    assert list(path_adjustment([0, 1, 2])) == [0.0, 0.0, 1.0]
    n = 256.0
    assert path_adjustment([n])[0] == pytest.approx(2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n)
    assert max_depth_for(256) == 8 and max_depth_for(205) == 8 and max_depth_for(1) == 1


def test_top_rows_by_type(spark):
    matrix = _outlier_matrix(spark)
    _, scored, _ = _scores(spark, matrix)
    t = top_rows_by_type(scored.where("config = 'abc'"), matrix, n=5).toPandas()
    assert set(t["anomaly_type"]) == {"x"} and (t["rows"] == 5).all()
    assert {r["rows"] for r in score_summary(scored).collect()} == {205}


# ---- feature-set resolution

def test_set_sizes():
    sizes = {k: len(resolve_columns(k)) for k in FEATURE_SETS}
    assert sizes == {"baseline": 4, "z_scores": 16, "z_plus_diff": 24, "z_plus_ramp": 19,
                     "z_plus_spearman": 18, "z_plus_ramp_plus_spearman": 21, "everything": 41}


def test_baseline_raw_only_and_bytes_only_families():
    assert resolve_columns("baseline") == ["bytes", "logins", "hosts", "fails"]
    cols = resolve_columns("z_plus_spearman")
    assert "bytes_spearman" in cols and "bytes_spearman_pos" in cols
    assert not any(c.startswith(("logins_sp", "hosts_sp", "fails_sp")) for c in cols)
    assert "bytes_ramp_signal" in resolve_columns("z_plus_ramp")
    assert "logins_ramp_signal" not in resolve_columns("z_plus_ramp")


def test_no_duplicates_and_unknown_family():
    for cols in config_columns().values():
        assert len(cols) == len(set(cols))
    with pytest.raises(ValueError, match="no such family"):
        resolve_columns("broken", {"broken": ("self_z", "not_a_family")})


# ---- seed summary

def _fake_runs(spark):
    p = EvalParams()
    rows = []
    for seed in (0, 1):
        for cfg, prec, rec, caught, nf in (("a", 0.8 + 0.1 * seed, 0.5, 0.5, 10),
                                           ("b", 0.2 + 0.1 * seed, 0.1, 0.1, 4)):
            r = {"config": cfg, "seed": seed, "n_features": nf}
            for k in p.top_k_values:
                r[f"precision_at_{k}"] = prec
                r[f"recall_at_{k}"] = rec
            for t in p.attack_types_tracked:
                r[f"caught_{t}"] = caught
            rows.append(r)
    return spark.createDataFrame(rows)


def test_summary_averages_sorts_and_orders_columns(spark):
    s = summarize(_fake_runs(spark)).collect()
    assert [r["config"] for r in s] == ["a", "b"]
    assert s[0]["precision_at_50"] == pytest.approx(0.85)
    assert s[1]["precision_at_50"] == pytest.approx(0.25)
    cols = list(s[0].asDict())
    assert cols[:4] == ["config", "n_features", "precision_at_50", "recall_at_50"]
    assert cols[4:9] == ["caught_exfil", "caught_cred_theft", "caught_lateral",
                         "caught_subtle_exfil", "caught_slow_ramp"]
    assert "seed" not in cols


def test_summary_rounds_half_even(spark):
    df = spark.createDataFrame([("a", 0, 1, 0.0625), ("a", 1, 1, 0.0625)],
                               "config string, seed int, n_features int, v double")
    p = EvalParams(top_k_values=(50,), attack_types_tracked=())
    df = df.select("config", "seed", "n_features", F.col("v").alias("precision_at_50"),
                   F.col("v").alias("recall_at_50"))
    assert summarize(df, p).collect()[0]["precision_at_50"] == 0.062


def test_walk_reads_arrays_without_nulls(spark):
    """The tables of a walk declare no null elements; a null in the matrix goes left as before."""
    params = ForestParams(n_trees=3, max_samples=64, seeds=(0,))
    matrix = _outlier_matrix(spark)
    trees = fit_forests(matrix, CFG, params, matrix.count())
    runs = run_table(spark, CFG, params, COLUMNS)
    table = scoring_table(trees, runs, params)
    assert not any(table.schema[c].dataType.containsNull for c in ("feature", "threshold", "path"))
    score = lambda m: {tuple(r) for r in score_runs(
        m, table, runs, params, COLUMNS, 64, 205).select("user_id", "day", "run", "score").collect()}
    null, low = (matrix.withColumn("a", F.lit(v).cast("double")) for v in (None, float("-inf")))
    assert score(null) == score(low) != score(matrix)


def test_scoring_makes_no_row_per_tree(spark, monkeypatch):
    """A row leaves the walk once a run with its sum, and the tasks follow the rows."""
    params = ForestParams(n_trees=3, seeds=(0,))
    monkeypatch.setattr(forest, "PART_ROWS", 10)
    _, _, scored = _scores(spark, _outlier_matrix(spark), params=params)
    assert not re.search("(?<!Object)HashAggregate", scored._jdf.queryExecution().executedPlan().toString())
    assert scored.rdd.getNumPartitions() == 21                # 205 rows


def test_repeated_keys_share_a_sum_and_odd_values_keep_their_side(spark):
    """The sum of a key is that of all its rows; infinite values are compared like others."""
    params = ForestParams(n_trees=20, max_samples=64, seeds=(0,))
    matrix = _outlier_matrix(spark)
    trees = fit_forests(matrix, CFG, params, matrix.count())
    runs = run_table(spark, CFG, params, COLUMNS)
    table = scoring_table(trees, runs, params)
    score = lambda m: {(r.user_id, r.run): r.score for r in score_runs(
        m, table, runs, params, COLUMNS, 64, 205).collect()}
    once = score(matrix)
    assert len(once) == 205 * 2 and score(matrix.unionByName(matrix.where("user_id < 9"))) == {
        k: pytest.approx(v ** 2 if k[0] < 9 else v) for k, v in once.items()}
    null_key = score(matrix.withColumn("user_id", F.expr("nullif(user_id, 3)")))
    assert null_key[None, 0] == once[3, 0]
    high, endless = (score(matrix.withColumn("b", F.lit(v))) for v in (1e300, float("inf")))
    assert high == endless != once
