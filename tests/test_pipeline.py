"""End-to-end run on the smallest shipped data, with outputs and the cache."""

import os
import tempfile

import pytest

from vigil.params import AnalysisParams, ForestParams
from vigil.plans import pipeline
from vigil.sources import tables

SF = "/root/testdata/sf0.001"
PARAMS = AnalysisParams(forest=ForestParams(n_trees=20, seeds=(0, 1)))


@pytest.fixture(scope="module")
def run(spark):
    out = tempfile.mkdtemp(prefix="vigil-run-")
    return out, pipeline.run(spark, SF, PARAMS, out_dir=out)


def test_summary_one_row_per_set_best_first(run):
    _, res = run
    rows = res.summary.collect()
    assert [r["config"] for r in rows][0] is not None and len(rows) == 7
    p = [r["precision_at_50"] for r in rows]
    assert p == sorted(p, reverse=True)
    assert list(rows[0].asDict())[:2] == ["config", "n_features"]


def test_runs_keyed_by_set_and_seed(run):
    _, res = run
    assert res.runs.select("config", "seed").distinct().count() == 7 * 2


def test_outputs_written(spark, run):
    out, res = run
    assert tables.read_features(spark, f"{out}/features").count() == 15 * 30
    assert tables.read_victims(spark, f"{out}/victims").count() == res.victims.count() > 0
    csv = spark.read.option("header", True).csv(f"{out}/summary")
    assert csv.count() == 7 and csv.columns[0] == "config"
    log = tables.read_run_log(spark, f"{out}/run_log")
    assert log.count() == 14 and log.select("run_id").distinct().count() == 1
    r = log.first()
    assert r["tags"]["input"] == SF
    assert r["algorithm"] == "isolation_forest" and "precision_at_50" in r["metrics"]


def test_cached_features_reused(spark, run):
    out, res = run
    again = pipeline.run(spark, SF, PARAMS, out_dir=out, skip_features=True)
    a = sorted(tuple(r) for r in res.summary.collect())
    b = sorted(tuple(r) for r in again.summary.collect())
    assert a == b


def test_repeated_run_is_logged_once(spark, run):
    out, res = run
    log = tables.read_run_log(spark, f"{out}/run_log")
    run_id = log.first()["run_id"]
    tables.write_run_log(log, f"{out}/again", run_id)
    tables.write_run_log(log, f"{out}/again", run_id)
    assert sorted(map(str, tables.read_run_log(spark, f"{out}/again").collect())) == sorted(map(str, log.collect()))
    tables.write_run_log(log, f"{out}/again", "other")
    assert tables.read_run_log(spark, f"{out}/again").count() == 28
    os.remove(f"{out}/again/run_id=other/_SUCCESS")          # a write that did not come to its end
    assert tables.read_run_log(spark, f"{out}/again").count() == 14
    assert tables.read_run_log(spark, f"{out}/none").count() == 0


def test_stamp_tells_parameters_and_inputs(spark, tmp_path):
    src, path = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(5).withColumnRenamed("id", "user_id").selectExpr("user_id", "1 AS day").write.parquet(src)
    read = lambda: spark.read.parquet(src)
    made = []

    def compute():
        made.append(1)
        return read()

    for params, calls in (({"seed": 1}, 1), ({"seed": 1}, 1), ({"seed": 2}, 2), ({"seed": 2}, 2)):
        got = tables.features_or_compute(spark, path, tables.fingerprint(params, [read()]), compute)
        assert got.count() == 5 and len(made) == calls
    spark.range(7).withColumnRenamed("id", "user_id").selectExpr("user_id", "1 AS day").write.mode("overwrite").parquet(src)
    assert tables.features_or_compute(spark, path, tables.fingerprint({"seed": 2}, [read()]), compute).count() == 7
    mark = tables.fingerprint({"seed": 2}, [read()])
    assert tables.has_cached(spark, path, mark)
    tables.stamp(spark, path, None)
    assert not tables.has_cached(spark, path, mark)


def test_feature_store_prunes_and_replaces_days(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = spark.range(40).selectExpr("id AS user_id", "CAST(id % 4 AS INT) AS day", "id * 1.0D AS a", "id * 2.0D AS b")
    tables.write_features(rows, path)
    late = tables.read_features(spark, path, ["user_id", "day", "a"], from_day=2)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "ReadSchema: struct<user_id:bigint,a:double>" in plan
    assert late.count() == 20
    tables.write_features(rows.withColumn("a", rows.a + 100), path, days=(3, 3))
    assert tables.read_features(spark, path).where("a >= 100").select("day").distinct().collect() == [(3,)]
    assert tables.read_features(spark, path).count() == 40


def test_changed_scenarios_are_recomputed(spark, run):
    out, _ = run
    before = tables.read_victims(spark, f"{out}/victims").collect()
    other = AnalysisParams(forest=ForestParams(n_trees=5, seeds=(0,)), scenario_seed=43)
    pipeline.run(spark, SF, other, out_dir=out, skip_features=True)
    assert sorted(before) != sorted(tables.read_victims(spark, f"{out}/victims").collect())


def test_unknown_target_group_rejected(spark):
    bad = AnalysisParams(scenarios=(dict(name="exfil", target_group="NOPE", n_victims=1,
                                         duration_days=1),))
    with pytest.raises(ValueError, match="no users in the group"):
        pipeline.run(spark, SF, bad)


def test_window_outside_data_rejected(spark):
    from vigil.params import EvalParams
    bad = AnalysisParams(evaluation=EvalParams(test_window_start=40))
    with pytest.raises(ValueError, match="test_window_start"):
        pipeline.run(spark, SF, bad)
