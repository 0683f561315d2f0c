"""Registered queries for feature tables, parameters and stored tables.

The round trips write what Spark derives from the shipped tables to the shared
scratch folder, read it back through the library's readers and return what was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import checks
from vigil.operators.evaluate import evaluate, metric_columns
from vigil.operators.features import compute_features, family_columns
from vigil.operators.forest import prepare_matrix
from vigil.operators.scenarios import scenario_table
from vigil.operators.sweep import config_columns, feature_set_rows, union_columns
from vigil.params import DEFAULT_SCENARIOS, EVENTS_SCENARIOS, FAMILY_ORDER, AnalysisParams, EvalParams
from vigil.plans.catalog import (
    ORACLES,
    RAW,
    START,
    _activity,
    _attacked,
    _r,
    _rnd,
    _scored_by_self_z,
    _sql_family_of,
    _sql_metrics_cte,
    _sql_rnd,
    _sql_scenarios,
    _sql_scored,
    _sql_user_day,
    q_seed_average,
)
from vigil.plans.forest_oracles import MODEL, sql_features, sql_matrix
from vigil.session import materialize, scratch_path
from vigil.sources import tables
from vigil.sources.activity import read_activity, read_table, user_groups

ALL_COLUMNS = [c for f in FAMILY_ORDER for c in family_columns(f, RAW)]
TRAJECTORY = (START - 3, START + 6)


def q_features_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every family of every measure on the attacked table."""
    out, _ = _attacked(spark, sf)
    return compute_features(out).select("user_id", "day", *[_r(c) for c in ALL_COLUMNS])


def q_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned matrix of all feature sets."""
    out, _ = _attacked(spark, sf)
    cols = union_columns(config_columns())
    return prepare_matrix(compute_features(out), cols, 6, keep=("user_id", "day")) \
        .select("user_id", "day", *[_r(c) for c in cols])


def q_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Every set's columns in order, with their missing values in the attacked table."""
    out, _ = _attacked(spark, sf)
    cols = union_columns(config_columns())
    missing = compute_features(out).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]) \
        .unpivot([], cols, "column", "missing")
    sets = spark.createDataFrame(feature_set_rows(), "config string, ordinal int, family string, column string")
    return sets.join(F.broadcast(missing), "column").select("config", "ordinal", "family", "column", "missing")


def q_target_shortfalls(spark: SparkSession, sf: str) -> DataFrame:
    """Victims asked for and missing, of the events scenarios and the published ones."""
    users = user_groups(_activity(spark, sf))
    return checks.target_shortfalls(scenario_table(spark, [*EVENTS_SCENARIOS, *DEFAULT_SCENARIOS]), users)


def q_parameter_violations(spark: SparkSession, sf: str) -> DataFrame:
    """H2: broken rules of two parameter sets against the days and groups of the data: the
    published scenarios with a window past the last day, and the shipped ones."""
    activity = _activity(spark, sf)
    days = activity.agg(F.max("day")).first()[0] + 1
    users = materialize(user_groups(activity))
    wrong = AnalysisParams(evaluation=EvalParams(test_window_start=days + 1, primary_top_k=7), scenarios=DEFAULT_SCENARIOS)
    found = None
    for name, params in (("published", wrong), ("events", AnalysisParams())):
        rules = checks.parameter_violations(spark, params, days)
        groups = checks.unknown_target_groups(scenario_table(spark, params.scenarios), users) \
            .select(F.lit("target_group").alias("rule"), F.col("name").alias("subject"), F.col("target_group").alias("value"))
        rows = rules.unionByName(groups).select(F.lit(name).alias("parameters"), "rule", "subject", "value")
        found = rows if found is None else found.unionByName(rows)
    return found


def q_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """H9: every victim's days around the start of the test window."""
    out, victims = _attacked(spark, sf)
    return checks.trajectories(out, victims, *TRAJECTORY)


def q_activity_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A1: the activity table as it is read back with its declared schema."""
    path = scratch_path(spark, "activity")
    _activity(spark, sf).write.parquet(path)
    return read_activity(spark, path)


def q_feature_store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A4/A5: stored features of the test window, two columns, through the stamped cache;
    the second call reads what the first has written."""
    path = scratch_path(spark, "features")
    mark = tables.fingerprint({"families": ["self_z", "diff"]}, [read_table(spark, sf, "events"), read_table(spark, sf, "customer")])

    def compute() -> DataFrame:
        return compute_features(_attacked(spark, sf)[0], families=["self_z", "diff"])

    for _ in range(2):
        tables.features_or_compute(spark, path, mark, compute)
    stored = tables.read_features(spark, path, ["user_id", "day", "bytes_z_self", "logins_diff1"], START)
    return stored.select("user_id", "day", _r("bytes_z_self"), _r("logins_diff1"))


def q_victims_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The victim ledger as it is read back."""
    path = scratch_path(spark, "victims")
    tables.write_victims(_attacked(spark, sf)[1], path)
    return tables.read_victims(spark, path)


def q_summary_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of the transparent scorer as its CSV holds it."""
    path = scratch_path(spark, "summary")
    tables.write_summary_csv(q_seed_average(spark, sf), path)
    read = spark.read.option("header", True).csv(path)
    return read.select("config", *[F.col(c).cast("double").alias(c) for c in read.columns if c != "config"])


def q_run_log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of a run that was logged twice, as the log gives them back."""
    path = scratch_path(spark, "run-log")
    scored, victims, labelled = _scored_by_self_z(spark, sf)
    params = EvalParams()
    wide = evaluate(scored, victims, params, labelled=labelled).select(
        F.lit("self_z").alias("config"), F.lit(0).alias("seed"), F.lit(1).alias("n_features"), "*")
    log = materialize(tables.run_log(wide, metric_columns(params), run_id="r1", algorithm="abs_z", n_estimators=0,
                                     max_samples=0, aggregation=params.aggregation, tags={}))
    for _ in range(2):
        tables.write_run_log(log, path, "r1")
    return tables.read_run_log(spark, path).select("run_id", "config", "seed", F.explode("metrics").alias("metric", "value")) \
        .withColumn("value", _rnd(F.col("value")))


STORE_QUERIES = {
    "features_all": q_features_all,
    "feature_matrix": q_feature_matrix,
    "feature_sets": q_feature_sets,
    "target_shortfalls": q_target_shortfalls,
    "parameter_violations": q_parameter_violations,
    "trajectories": q_trajectories,
    "activity_round_trip": q_activity_round_trip,
    "feature_store_round_trip": q_feature_store_round_trip,
    "victims_round_trip": q_victims_round_trip,
    "summary_round_trip": q_summary_round_trip,
    "run_log_round_trip": q_run_log_round_trip,
}


# ============================================================ SQL oracles

def _sql_features_all() -> str:
    return (f"WITH {sql_features(MODEL)}\nSELECT user_id, day, "
            + ", ".join(f"{_sql_rnd(f'CAST({c} AS DOUBLE)')} AS {c}" for c in ALL_COLUMNS) + " FROM feat")


def _sql_feature_matrix() -> str:
    cols = union_columns(config_columns())
    return (f"WITH {sql_features(MODEL)},\n{sql_matrix(MODEL)}\nSELECT user_id, day, "
            + ", ".join(f"{_sql_rnd(f'x[{i + 1}]')} AS {c}" for i, c in enumerate(cols)) + " FROM mx")


def _sql_feature_sets() -> str:
    rows = ", ".join(f"('{c}', {o}, '{f}', '{x}')" for c, o, f, x in feature_set_rows())
    missing = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM feat"
                                 for c in union_columns(config_columns()))
    return (f"WITH {sql_features(MODEL)},\nms AS ({missing})\nSELECT config, ordinal, family, \"column\", missing "
            f"FROM (VALUES {rows}) v(config, ordinal, family, \"column\") JOIN ms USING (\"column\")")


def _sql_shortfalls() -> str:
    rows = ", ".join(
        f"({i}, '{s['name']}', '{s['target_group']}', {s.get('n_victims') or 'NULL'}, {s.get('victim_share') or 'NULL'})"
        for i, s in enumerate([*EVENTS_SCENARIOS, *DEFAULT_SCENARIOS]))
    return (f"WITH {_sql_user_day()},\ngs AS (SELECT \"group\", count(DISTINCT user_id) AS users FROM ud GROUP BY 1),\n"
            f"a AS (SELECT ordinal, name, target_group, coalesce(users, 0) AS users, coalesce(n, greatest(1, "
            f"CAST(floor(share * coalesce(users, 0)) AS BIGINT))) AS asked FROM "
            f"(VALUES {rows}) v(ordinal, name, target_group, n, share) LEFT JOIN gs ON target_group = gs.\"group\")\n"
            "SELECT ordinal, name, target_group, users, asked, CAST(greatest(0, asked - greatest(0, users - coalesce((SELECT sum(b.asked) "
            "FROM a b WHERE b.target_group = a.target_group AND b.ordinal < a.ordinal), 0))) AS BIGINT) AS missing FROM a")


def _sql_violations() -> str:
    groups = " UNION ALL ".join(
        f"SELECT '{p}' AS parameters, 'target_group' AS rule, '{s['name']}' AS subject, '{s['target_group']}' AS value"
        for p, ss in (("published", DEFAULT_SCENARIOS), ("events", EVENTS_SCENARIOS)) for s in ss)
    return (f"WITH {_sql_user_day()},\ng AS ({groups})\n"
            "SELECT 'published' AS parameters, 'primary_top_k' AS rule, 'evaluation' AS subject, '7' AS value\n"
            "UNION ALL SELECT 'published', 'test_window_start', 'evaluation', CAST(max(day) + 2 AS VARCHAR) FROM ud\n"
            f"UNION ALL SELECT 'events', 'test_window_start', 'evaluation', '{START}' FROM ud HAVING max(day) < {START}\n"
            "UNION ALL SELECT * FROM g WHERE value NOT IN (SELECT \"group\" FROM ud WHERE \"group\" IS NOT NULL)")


def _sql_run_log() -> str:
    long = " UNION ALL ".join(f"SELECT 'r1' AS run_id, 'self_z' AS config, 0 AS seed, '{m}' AS metric, {_sql_rnd(m)} AS value FROM met"
                              for m in metric_columns(EvalParams()))
    return f"WITH {_sql_scored()},\n{_sql_metrics_cte()}\n{long}"


STORE_ORACLES: dict[str, str] = {
    "features_all": _sql_features_all(),
    "feature_matrix": _sql_feature_matrix(),
    "feature_sets": _sql_feature_sets(),
    "target_shortfalls": _sql_shortfalls(),
    "parameter_violations": _sql_violations(),
    "trajectories": (f"WITH {_sql_user_day()},\n{_sql_scenarios()}\nSELECT user_id, day, bytes, logins, hosts, fails, is_anomaly, "
                     f"anomaly_type, attack_type FROM att JOIN vic USING (user_id) WHERE day BETWEEN {TRAJECTORY[0]} AND {TRAJECTORY[1]}"),
    "activity_round_trip": ORACLES["user_day_grid"],
    "feature_store_round_trip": (
        f"WITH {_sql_user_day()},\n{_sql_scenarios()},\nz AS ({_sql_family_of('self_z', 'att')}),\nd AS ({_sql_family_of('diff', 'att')})\n"
        f"SELECT user_id, day, {_sql_rnd('bytes_z_self')} AS bytes_z_self, {_sql_rnd('logins_diff1')} AS logins_diff1 "
        f"FROM z JOIN d USING (user_id, day) WHERE day >= {START}"),
    "victims_round_trip": ORACLES["victims"],
    "summary_round_trip": ORACLES["seed_average"],
    "run_log_round_trip": _sql_run_log(),
}
