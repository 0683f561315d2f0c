"""Registered queries built on the isolation forest.

Their SQL oracles (``forest_oracles``) repeat the same keyed draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.evaluate import alignment, key_figures, metric_columns
from vigil.operators.forest import node_table, sample_rows, score_summary, top_rows_by_type, with_run_names
from vigil.operators.sweep import RUN_KEYS, config_columns, fit_all_runs, run_sweep, score_all_runs, summarize
from vigil.params import AnalysisParams
from vigil.plans.catalog import _rnd
from vigil.plans.pipeline import build_features
from vigil.session import materialize
from vigil.sources.activity import read_table


def _features(spark: SparkSession, sf: str, params: AnalysisParams):
    return build_features(spark, read_table(spark, sf, "events"),
                          read_table(spark, sf, "customer"), params)


def flagship(spark: SparkSession, sf: str, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """H1: seed-averaged summary of every feature set (one row per set)."""
    _, victims, features = _features(spark, sf, params)
    runs = materialize(run_sweep(features, materialize(victims), params.forest,
                                 params.evaluation, params.feature_sets,
                                 params.features.raw_columns))
    return summarize(runs, params.evaluation)


def _matrix(spark: SparkSession, sf: str, params: AnalysisParams):
    _, _, features = _features(spark, sf, params)
    cfg_cols = config_columns(params.feature_sets)
    return features, cfg_cols


def q_forest_sample(spark: SparkSession, sf: str, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """E5: the rows (user_id, day) of every (seed, tree)."""
    _, _, features = _features(spark, sf, params)
    return sample_rows(features.select("user_id", "day"), features.count(), params.forest) \
        .select("seed", "tree", "user_id", "day")


def q_forest_nodes(spark: SparkSession, sf: str, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """E5: the node table of every (feature set, seed) forest."""
    features, cfg_cols = _matrix(spark, sf, params)
    _, trees, _ = fit_all_runs(features, cfg_cols, params.forest)
    return node_table(trees)


def _scores(spark: SparkSession, sf: str, params: AnalysisParams) -> tuple[DataFrame, DataFrame]:
    """(features, scores of all rows named by config and seed)."""
    features, cfg_cols = _matrix(spark, sf, params)
    runs, scored = score_all_runs(features, cfg_cols, params.forest)
    return features, with_run_names(scored, runs)


def q_forest_scores(spark: SparkSession, sf: str, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """Every row scored by every forest."""
    return _scores(spark, sf, params)[1]


def q_score_summary(spark: SparkSession, sf: str, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """Min / max / mean score of every run over all rows."""
    return score_summary(_scores(spark, sf, params)[1])


def q_top_rows_by_type(spark: SparkSession, sf: str, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """Label counts among each run's 50 highest-scoring rows."""
    features, scored = _scores(spark, sf, params)
    return top_rows_by_type(scored, features, 50)


def q_score_alignment(spark: SparkSession, sf: str, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """F1: per run, rows, scored rows and whether their keys agree."""
    features, scored = _scores(spark, sf, params)
    return alignment(features, key_figures(scored, RUN_KEYS), RUN_KEYS)


def q_ablation_runs(spark: SparkSession, sf: str, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """G1: metrics of every (feature set, seed) run."""
    _, victims, features = _features(spark, sf, params)
    return run_sweep(features, materialize(victims), params.forest, params.evaluation,
                     params.feature_sets, params.features.raw_columns)


def _rounded(query, *columns):
    """The query with its measures rounded as the oracles' are."""
    def q(spark: SparkSession, sf: str) -> DataFrame:
        out = query(spark, sf)
        return out.select(*[_rnd(F.col(c)).alias(c) if c in columns else c for c in out.columns])
    q.__doc__ = query.__doc__
    return q


FOREST_QUERIES = {
    "forest_sample": q_forest_sample,
    "forest_nodes": _rounded(q_forest_nodes, "threshold", "path"),
    "forest_scores": _rounded(q_forest_scores, "score"),
    "score_summary": _rounded(q_score_summary, "score_min", "score_max", "score_mean"),
    "top_rows_by_type": q_top_rows_by_type,
    "score_alignment": q_score_alignment,
    "ablation_runs": _rounded(q_ablation_runs, *metric_columns(AnalysisParams().evaluation)),
    "ablation": flagship,
}
