"""vigil — behaviour-anomaly analytics on Spark.

Per-user, per-day activity tables are rolled up from raw events, labelled
incident scenarios are overlaid for back-testing, seven families of windowed
features are computed, rows are scored by a distributed isolation forest and
users are ranked and evaluated at an investigation budget K — for every
feature set and seed in one keyed Spark job.

Subpackages:
  sources    — reading/writing tables (activity rollup, feature table, run log)
  functions  — reusable Column expressions (rank correlation, exact peer stats)
  operators  — features, scenarios, forest, evaluation, sweep, checks
  plans      — end-to-end pipeline and the registered query catalogue
  streaming  — incremental user-day rollup over an event stream
"""

from vigil.params import (  # noqa: F401
    AnalysisParams,
    FeatureParams,
    ForestParams,
    EvalParams,
)

__all__ = ["AnalysisParams", "FeatureParams", "ForestParams", "EvalParams"]
