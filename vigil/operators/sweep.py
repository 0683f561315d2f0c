"""Feature sets and the keyed sweep over sets x seeds.

All (feature set, seed) runs are one Spark flow keyed by (config, seed):
one sample, one grouped fit producing every forest, one scoring pass that
emits every run's score, one keyed evaluation and one aggregate.
"""

from __future__ import annotations

from itertools import chain, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.evaluate import check_alignment, evaluate_users, metric_columns, user_totals
from vigil.operators.forest import (
    fit_forests,
    prepare_matrix,
    run_table,
    score_runs,
    scoring_table,
)
from vigil.params import (
    BYTES_ONLY_FAMILIES,
    FAMILY_MATRIX_COLUMNS,
    FEATURE_SETS,
    RAW_COLUMNS,
    SUMMARY_DECIMALS,
    EvalParams,
    ForestParams,
)
from vigil.session import materialize

RUN_KEYS = ("config", "seed")


def family_catalog(raw_columns=RAW_COLUMNS) -> dict[str, tuple[str, ...]]:
    """Matrix columns of every family over the raw measures; the measures
    themselves are the entry ``raw``."""
    return {"raw": tuple(raw_columns)} | {
        family: tuple(t.format(c=c) for c, t in product(
            ("bytes",) if family in BYTES_ONLY_FAMILIES else raw_columns, templates))
        for family, templates in FAMILY_MATRIX_COLUMNS.items()}


def feature_set_rows(feature_sets: dict = FEATURE_SETS, raw_columns=RAW_COLUMNS) -> list[tuple]:
    """E1/E2 as rows (config, ordinal, family, column), in declared order."""
    catalog = family_catalog(raw_columns)
    unknown = {f for families in feature_sets.values() for f in families} - set(catalog)
    if unknown:
        raise ValueError(f"no such family: {', '.join(sorted(unknown))}")
    return [(config, ordinal, family, column)
            for config, families in feature_sets.items()
            for ordinal, (family, column) in enumerate(
                (f, c) for f in ("raw", *families) for c in catalog[f])]


def config_columns(feature_sets: dict = FEATURE_SETS, raw_columns=RAW_COLUMNS) -> dict:
    """Every named set → its columns, in declared order."""
    out: dict[str, list[str]] = {}
    for config, _, _, column in feature_set_rows(feature_sets, raw_columns):
        out.setdefault(config, []).append(column)
    return out


def resolve_columns(config_name: str, feature_sets: dict = FEATURE_SETS,
                    raw_columns=RAW_COLUMNS) -> list[str]:
    """The columns of one set (raw measures only if it is not declared)."""
    one = {config_name: feature_sets.get(config_name, ())}
    return config_columns(one, raw_columns)[config_name]


def union_columns(cfg_cols: dict) -> list[str]:
    return list(dict.fromkeys(chain.from_iterable(cfg_cols.values())))


def fit_all_runs(features: DataFrame, cfg_cols: dict, forest: ForestParams) -> tuple[DataFrame, DataFrame, int]:
    """E3–E5 for every run: (matrix, tree table, rows).  Forests are fitted on all rows.

    ``features`` should be materialised (checkpointed): the sample, the fit and the scoring pass
    each read their columns of it.
    """
    matrix = prepare_matrix(features, union_columns(cfg_cols), forest.decimals)
    n = features.count()
    return matrix, materialize(fit_forests(matrix, cfg_cols, forest, n_rows=n)), n


def score_all_runs(features: DataFrame, cfg_cols: dict, forest: ForestParams,
                   score_from_day: int | None = None) -> tuple[DataFrame, DataFrame]:
    """E3–E6 for every run: (run table, scores (_block, user_id, day, run, score)); rows from
    ``score_from_day`` on (None: all rows)."""
    matrix, trees, n = fit_all_runs(features, cfg_cols, forest)
    columns = union_columns(cfg_cols)
    runs = run_table(features.sparkSession, cfg_cols, forest, columns)
    rows = matrix if score_from_day is None else matrix.where(F.col("day") >= score_from_day)
    return runs, score_runs(rows, scoring_table(trees, runs, forest), runs, forest, columns,
                            min(forest.max_samples, n), n)


def run_sweep(features: DataFrame, victims: DataFrame, forest: ForestParams = ForestParams(),
              evaluation: EvalParams = EvalParams(), feature_sets: dict = FEATURE_SETS,
              raw_columns=RAW_COLUMNS) -> DataFrame:
    """G1: metrics of every (config, seed) run, one wide row each.

    Only test-window rows are scored, once: the scores are rolled up to (run, user) in
    the stage that makes them, with the figures that F1 checks.
    """
    cfg_cols = config_columns(feature_sets, raw_columns)
    start = evaluation.test_window_start
    runs, scored = score_all_runs(features, cfg_cols, forest, start)
    users = materialize(user_totals(scored, start, evaluation.aggregation, ("_block", "run"), keyed=True))
    check_alignment(features.where(F.col("day") >= start), users, ("run",), len(cfg_cols) * len(forest.seeds))
    wide = evaluate_users(users, features, victims, evaluation, ("run",))
    return wide.join(F.broadcast(runs), "run").select(
        "config", "seed", *[c for c in wide.columns if c != "run"], F.size("place").alias("n_features"))


def summarize(runs: DataFrame, evaluation: EvalParams = EvalParams(),
              decimals: int = SUMMARY_DECIMALS) -> DataFrame:
    """Seed average of every metric, half-even rounding, headline
    columns first, best primary precision first (ties by config)."""
    headline = [f"precision_at_{evaluation.primary_top_k}", f"recall_at_{evaluation.primary_top_k}"]
    place = {m: i for i, m in enumerate(
        ["n_features", *headline, *(f"caught_{t}" for t in evaluation.attack_types_tracked)])}
    ordered = sorted([*metric_columns(evaluation), "n_features"], key=lambda m: place.get(m, len(place)))
    averages = [F.bround(F.avg(F.col(m).cast("double")), decimals).alias(m) for m in ordered]
    return runs.groupBy("config").agg(*averages).orderBy(F.col(headline[0]).desc(), F.col("config"))
