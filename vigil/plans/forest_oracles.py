"""DuckDB SQL of the forest queries: the same draws, growth and walk as plain joins.

Features, sample, node table and scores of the full model (7 sets x 5 seeds x 200
trees) are built from the shipped tables alone.
"""

from __future__ import annotations

from vigil.operators.forest import MICRO, max_depth_for
from vigil.operators.sweep import config_columns, union_columns
from vigil.params import AnalysisParams
from vigil.plans.catalog import (
    START,
    _sql_family_of,
    _sql_metrics_cte,
    _sql_rnd,
    _sql_scenarios,
    _sql_user_day,
    _sql_user_level,
)

MODEL = AnalysisParams()


def sql_features(params: AnalysisParams) -> str:
    """CTE ``feat``: the attacked table with every family."""
    families = params.features.families
    joins = "".join(f" JOIN ({_sql_family_of(f, 'att')}) AS f_{f} USING (user_id, day)" for f in families)
    return f"{_sql_user_day()},\n{_sql_scenarios(params.scenarios)},\nfeat AS MATERIALIZED (SELECT * FROM att{joins})"


def sql_matrix(params: AnalysisParams) -> str:
    """CTE ``mx``: user_id, day and the list ``x`` of cleaned, rounded features."""
    scale = 10.0 ** params.forest.decimals
    cols = union_columns(config_columns(params.feature_sets))
    clean = ", ".join(f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)) THEN 0.0 ELSE "
                      f"round_even(CAST({c} AS DOUBLE) * {scale}, 0) / {scale} + 0.0 END" for c in cols)
    return f"mx AS MATERIALIZED (SELECT user_id, day, [{clean}] AS x FROM feat)"


def _unit(key: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', {key})), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)})"


def sql_sample(params: AnalysisParams) -> str:
    """CTEs ``size`` (psi, rate) and ``samp`` (seed, tree, user_id, day)."""
    p = params.forest
    gap = lambda k: f"CASE WHEN rate >= 1.0 THEN 0 ELSE least(floor(ln({_unit(f'seed, user_id, day, {k}')}) / ln(1.0 - rate)), {p.n_trees}) END"
    return f"""size AS (SELECT least({p.max_samples}, count(*)) AS psi,
  least(1.0, {p.oversample} * least({p.max_samples}, count(*)) / greatest(count(*), 1)) AS rate FROM att),
walk(seed, user_id, day, k, tree) AS (
  SELECT seed, user_id, day, 0, CAST({gap('0')} AS INTEGER)
  FROM att, size, (SELECT unnest({list(p.seeds)}) AS seed)
  UNION ALL
  SELECT seed, user_id, day, k + 1, CAST(tree + 1 + {gap('k + 1')} AS INTEGER) FROM walk, size WHERE tree < {p.n_trees}),
samp AS MATERIALIZED (SELECT seed, tree, user_id, day FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, tree ORDER BY
    md5(concat_ws('|', seed, tree, user_id, day, 'cut')), user_id, day) AS rn
  FROM walk WHERE tree < {p.n_trees}), size WHERE rn <= psi)"""


def sql_growth(params: AnalysisParams) -> str:
    """CTE ``node`` (config, seed, tree, node, feature, place, threshold, depth, size)."""
    cfg = config_columns(params.feature_sets)
    cols = union_columns(cfg)
    sets = " UNION ALL ".join(f"SELECT '{c}' AS config, {[cols.index(x) + 1 for x in xs]} AS place" for c, xs in cfg.items())
    depth = max_depth_for(params.forest.max_samples)
    lo = ", ".join(f"min(x[{i + 1}])" for i in range(len(cols)))
    hi = ", ".join(f"max(x[{i + 1}])" for i in range(len(cols)))
    parts = [f"sets AS ({sets})",
             "a0 AS MATERIALIZED (SELECT config, seed, tree, user_id, day, 1 AS node FROM samp, sets)"]
    found = []
    for k in range(depth + 1):
        last = k == depth
        parts.append(f"g{k} AS MATERIALIZED (SELECT config, seed, tree, node, count(*) AS size"
                     + ("" if last else f", [{lo}] AS lo, [{hi}] AS hi") +
                     f" FROM a{k}" + ("" if last else " JOIN mx USING (user_id, day)") + " GROUP BY config, seed, tree, node)")
        if last:
            found.append(f"SELECT config, seed, tree, node, -1 AS feature, NULL::BIGINT AS place, NULL::DOUBLE AS threshold, "
                         f"{k} AS depth, size FROM g{k}")
            break
        # a tree of fewer rows stops at its own depth
        parts.append(f"""s{k} AS MATERIALIZED (SELECT config, seed, tree, node, size, feature, place[feature + 1] AS place,
  CASE WHEN feature >= 0 THEN CASE WHEN low + v * (high - low) >= high THEN low ELSE low + v * (high - low) END END AS threshold
  FROM (SELECT *, lo[place[feature + 1]] AS low, hi[place[feature + 1]] AS high FROM (
    SELECT *, CASE WHEN size >= 2 AND len(usable) > 0 AND {k} < greatest(1, ceil(log2(greatest(psi, 2)))) THEN
        usable[CAST(floor(CAST('0x' || substr(h, 1, 8) AS BIGINT) / {float(1 << 32)} * len(usable)) AS BIGINT) + 1] ELSE -1 END AS feature,
      CAST('0x' || substr(h, 9, 13) AS BIGINT) / {float(1 << 52)} AS v FROM (
      SELECT *, md5(concat_ws('|', seed, config, tree, node)) AS h,
        list_filter(range(0, len(place)), lambda i: hi[place[i + 1]] > lo[place[i + 1]]) AS usable
      FROM g{k} JOIN sets USING (config), size))))""")
        found.append(f"SELECT config, seed, tree, node, feature, place, threshold, {k} AS depth, size FROM s{k}")
        parts.append(f"""a{k + 1} AS MATERIALIZED (SELECT config, seed, tree, user_id, day,
  2 * node + CASE WHEN x[place] > threshold THEN 1 ELSE 0 END AS node
  FROM a{k} JOIN (SELECT * FROM s{k} WHERE feature >= 0) USING (config, seed, tree, node) JOIN mx USING (user_id, day))""")
    parts.append("node AS MATERIALIZED (" + "\nUNION ALL ".join(found) + ")")
    return ",\n".join(parts)


C_N = ("CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + 0.57721566490153286) "
       "- 2.0 * ({n} - 1.0) / {n} END")


def sql_scores(params: AnalysisParams, where: str = "TRUE") -> str:
    """CTE ``fs`` (config, seed, user_id, day, score) of the rows ``where``."""
    depth = max_depth_for(params.forest.max_samples)
    size = C_N.format(n="size")
    parts = [f"nn AS MATERIALIZED (SELECT *, CAST(round_even((depth + {size}) * {MICRO}.0, 0) AS BIGINT) AS path FROM node)",
             f"w0 AS (SELECT config, seed, tree, user_id, day, x, 1 AS node FROM mx, "
             f"(SELECT DISTINCT config, seed, tree FROM node) WHERE {where})"]
    for k in range(depth):
        parts.append(f"w{k + 1} AS (SELECT w.config, w.seed, w.tree, user_id, day, x, CASE WHEN n.feature >= 0 THEN "
                     f"2 * w.node + CASE WHEN x[n.place] > n.threshold THEN 1 ELSE 0 END ELSE w.node END AS node "
                     f"FROM w{k} w JOIN nn n ON w.config = n.config AND w.seed = n.seed AND w.tree = n.tree AND w.node = n.node)")
    parts.append(f"""fs AS MATERIALIZED (SELECT w.config, w.seed, user_id, day,
  pow(2.0, -(CAST(sum(path) AS DOUBLE) / {float(params.forest.n_trees) * MICRO}) / {C_N.format(n='psi')}) AS score
  FROM w{depth} w JOIN nn n ON w.config = n.config AND w.seed = n.seed AND w.tree = n.tree AND w.node = n.node, size
  GROUP BY w.config, w.seed, user_id, day, psi)""")
    return ",\n".join(parts)


def _model(params: AnalysisParams) -> str:
    return (f"WITH RECURSIVE {sql_features(params)},\n{sql_matrix(params)},\n{sql_sample(params)},\n{sql_growth(params)}")


def _scored(params: AnalysisParams, where: str = "TRUE") -> str:
    return f"{_model(params)},\n{sql_scores(params, where)}"


def sql_nodes(params: AnalysisParams) -> str:
    return f"""{_model(params)}
SELECT config, seed, tree, node, feature, {_sql_rnd('coalesce(threshold, 0.0)')} AS threshold,
  CASE WHEN feature >= 0 THEN 2 * node ELSE -1 END AS "left", CASE WHEN feature >= 0 THEN 2 * node + 1 ELSE -1 END AS "right",
  depth, size, {_sql_rnd(f"depth + {C_N.format(n='size')}")} AS path FROM node"""


def _sql_runs(params: AnalysisParams) -> str:
    """CTE ``runs``: metrics of every run."""
    counts = " UNION ALL ".join(f"SELECT '{c}' AS config, {len(x)} AS n_features"
                                for c, x in config_columns(params.feature_sets).items())
    return (f"{_scored(params, f'day >= {START}')},\n"
            "sc AS (SELECT fs.*, is_anomaly, anomaly_type FROM fs JOIN att USING (user_id, day)),\n"
            f"{_sql_metrics_cte('sc', ('config', 'seed'))},\n"
            f"runs AS (SELECT * FROM met JOIN ({counts}) USING (config))")


def _metrics() -> list[str]:
    from vigil.operators.evaluate import metric_columns
    return metric_columns(MODEL.evaluation)


def _sql_summary(params: AnalysisParams) -> str:
    avg = ", ".join(f"round_even(avg(CAST({m} AS DOUBLE)), 3) AS {m}" for m in [*_metrics(), "n_features"])
    return f"{_sql_runs(params)}\nSELECT config, {avg} FROM runs GROUP BY config"


FOREST_ORACLES: dict[str, str] = {
    "forest_sample": (f"WITH RECURSIVE {_sql_user_day()},\n{_sql_scenarios()},\n{sql_sample(MODEL)}\n"
                      "SELECT seed, tree, user_id, day FROM samp"),
    "forest_nodes": sql_nodes(MODEL),
    "forest_scores": f"{_scored(MODEL)}\nSELECT config, seed, user_id, day, {_sql_rnd('score')} AS score FROM fs",
    "score_summary": (f"{_scored(MODEL)}\nSELECT config, seed, {_sql_rnd('min(score)')} AS score_min, "
                          f"{_sql_rnd('max(score)')} AS score_max, {_sql_rnd('avg(score)')} AS score_mean, count(*) AS rows "
                          "FROM fs GROUP BY config, seed"),
    "top_rows_by_type": (
        f"{_scored(MODEL)}\nSELECT config, seed, anomaly_type, count(*) AS rows FROM (SELECT *, row_number() OVER "
        "(PARTITION BY config, seed ORDER BY score DESC, user_id, day) AS rn FROM fs) JOIN att USING (user_id, day) "
        "WHERE rn <= 50 GROUP BY config, seed, anomaly_type"),
    "score_alignment": (f"{_scored(MODEL)}\nSELECT config, seed, (SELECT count(*) FROM att) AS rows, count(*) AS scored_rows, "
                            "count(*) = (SELECT count(*) FROM att) AS aligned FROM fs GROUP BY config, seed"),
    "ablation_runs": (f"{_sql_runs(MODEL)}\nSELECT config, seed, n_features, "
                          + ", ".join(f"{_sql_rnd(m)} AS {m}" for m in _metrics()) + " FROM runs"),
    "ablation": _sql_summary(MODEL),
}
