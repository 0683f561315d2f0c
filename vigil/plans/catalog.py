"""Catalogue of registered queries and their SQL oracles.

Every query reads the shipped tables (``events``, ``customer``) of a scale
factor directory and runs over all of their rows.  ``ORACLES`` holds, per
query, an independent ANSI SQL formulation (DuckDB dialect) over the same
tables; doubles are rounded to 6 decimals on both sides, every computed
column is aliased identically, and every tie is broken by key.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import checks
from vigil.operators.evaluate import (
    evaluate,
    metrics_long,
    rank_users,
    user_scores,
)
from vigil.operators.features import compute_features, family_columns
from vigil.operators.scenarios import plant, scenario_table
from vigil.params import (
    EVENTS_DAY_ZERO,
    EVENTS_SCENARIOS,
    EVENTS_TEST_WINDOW_START,
    DEFAULT_SCENARIO_SEED,
    EPSILON,
    MAD_CONSTANT,
    RAW_COLUMNS,
    EvalParams,
    FeatureParams,
)
from vigil.session import materialize
from vigil.sources.activity import (
    activity_from_testdata,
    partition_by_user,
    read_table,
    user_day_from_events,
    user_groups,
    users_without_group,
)

ROUND = 6
RAW = list(RAW_COLUMNS)
START = EVENTS_TEST_WINDOW_START
SEED = DEFAULT_SCENARIO_SEED
SEEDS_FOR_AVERAGE = (0, 1, 2, 3, 4)

# ============================================================ Spark side

SCALE = float(10 ** ROUND)


def _rnd(col: Column) -> Column:
    """Round to ROUND decimals as round(x * 10^ROUND) / 10^ROUND.

    The scaled product is the same IEEE double in every engine, and rounding
    it to an integer is exact, so equal inputs give equal outputs (a decimal
    round of x itself differs between engines on exact binary halves).
    Adding 0.0 turns a rounded -0.0 into 0.0.
    """
    return F.round(col * F.lit(SCALE), 0) / F.lit(SCALE) + F.lit(0.0)


def _r(c: str) -> Column:
    return _rnd(F.col(c)).alias(c)


def _activity(spark: SparkSession, sf: str) -> DataFrame:
    """The complete user-day table, hash-partitioned by user and checkpointed: later
    jobs of a query (draws, checks, windows) re-read it instead of
    re-aggregating the event log."""
    return materialize(partition_by_user(activity_from_testdata(spark, sf, EVENTS_DAY_ZERO)),
                       keep_partitioning=True)


def _attacked(spark: SparkSession, sf: str, scenarios=EVENTS_SCENARIOS):
    act = _activity(spark, sf)
    return plant(act, scenario_table(spark, scenarios), SEED, START)


def _family_query(family: str) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark: SparkSession, sf: str) -> DataFrame:
        f = compute_features(_activity(spark, sf), FeatureParams(), families=[family])
        cols = family_columns(family, RAW)
        return f.select("user_id", "day", *[F.col(c) if c.endswith("_med_self") else _r(c)
                                            for c in cols])
    return q


def q_user_day(spark, sf):
    return user_day_from_events(read_table(spark, sf, "events"), read_table(spark, sf, "customer"))


def q_user_day_grid(spark, sf):
    return activity_from_testdata(spark, sf)


def q_users_without_group(spark, sf):
    return users_without_group(read_table(spark, sf, "events"), read_table(spark, sf, "customer"))


def q_user_groups(spark, sf):
    return user_groups(_activity(spark, sf))


def q_profile(spark, sf):
    return checks.profile(_activity(spark, sf))


def q_users_per_group(spark, sf):
    return checks.users_per_group(_activity(spark, sf))


def q_key_violations(spark, sf):
    return checks.key_violations(_activity(spark, sf))


def q_days_per_user(spark, sf):
    return checks.days_per_user(_activity(spark, sf))


def q_range_checks(spark, sf):
    return checks.range_checks(_activity(spark, sf))


def q_victims(spark, sf):
    _, victims = _attacked(spark, sf)
    return victims


def _overlay_query(name: str | None):
    scen = EVENTS_SCENARIOS if name is None else tuple(s for s in EVENTS_SCENARIOS
                                                      if s["name"] == name)

    def q(spark, sf):
        out, _ = _attacked(spark, sf, scen)
        return out
    return q


def q_labels_by_type(spark, sf):
    out, _ = _attacked(spark, sf)
    return checks.labels_by_type(out)


def q_label_checks(spark, sf):
    out, victims = _attacked(spark, sf)
    return checks.label_violations(out, victims, START)


def _scored_by_self_z(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows scored by |bytes_z_self| on the attacked table (a transparent
    scorer whose ranking DuckDB can reproduce), the victims and the labelled table."""
    out, victims = _attacked(spark, sf)
    f = compute_features(out, FeatureParams(), families=["self_z"])
    scored = f.select("user_id", "day", "is_anomaly", "anomaly_type",
                      F.abs(F.col("bytes_z_self")).alias("score"))
    return scored, victims, out


def _ranking_query(aggregation: str):
    def q(spark, sf):
        scored, _, labelled = _scored_by_self_z(spark, sf)
        ranked = rank_users(user_scores(scored, START, aggregation, labelled=labelled))
        return ranked.select("user_id", _r("agg_score"), "is_attacker", "attack_type", "rank")
    return q


def q_precision_recall(spark, sf):
    scored, victims, labelled = _scored_by_self_z(spark, sf)
    wide = evaluate(scored, victims, EvalParams(), labelled=labelled)
    return wide.select(*[_r(c) for c in wide.columns])


def q_caught_by_type(spark, sf):
    scored, victims, labelled = _scored_by_self_z(spark, sf)
    params = EvalParams()
    wide = evaluate(scored, victims, params, labelled=labelled)
    long = metrics_long(wide, params)
    return (long.where(F.col("metric").startswith("caught_"))
            .select(F.regexp_replace("metric", "^caught_", "").alias("attack_type"),
                    _rnd(F.col("value")).alias("caught")))


def _weight(seed_col: Column) -> Column:
    """A per-(seed, row) weight in [0.5, 1.5) from an md5 draw."""
    h = F.md5(F.concat_ws("|", seed_col.cast("string"), F.col("user_id").cast("string"),
                          F.col("day").cast("string")))
    return 0.5 + F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def q_seed_average(spark, sf):
    """G1–G4 with a transparent scorer: runs (measure, seed) score rows by
    |measure_z_self| x an md5 weight; summary over seeds."""
    from vigil.operators.sweep import summarize
    out, victims = _attacked(spark, sf)
    f = compute_features(out, FeatureParams(), families=["self_z"])
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS_FOR_AVERAGE])).alias("seed")
    cfg = F.explode(F.array(*[F.struct(F.lit(c).alias("config"),
                                       F.abs(F.col(f"{c}_z_self")).alias("z"))
                              for c in RAW])).alias("_c")
    scored = (f.select("user_id", "day", "is_anomaly", "anomaly_type", cfg)
              .select("*", seeds)
              .select("user_id", "day", "is_anomaly", "anomaly_type",
                      F.col("_c.config").alias("config"), "seed",
                      (F.col("_c.z") * _weight(F.col("seed"))).alias("score")))
    params = EvalParams()
    runs = evaluate(scored, victims, params, run_keys=("config", "seed"), labelled=out)
    runs = runs.withColumn("n_features", F.lit(1))
    return summarize(runs, params)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "user_day": q_user_day,
    "user_day_grid": q_user_day_grid,
    "users_without_group": q_users_without_group,
    "user_groups": q_user_groups,
    "profile": q_profile,
    "users_per_group": q_users_per_group,
    "key_violations": q_key_violations,
    "days_per_user": q_days_per_user,
    "range_checks": q_range_checks,
    "self_z": _family_query("self_z"),
    "robust_z": _family_query("robust_z"),
    "peer_z": _family_query("peer_z"),
    "rolling": _family_query("rolling"),
    "diff": _family_query("diff"),
    "ramp": _family_query("ramp"),
    "spearman": _family_query("spearman"),
    "victims": q_victims,
    "overlay_exfil": _overlay_query("exfil"),
    "overlay_cred_theft": _overlay_query("cred_theft"),
    "overlay_lateral": _overlay_query("lateral"),
    "overlay_subtle_exfil": _overlay_query("subtle_exfil"),
    "overlay_slow_ramp": _overlay_query("slow_ramp"),
    "overlay_all": _overlay_query(None),
    "labels_by_type": q_labels_by_type,
    "label_checks": q_label_checks,
    "user_ranking_sum": _ranking_query("sum"),
    "user_ranking_max": _ranking_query("max"),
    "user_ranking_mean": _ranking_query("mean"),
    "precision_recall": q_precision_recall,
    "caught_by_type": q_caught_by_type,
    "seed_average": q_seed_average,
}

# ============================================================ SQL oracles

EPS = repr(EPSILON)


def _sql_rnd(c: str) -> str:
    return f"(round(({c}) * {SCALE}) / {SCALE} + 0.0)"


def _sql_user_day() -> str:
    """CTE ``ud``: the complete grid over ``uds``."""
    return f"""{_sql_rolled()},
spine AS (SELECT unnest(range(lo, hi + 1)) AS day FROM (
  SELECT min(datediff('day', DATE '{EVENTS_DAY_ZERO}', CAST(ts AS DATE))) AS lo,
         max(datediff('day', DATE '{EVENTS_DAY_ZERO}', CAST(ts AS DATE))) AS hi
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)),
ud AS (
  SELECT u.user_id, u."group", CAST(s.day AS INTEGER) AS day, coalesce(bytes, 0) AS bytes, coalesce(logins, 0) AS logins,
         coalesce(hosts, 0) AS hosts, coalesce(fails, 0) AS fails, FALSE AS is_anomaly, '' AS anomaly_type
  FROM (SELECT DISTINCT user_id, "group" FROM uds) u CROSS JOIN spine s
  LEFT JOIN uds ON uds.user_id = u.user_id AND uds.day = s.day)"""


def _sql_rolled() -> str:
    return f"""uds AS (
  SELECT e.user_id, c.c_mktsegment AS "group", CAST(e.day AS INTEGER) AS day,
         e.bytes, e.logins, e.hosts, e.fails,
         FALSE AS is_anomaly, '' AS anomaly_type
  FROM (SELECT user_id,
               datediff('day', DATE '{EVENTS_DAY_ZERO}', CAST(ts AS DATE)) AS day,
               CAST(floor(sum(CAST(value AS DECIMAL(18,2)))) AS BIGINT) AS bytes,
               count(*) FILTER (WHERE event_type = 'view') AS logins,
               count(DISTINCT props) AS hosts,
               count(*) FILTER (WHERE event_type = 'error') AS fails
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
        GROUP BY 1, 2) e
  JOIN customer c ON c.c_custkey = e.user_id)"""


def _w_user(frame: str) -> str:
    return f"(PARTITION BY user_id ORDER BY day ROWS BETWEEN {frame})"


W_PAST = _w_user("UNBOUNDED PRECEDING AND 1 PRECEDING")


def _sql_self_z(src: str, name: str = "sz") -> str:
    cols = []
    for c in RAW:
        cols += [f"avg(CAST({c} AS DOUBLE)) OVER wp AS {c}_mean_self",
                 f"stddev_samp(CAST({c} AS DOUBLE)) OVER wp AS {c}_std_self"]
    z = [f"(CAST({c} AS DOUBLE) - {c}_mean_self) / ({c}_std_self + {EPS}) AS {c}_z_self"
         for c in RAW]
    return (f"{name}0 AS (SELECT *, {', '.join(cols)} FROM {src} WINDOW wp AS {W_PAST}),\n"
            f"{name} AS (SELECT *, {', '.join(z)} FROM {name}0)")


def _round_list(cols) -> str:
    return ", ".join(f"{_sql_rnd(c)} AS {c}" for c in cols)


def _sql_family(family: str) -> str:
    cols = family_columns(family, RAW)
    return (f"WITH {_sql_user_day()},\nff AS ({_sql_family_of(family, 'ud')})\nSELECT user_id, day, "
            + ", ".join(c if c.endswith("_med_self") else f"{_sql_rnd(c)} AS {c}" for c in cols) + " FROM ff")


def _sql_family_of(family: str, src: str) -> str:
    """user_id, day and the columns of a family over the user-day CTE ``src``."""
    cols = family_columns(family, RAW)
    if family == "self_z":
        body = _sql_self_z(src, "f")
    elif family == "robust_z":
        med = [f"quantile_disc({c}, 0.5) OVER wp AS {c}_med_self" for c in RAW]
        mad = [f"{MAD_CONSTANT} * quantile_disc(abs(CAST({c} AS DOUBLE) - {c}_med_self), 0.5) "
               f"OVER wp AS {c}_mad_self" for c in RAW]
        rz = [f"(CAST({c} AS DOUBLE) - {c}_med_self) / ({c}_mad_self + {EPS}) AS {c}_rz_self"
              for c in RAW]
        body = (f"f0 AS (SELECT *, {', '.join(med)} FROM {src} WINDOW wp AS {W_PAST}),\n"
                f"f1 AS (SELECT *, {', '.join(mad)} FROM f0 WINDOW wp AS {W_PAST}),\n"
                f"f AS (SELECT *, {', '.join(rz)} FROM f1)")
    elif family == "peer_z":
        aggs = []
        for c in RAW:
            aggs += [f"count({c}) AS n_{c}", f"sum(CAST({c} AS HUGEINT)) AS s1_{c}",
                     f"sum(CAST({c} AS HUGEINT) * CAST({c} AS HUGEINT)) AS s2_{c}"]
        lvl1 = []
        for c in RAW:
            lvl1 += [f"n_{c} - 1 AS m_{c}",
                     f"s1_{c} - CAST({c} AS HUGEINT) AS t1_{c}",
                     f"s2_{c} - CAST({c} AS HUGEINT) * CAST({c} AS HUGEINT) AS t2_{c}"]
        lvl2 = []
        for c in RAW:
            lvl2 += [
                f"CASE WHEN m_{c} <> 0 THEN CAST(t1_{c} AS DOUBLE) / CAST(m_{c} AS DOUBLE) END "
                f"AS {c}_mean_peer_loo",
                f"sqrt(CASE WHEN m_{c} * (m_{c} - 1) = 0 THEN 0.0 ELSE greatest("
                f"CAST(m_{c} * t2_{c} - t1_{c} * t1_{c} AS DOUBLE) / CAST(m_{c} * (m_{c} - 1) AS DOUBLE), 0.0) END) "
                f"AS {c}_std_peer_loo"]
        z = [f"(CAST({c} AS DOUBLE) - {c}_mean_peer_loo) / ({c}_std_peer_loo + {EPS}) AS {c}_z_peer_loo"
             for c in RAW]
        body = (f"ps AS (SELECT \"group\", day, {', '.join(aggs)} FROM {src} GROUP BY 1, 2),\n"
                f"f0 AS (SELECT {src}.*, {', '.join(lvl1)} FROM {src} JOIN ps USING (\"group\", day)),\n"
                f"f1 AS (SELECT *, {', '.join(lvl2)} FROM f0),\n"
                f"f AS (SELECT *, {', '.join(z)} FROM f1)")
    elif family == "rolling":
        agg = []
        for c in RAW:
            agg += [f"max(CAST({c} AS DOUBLE)) OVER wr AS {c}_roll7_max",
                    f"avg(CAST({c} AS DOUBLE)) OVER wr AS {c}_roll7_mean",
                    f"stddev_samp(CAST({c} AS DOUBLE)) OVER wr AS {c}_roll7_std"]
        body = (f"f AS (SELECT *, {', '.join(agg)} FROM {src} "
                f"WINDOW wr AS {_w_user('7 PRECEDING AND 1 PRECEDING')})")
    elif family == "diff":
        lag = [f"lag(CAST({c} AS DOUBLE), 1) OVER (PARTITION BY user_id ORDER BY day) AS lag_{c}"
               for c in RAW]
        d = []
        for c in RAW:
            d += [f"CAST({c} AS DOUBLE) - lag_{c} AS {c}_diff1",
                  f"(CAST({c} AS DOUBLE) - lag_{c}) / (abs(lag_{c}) + {EPS}) AS {c}_pct1"]
        body = (f"f0 AS (SELECT *, {', '.join(lag)} FROM {src}),\n"
                f"f AS (SELECT *, {', '.join(d)} FROM f0)")
    elif family == "ramp":
        sums, fit = [], []
        for c in RAW:
            y, x = f"CAST({c} AS HUGEINT)", "CAST(day AS HUGEINT)"
            sums += [f"count({c}) OVER wr AS n_{c}", f"sum({x}) OVER wr AS sx_{c}",
                     f"sum({y}) OVER wr AS sy_{c}", f"sum({x} * {y}) OVER wr AS sxy_{c}",
                     f"sum({x} * {x}) OVER wr AS sxx_{c}", f"sum({y} * {y}) OVER wr AS syy_{c}"]
            fit += [f"n_{c} * sxy_{c} - sx_{c} * sy_{c} AS cov_{c}",
                    f"n_{c} * sxx_{c} - sx_{c} * sx_{c} AS vx_{c}",
                    f"n_{c} * syy_{c} - sy_{c} * sy_{c} AS vy_{c}"]
        out = []
        for c in RAW:
            out += [f"CASE WHEN vx_{c} <> 0 THEN CAST(cov_{c} AS DOUBLE) / CAST(vx_{c} AS DOUBLE) END "
                    f"AS {c}_ramp_slope",
                    f"CASE WHEN vx_{c} = 0 THEN NULL WHEN vy_{c} = 0 THEN 1.0 ELSE "
                    f"CAST(cov_{c} AS DOUBLE) * CAST(cov_{c} AS DOUBLE) / "
                    f"(CAST(vx_{c} AS DOUBLE) * CAST(vy_{c} AS DOUBLE)) END AS {c}_ramp_r2"]
        sig = [f"CASE WHEN {c}_ramp_slope > 0 THEN {c}_ramp_r2 ELSE 0.0 END AS {c}_ramp_signal"
               for c in RAW]
        body = (f"f0 AS (SELECT *, {', '.join(sums)} FROM {src} "
                f"WINDOW wr AS {_w_user('6 PRECEDING AND CURRENT ROW')}),\n"
                f"f1 AS (SELECT *, {', '.join(fit)} FROM f0),\n"
                f"f2 AS (SELECT *, {', '.join(out)} FROM f1),\n"
                f"f AS (SELECT *, {', '.join(sig)} FROM f2)")
    elif family == "spearman":
        body = _sql_spearman(src)
    else:
        raise ValueError(family)
    return f"WITH {body}\nSELECT user_id, day, {', '.join(cols)} FROM f"


def _sql_spearman(src: str) -> str:
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS x_{c}" for c in RAW)
    bx = ", ".join(f"b.x_{c}" for c in RAW)
    ranks = ", ".join(
        f"rank() OVER (PARTITION BY user_id, day ORDER BY x_{c}) "
        f"+ (count(*) OVER (PARTITION BY user_id, day, x_{c}) - 1) / 2.0 AS r_{c}" for c in RAW)
    rho = []
    for c in RAW:
        rho.append(f"CASE WHEN count(*) >= 3 AND count(x_{c}) = count(*) AND stddev_pop(x_{c}) > 1e-9 THEN "
                   f"coalesce(CASE WHEN isnan(corr(pos, r_{c})) THEN 0.0 ELSE corr(pos, r_{c}) END, 0.0) "
                   f"ELSE 0.0 END AS {c}_spearman")
    pos = [f"greatest({c}_spearman, 0.0) AS {c}_spearman_pos" for c in RAW]
    return (f"sb AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn, "
            f"{xs} FROM {src}),\n"
            f"sp AS (SELECT a.user_id, a.day, CAST(b.rn - a.rn AS DOUBLE) AS pos, {bx} FROM sb a "
            f"JOIN sb b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 6 AND a.rn),\n"
            f"sr AS (SELECT *, {ranks} FROM sp),\n"
            f"f0 AS (SELECT user_id, day, {', '.join(rho)} FROM sr GROUP BY user_id, day),\n"
            f"f AS (SELECT *, {', '.join(pos)} FROM f0)")


# ---- scenarios in SQL

def _sql_scenarios(scenarios=EVENTS_SCENARIOS) -> str:
    """CTEs: users, vic (attack_type, user_id), tg (targets), att (overlaid)."""
    parts = ["users AS (SELECT DISTINCT user_id, \"group\" FROM ud)",
             "gsz AS (SELECT \"group\", count(*) AS gu FROM users GROUP BY 1)"]
    vic_names = []
    for i, s in enumerate(scenarios):
        if s.get("n_victims") is not None:
            n_expr = f"{int(s['n_victims'])}"
        else:
            n_expr = (f"(SELECT greatest(1, CAST(floor({float(s['victim_share'])} * gu) AS INTEGER)) "
                      f"FROM gsz WHERE \"group\" = '{s['target_group']}')")
        excl = ""
        if vic_names:
            excl = " AND user_id NOT IN (" + " UNION ALL ".join(
                f"SELECT user_id FROM {v}" for v in vic_names) + ")"
        parts.append(
            f"v{i} AS (SELECT '{s['name']}' AS attack_type, user_id FROM ("
            f"SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', '{s['name']}', "
            f"CAST(user_id AS VARCHAR))), user_id) AS rn FROM users "
            f"WHERE \"group\" = '{s['target_group']}'{excl}) WHERE rn <= coalesce({n_expr}, 0))")
        vic_names.append(f"v{i}")
    parts.append("vic AS (" + " UNION ALL ".join(f"SELECT * FROM {v}" for v in vic_names) + ")")
    tgts = []
    for s in scenarios:
        name = s["name"]
        if name == "subtle_exfil":
            days = sorted(set(int(d) for d in s["days_offset"]))
            tgts.append(
                f"SELECT user_id, {START} + d AS day, '{name}' AS t_type, "
                f"{float(s['bytes_multiplier'])} AS t_mult, NULL::BIGINT AS t_bytes, NULL::BIGINT AS t_logins, "
                f"NULL::BIGINT AS t_fails, NULL::BIGINT AS t_hosts FROM vic, "
                f"(SELECT unnest({days}) AS d) WHERE attack_type = '{name}'")
            continue
        dur = int(s.get("duration_days") or 0)
        off = int(s.get("start_day_offset") or 0)
        if dur <= 0:
            continue
        rng = f"(SELECT unnest(range(0, {dur})) AS i)"
        if name == "slow_ramp":
            base = (f"(SELECT a.user_id, CAST(trunc(median(CAST(a.bytes AS DOUBLE))) AS BIGINT) AS base "
                    f"FROM ud a JOIN vic v ON a.user_id = v.user_id AND v.attack_type = '{name}' "
                    f"WHERE a.day < {START} GROUP BY a.user_id)")
            tgts.append(
                f"SELECT v.user_id, {START + off} + i AS day, '{name}' AS t_type, NULL::DOUBLE AS t_mult, "
                f"CAST(trunc(b.base * ({float(s['ramp_start_multiplier'])} + {float(s['ramp_step'])} * i)) "
                f"AS BIGINT) AS t_bytes, NULL::BIGINT AS t_logins, NULL::BIGINT AS t_fails, "
                f"NULL::BIGINT AS t_hosts "
                f"FROM vic v LEFT JOIN {base} b ON v.user_id = b.user_id, {rng} "
                f"WHERE v.attack_type = '{name}'")
        else:
            mult = f"{float(s['bytes_multiplier'])}" if name == "exfil" else "NULL::DOUBLE"
            la = f"{int(s['logins_add'])}::BIGINT" if name == "cred_theft" else "NULL::BIGINT"
            fa = f"{int(s['fails_add'])}::BIGINT" if name == "cred_theft" else "NULL::BIGINT"
            ha = f"{int(s['hosts_add'])}::BIGINT" if name == "lateral" else "NULL::BIGINT"
            tgts.append(
                f"SELECT user_id, {START + off} + i AS day, '{name}' AS t_type, {mult} AS t_mult, "
                f"NULL::BIGINT AS t_bytes, {la} AS t_logins, {fa} AS t_fails, {ha} AS t_hosts "
                f"FROM vic, {rng} WHERE attack_type = '{name}'")
    if not tgts:
        tgts.append("SELECT NULL::BIGINT AS user_id, NULL::INTEGER AS day, NULL AS t_type, "
                    "NULL::DOUBLE AS t_mult, NULL::BIGINT AS t_bytes, NULL::BIGINT AS t_logins, "
                    "NULL::BIGINT AS t_fails, NULL::BIGINT AS t_hosts WHERE FALSE")
    parts.append("tg AS (" + " UNION ALL ".join(
        f"SELECT * FROM ({t})" for t in tgts) + ")")
    parts.append(
        "att AS (SELECT ud.user_id, ud.\"group\", ud.day, "
        "CASE WHEN t_mult IS NOT NULL THEN CAST(trunc(ud.bytes * t_mult) AS BIGINT) "
        "WHEN t_type = 'slow_ramp' THEN t_bytes ELSE ud.bytes END AS bytes, "
        "ud.logins + coalesce(t_logins, 0) AS logins, ud.hosts + coalesce(t_hosts, 0) AS hosts, "
        "ud.fails + coalesce(t_fails, 0) AS fails, "
        "(ud.is_anomaly OR t_type IS NOT NULL) AS is_anomaly, "
        "CASE WHEN t_type IS NOT NULL THEN t_type ELSE ud.anomaly_type END AS anomaly_type "
        "FROM ud LEFT JOIN tg ON ud.user_id = tg.user_id AND ud.day = tg.day)")
    return ",\n".join(parts)


def _sql_overlay(name: str | None) -> str:
    scen = EVENTS_SCENARIOS if name is None else tuple(s for s in EVENTS_SCENARIOS
                                                      if s["name"] == name)
    return f"WITH {_sql_user_day()},\n{_sql_scenarios(scen)}\nSELECT * FROM att"


def _sql_scored() -> str:
    """CTE ``sc``: attacked rows scored by |bytes_z_self|."""
    return (f"{_sql_user_day()},\n{_sql_scenarios()},\n{_sql_self_z('att', 'sz')},\n"
            "sc AS (SELECT user_id, day, is_anomaly, anomaly_type, abs(bytes_z_self) AS score FROM sz)")


def _sql_user_level(agg: str, src: str = "sc", keys: str = "") -> str:
    fn = {"sum": "sum", "max": "max", "mean": "avg"}[agg]
    return (f"SELECT {keys}user_id, {fn}(score) AS agg_score, bool_or(coalesce(is_anomaly, FALSE)) AS is_attacker, "
            f"coalesce(arg_min(anomaly_type, day) FILTER (WHERE anomaly_type <> ''), '') AS attack_type "
            f"FROM {src} WHERE day >= {START} GROUP BY {keys}user_id")


def _sql_ranking(agg: str) -> str:
    return (f"WITH {_sql_scored()},\nul AS ({_sql_user_level(agg)})\n"
            f"SELECT user_id, {_sql_rnd('agg_score')} AS agg_score, is_attacker, attack_type, "
            f"CAST(row_number() OVER (ORDER BY agg_score DESC NULLS LAST, user_id) AS INTEGER) AS rank FROM ul")


def _sql_metrics_cte(src: str = "sc", keys: tuple = ()) -> str:
    """CTE ``met``: one wide metric row per run of ``src``."""
    p = EvalParams()
    kl = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    max_k = max(list(p.top_k_values) + [p.primary_top_k])
    ul = _sql_user_level(p.aggregation, src, kl)
    hits = ", ".join(f"count(*) FILTER (WHERE rank <= {k} AND is_attacker) AS h_{k}" for k in p.top_k_values)
    caught = ", ".join(f"count(*) FILTER (WHERE vt = '{t}') AS c_{t}" for t in p.attack_types_tracked)
    cols = []
    for k in p.top_k_values:
        cols.append(f"CAST(h_{k} AS DOUBLE) / {float(k)} AS precision_at_{k}")
    for k in p.top_k_values:
        cols.append(f"CASE WHEN (SELECT count(*) FROM vic) > 0 THEN CAST(h_{k} AS DOUBLE) / "
                    f"(SELECT count(*) FROM vic) ELSE 0.0 END AS recall_at_{k}")
    for t in p.attack_types_tracked:
        cols.append(f"CASE WHEN (SELECT count(*) FROM vic WHERE attack_type = '{t}') > 0 THEN "
                    f"CAST(coalesce(c_{t}, 0) AS DOUBLE) / (SELECT count(*) FROM vic WHERE attack_type = '{t}') "
                    f"ELSE 0.0 END AS caught_{t}")
    join_on = " AND ".join(f"hh.{k} = cc.{k}" for k in keys) if keys else "TRUE"
    sel_keys = "".join(f"hh.{k}, " for k in keys)
    return (f"ul AS ({ul}),\n"
            f"rk AS (SELECT *, row_number() OVER ({part}ORDER BY agg_score DESC NULLS LAST, user_id) AS rank FROM ul),\n"
            f"tp AS (SELECT * FROM rk WHERE rank <= {max_k}),\n"
            f"hh AS (SELECT {kl}{hits} FROM tp GROUP BY ALL),\n"
            f"cc AS (SELECT {kl}{caught} FROM (SELECT tp.*, vic.attack_type AS vt FROM tp "
            f"JOIN vic ON tp.user_id = vic.user_id WHERE rank <= {p.primary_top_k}) GROUP BY ALL),\n"
            f"met AS (SELECT {sel_keys}{', '.join(cols)} FROM hh LEFT JOIN cc ON {join_on})")


def _sql_precision_recall() -> str:
    p = EvalParams()
    from vigil.operators.evaluate import metric_columns
    cols = metric_columns(p)
    return f"WITH {_sql_scored()},\n{_sql_metrics_cte()}\nSELECT {_round_list(cols)} FROM met"


def _sql_caught_by_type() -> str:
    p = EvalParams()
    un = " UNION ALL ".join(f"SELECT '{t}' AS attack_type, {_sql_rnd('caught_' + t)} AS caught FROM met"
                            for t in p.attack_types_tracked)
    return f"WITH {_sql_scored()},\n{_sql_metrics_cte()}\n{un}"


def _sql_seed_average() -> str:
    p = EvalParams()
    from vigil.operators.evaluate import metric_columns
    seeds = list(SEEDS_FOR_AVERAGE)
    weight = ("(0.5 + CAST(CAST('0x' || substr(md5(concat_ws('|', CAST(seed AS VARCHAR), "
              "CAST(user_id AS VARCHAR), CAST(day AS VARCHAR))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)")
    per_cfg = " UNION ALL ".join(
        f"SELECT user_id, day, is_anomaly, anomaly_type, '{c}' AS config, abs({c}_z_self) AS z FROM sz"
        for c in RAW)
    scored = (f"ss0 AS ({per_cfg}),\n"
              f"ss AS (SELECT user_id, day, is_anomaly, anomaly_type, config, seed, z * {weight} AS score "
              f"FROM ss0, (SELECT unnest({seeds}) AS seed))")
    metrics = metric_columns(p) + ["n_features"]
    avg = ", ".join(f"round_even(avg(CAST({m} AS DOUBLE)), 3) AS {m}" for m in metrics)
    prim = p.primary_top_k
    priority = ["config", "n_features", f"precision_at_{prim}", f"recall_at_{prim}",
                *[f"caught_{t}" for t in p.attack_types_tracked]]
    rest = [c for c in ["config", *metrics] if c not in priority]
    return (f"WITH {_sql_user_day()},\n{_sql_scenarios()},\n{_sql_self_z('att', 'sz')},\n{scored},\n"
            f"{_sql_metrics_cte('ss', ('config', 'seed'))},\n"
            f"runs AS (SELECT *, 1 AS n_features FROM met)\n"
            f"SELECT {', '.join(priority + rest)} FROM (SELECT config, {avg} FROM runs GROUP BY config) "
            f"ORDER BY precision_at_{prim} DESC, config")


ORACLES: dict[str, str] = {
    "user_day": f"WITH {_sql_rolled()} SELECT * FROM uds",
    "user_day_grid": f"WITH {_sql_user_day()} SELECT * FROM ud",
    "users_without_group": (
        "SELECT count(*) AS users, count(*) FILTER (WHERE k IS NULL) AS users_without_group, "
        "CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS events_without_group FROM ("
        "SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1) LEFT JOIN "
        "(SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment IS NOT NULL) ON user_id = k"),
    "user_groups": f"WITH {_sql_user_day()} SELECT DISTINCT user_id, \"group\" FROM ud",
    "profile": (f"WITH {_sql_user_day()} SELECT count(*) AS rows, count(DISTINCT user_id) AS users, "
                "count(DISTINCT day) AS days, min(day) AS min_day, max(day) AS max_day FROM ud"),
    "users_per_group": (f"WITH {_sql_user_day()} SELECT \"group\", count(DISTINCT user_id) AS users "
                        "FROM ud GROUP BY 1"),
    "key_violations": (f"WITH {_sql_user_day()} SELECT user_id, day, count(*) AS rows FROM ud "
                       "GROUP BY 1, 2 HAVING count(*) > 1"),
    "days_per_user": (f"WITH {_sql_user_day()} SELECT user_id, count(DISTINCT day) AS days FROM ud "
                      "GROUP BY 1"),
    "range_checks": (f"WITH {_sql_user_day()} SELECT min(day) AS min_day, max(day) AS max_day, "
                     + ", ".join(f"count(*) FILTER (WHERE {c} < 0) AS negative_{c}" for c in RAW) + ", "
                     + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in RAW)
                     + " FROM ud"),
    **{fam: _sql_family(fam) for fam in
       ("self_z", "robust_z", "peer_z", "rolling", "diff", "ramp", "spearman")},
    "victims": f"WITH {_sql_user_day()},\n{_sql_scenarios()}\nSELECT attack_type, user_id FROM vic",
    "overlay_exfil": _sql_overlay("exfil"),
    "overlay_cred_theft": _sql_overlay("cred_theft"),
    "overlay_lateral": _sql_overlay("lateral"),
    "overlay_subtle_exfil": _sql_overlay("subtle_exfil"),
    "overlay_slow_ramp": _sql_overlay("slow_ramp"),
    "overlay_all": _sql_overlay(None),
    "labels_by_type": (f"WITH {_sql_user_day()},\n{_sql_scenarios()}\nSELECT anomaly_type, count(*) AS rows, "
                       "count(DISTINCT user_id) AS users FROM att WHERE is_anomaly GROUP BY 1"),
    "label_checks": (
        f"WITH {_sql_user_day()},\n{_sql_scenarios()},\n"
        "pu AS (SELECT user_id, count(*) AS k, min(attack_type) AS vt FROM vic GROUP BY 1),\n"
        "r AS (SELECT att.*, pu.k, pu.vt FROM att LEFT JOIN pu USING (user_id))\n"
        f"SELECT 'early_labels' AS \"check\", count(*) FILTER (WHERE is_anomaly AND day < {START}) AS violations FROM r\n"
        "UNION ALL SELECT 'wrong_type', count(*) FILTER (WHERE is_anomaly AND vt IS NOT NULL AND anomaly_type <> vt) FROM r\n"
        "UNION ALL SELECT 'unlisted_labels', count(*) FILTER (WHERE is_anomaly AND vt IS NULL) FROM r\n"
        "UNION ALL SELECT 'dirty_clean_rows', count(*) FILTER (WHERE NOT is_anomaly AND anomaly_type <> '') FROM r\n"
        "UNION ALL SELECT 'shared_victims', count(*) FILTER (WHERE k > 1) FROM pu"),
    "user_ranking_sum": _sql_ranking("sum"),
    "user_ranking_max": _sql_ranking("max"),
    "user_ranking_mean": _sql_ranking("mean"),
    "precision_recall": _sql_precision_recall(),
    "caught_by_type": _sql_caught_by_type(),
    "seed_average": _sql_seed_average(),
}
