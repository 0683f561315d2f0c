"""Feature families over the user-day table.

Plan shape (one measure list, all families):

* every per-user family is one ``select`` of window expressions sharing the
  partition ``user_id`` / order ``day`` — Catalyst merges them into a single
  Window operator over one hash exchange and one sort;
* the medians of a user's whole past are read from the user's history as arrays
  (one aggregate by user, on the partitioning that the windows use as well), in
  constant time a row; a bounded look-back (``history_rows``) takes windows;
* peer statistics are a ``groupBy(group, day)`` aggregate (partial,
  map-side) joined back on (group, day); the aggregate has one row per
  (group, day), so a peer group holding a third of all users is combined
  before the shuffle instead of landing in one window partition.  The join is
  a broadcast when the key count is under a checked bound, otherwise a
  shuffle join where AQE splits skewed partitions;
* the trailing rank correlation reads the 7-row frame as lag columns and
  ranks them with plain comparisons — compiled code, no Python, no join back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.orderstats import past_medians
from vigil.functions.stats import (
    REGRESSION_SUMS,
    TrailingRankCorrelation,
    lit,
    loo_peer_exact,
    loo_peer_float,
    q,
    regression_from_sums,
    regression_sums,
)
from vigil.params import (
    FAMILY_ORDER,
    SPEARMAN_MIN_ROWS,
    SPEARMAN_MIN_STD,
    FeatureParams,
)
from vigil.session import bounded_broadcast, ship_package

_INTEGRAL = ("bigint", "int", "smallint", "tinyint")


# ---------------------------------------------------------------- windows C*

# ------------------------------------------------------------ column naming

def family_columns(family: str, raw_columns) -> list[str]:
    """All output columns of a family, in output order."""
    out: list[str] = []
    if family == "self_z":
        for c in raw_columns:
            out += [f"{c}_mean_self", f"{c}_std_self", f"{c}_z_self"]
    elif family == "robust_z":
        out += [f"{c}_med_self" for c in raw_columns]
        for c in raw_columns:
            out += [f"{c}_mad_self", f"{c}_rz_self"]
    elif family == "peer_z":
        for c in raw_columns:
            out += [f"{c}_mean_peer_loo", f"{c}_std_peer_loo", f"{c}_z_peer_loo"]
    elif family == "rolling":
        for c in raw_columns:
            out += [f"{c}_roll7_max", f"{c}_roll7_mean", f"{c}_roll7_std"]
    elif family == "diff":
        for c in raw_columns:
            out += [f"{c}_diff1", f"{c}_pct1"]
    elif family == "ramp":
        for c in raw_columns:
            out += [f"{c}_ramp_slope", f"{c}_ramp_r2", f"{c}_ramp_signal"]
    elif family == "spearman":
        for c in raw_columns:
            out += [f"{c}_spearman", f"{c}_spearman_pos"]
    else:
        raise ValueError(f"Unknown feature family: {family!r}. Known: {list(FAMILY_ORDER)}")
    return out


def _check_families(families) -> list[str]:
    fams = list(families)
    for f in fams:
        if f not in FAMILY_ORDER:
            raise ValueError(f"Unknown feature family: {f!r}. Known: {list(FAMILY_ORDER)}")
    return [f for f in FAMILY_ORDER if f in fams]   # fixed dispatch order


# ------------------------------------------------------------------ builder

def _frame(lo: str, hi: str) -> str:
    return f"(PARTITION BY `user_id` ORDER BY `day` ROWS BETWEEN {lo} AND {hi})"


def compute_features(activity: DataFrame, params: FeatureParams = FeatureParams(),
                     families=None) -> DataFrame:
    """Add every enabled family's columns to the activity table.

    Row count and input columns are preserved; families are applied in the
    fixed order self_z, robust_z, peer_z, rolling, diff, ramp, spearman.

    The plan is built from a fixed number of projections — L1 windows → peer
    join → L2 (MAD window, level-1 arithmetic) → L3 → final — each given
    as SQL text (one driver→JVM call per projection; see functions.stats).
    """
    fams = _check_families(params.families if families is None else families)
    raw = list(params.raw_columns)
    eps = lit(params.epsilon)
    base_cols = list(activity.columns)
    dtypes = dict(activity.dtypes)
    integral = {c: dtypes.get(c) in _INTEGRAL for c in raw}

    past_lo = ("UNBOUNDED PRECEDING" if params.history_rows is None
               else f"{int(params.history_rows)} PRECEDING")
    w_past = _frame(past_lo, "1 PRECEDING")
    w_roll = _frame(f"{int(params.rolling_window)} PRECEDING", "1 PRECEDING")
    w_ramp = _frame(f"{int(params.ramp_window) - 1} PRECEDING", "CURRENT ROW")
    w_lag = "(PARTITION BY `user_id` ORDER BY `day`)"
    n_sp = int(params.spearman_window)
    spear = {c: TrailingRankCorrelation(f"{c}_sp", n_sp, SPEARMAN_MIN_ROWS, SPEARMAN_MIN_STD)
             for c in raw}

    def xd(c: str) -> str:
        return f"CAST({q(c)} AS DOUBLE)"

    def lag_cols(c: str) -> list[str]:
        return [q(f"_{c}_lag_{j}") for j in range(n_sp - 1, 0, -1)] + [xd(c)]

    df = activity
    whole_past = params.history_rows is None
    if "robust_z" in fams and whole_past:
        df = _join_past_medians(df, raw, dtypes)
    # ---- L1: plain user windows (one Window operator, one sort)
    l1: list[str] = []
    for c in raw:
        if "self_z" in fams:
            l1 += [f"avg({xd(c)}) OVER {w_past} AS {q(c + '_mean_self')}",
                   f"stddev_samp({xd(c)}) OVER {w_past} AS {q(c + '_std_self')}"]
        if "robust_z" in fams and not whole_past:
            l1.append(f"percentile_approx({q(c)}, 0.5) OVER {w_past} AS {q(c + '_med_self')}")
        if "rolling" in fams:
            l1 += [f"max({xd(c)}) OVER {w_roll} AS {q(c + '_roll7_max')}",
                   f"avg({xd(c)}) OVER {w_roll} AS {q(c + '_roll7_mean')}",
                   f"stddev_samp({xd(c)}) OVER {w_roll} AS {q(c + '_roll7_std')}"]
        if "diff" in fams:
            l1.append(f"lag({xd(c)}, 1) OVER {w_lag} AS {q(f'_{c}_lag1')}")
        if "ramp" in fams:
            if integral[c]:
                l1 += [f"{e} OVER {w_ramp} AS {q(f'_{c}_rg_{k}')}"
                       for k, e in regression_sums(q(c), q("day")).items()]
            else:
                day_d = "CAST(`day` AS DOUBLE)"
                l1 += [f"regr_slope({xd(c)}, {day_d}) OVER {w_ramp} AS {q(c + '_ramp_slope')}",
                       f"regr_r2({xd(c)}, {day_d}) OVER {w_ramp} AS {q(c + '_ramp_r2')}"]
        if "spearman" in fams:
            # the trailing frame as lag columns, oldest first
            l1 += [f"lag({xd(c)}, {j}) OVER {w_lag} AS {q(f'_{c}_lag_{j}')}"
                   for j in range(n_sp - 1, 0, -1)]
    if "spearman" in fams:
        l1.append(f"count(1) OVER {_frame(f'{n_sp - 1} PRECEDING', 'CURRENT ROW')} AS `_sp_rows`")
    if l1:
        df = df.selectExpr("*", *l1)

    # ---- peers: (group, day) sums of the input, joined after the first Window
    # so the user sort carries narrow rows (a broadcast join keeps the order)
    if "peer_z" in fams:
        df = _join_peer_stats(df, activity, raw, dtypes, params)

    # ---- L2: window over a level-1 column (robust MAD) + level-1 arithmetic
    l2: list[str] = []
    for c in raw:
        if "self_z" in fams:
            l2.append(f"({xd(c)} - {q(c + '_mean_self')}) / ({q(c + '_std_self')} + {eps}) "
                      f"AS {q(c + '_z_self')}")
        if "robust_z" in fams:
            # each past row's deviation is taken from that row's own median
            mad = q(f"_{c}_dev") if whole_past else \
                f"percentile_approx(abs({xd(c)} - {q(c + '_med_self')}), 0.5) OVER {w_past}"
            l2.append(f"{lit(params.mad_constant)} * {mad} AS {q(c + '_mad_self')}")
        if "peer_z" in fams:
            mean, std = _peer_loo(c, integral[c])
            l2 += [f"{mean} AS {q(c + '_mean_peer_loo')}", f"{std} AS {q(c + '_std_peer_loo')}"]
        if "diff" in fams:
            lag = q(f"_{c}_lag1")
            l2 += [f"{xd(c)} - {lag} AS {q(c + '_diff1')}",
                   f"({xd(c)} - {lag}) / (abs({lag}) + {eps}) AS {q(c + '_pct1')}"]
        if "ramp" in fams and integral[c]:
            slope, r2 = regression_from_sums(*[q(f"_{c}_rg_{k}") for k in REGRESSION_SUMS])
            l2 += [f"{slope} AS {q(c + '_ramp_slope')}", f"{r2} AS {q(c + '_ramp_r2')}"]
        if "spearman" in fams:
            l2 += spear[c].stage1(lag_cols(c))
    if l2:
        df = df.selectExpr("*", *l2)

    # ---- L3: arithmetic on level-2 columns
    l3: list[str] = []
    for c in raw:
        if "robust_z" in fams:
            l3.append(f"({xd(c)} - {q(c + '_med_self')}) / ({q(c + '_mad_self')} + {eps}) "
                      f"AS {q(c + '_rz_self')}")
        if "peer_z" in fams:
            l3.append(f"({xd(c)} - {q(c + '_mean_peer_loo')}) / ({q(c + '_std_peer_loo')} + {eps}) "
                      f"AS {q(c + '_z_peer_loo')}")
        if "ramp" in fams:
            l3.append(f"CASE WHEN {q(c + '_ramp_slope')} > 0 THEN {q(c + '_ramp_r2')} ELSE 0.0D END "
                      f"AS {q(c + '_ramp_signal')}")
        if "spearman" in fams:
            l3 += spear[c].stage2(lag_cols(c))
    if l3:
        df = df.selectExpr("*", *l3)

    # ---- final projection: input columns, then each family's columns
    final: list[str] = [q(c) for c in base_cols]
    for f in fams:
        for name in family_columns(f, raw):
            if f == "spearman":
                pos = name.endswith("_pos")
                c = name[: -len("_spearman_pos")] if pos else name[: -len("_spearman")]
                rho = spear[c].result("`_sp_rows`")
                final.append(f"{f'greatest({rho}, 0.0D)' if pos else rho} AS {q(name)}")
            else:
                final.append(q(name))
    return df.selectExpr(*final)


def _join_past_medians(df: DataFrame, raw, dtypes) -> DataFrame:
    """``df`` with the lower median of each measure's past and of its past deviations.

    A user has one row a day, so a history is a short array; it is collected and
    unfolded without leaving the user's partition."""
    ship_package(df.sparkSession)
    rest = [c for c in df.columns if c != "user_id"]
    users = df.groupBy("user_id").agg(F.collect_list(F.struct(*[q(c) for c in rest])).alias("_rows"))
    found = []
    for c in raw:
        kind = dtypes[c] if dtypes[c] in _INTEGRAL else "double"
        values = F.col(f"_rows.{q(c)}").cast(f"array<{kind}>")
        found.append(past_medians(kind)(F.col("_rows.day").cast("array<bigint>"), values).alias(f"_{c}_past"))
    zipped = users.select("user_id", "_rows", *found).selectExpr(
        "user_id", "_rows", *[f"{q(f'_{c}_past')}.{m} AS {q(f'_{c}_{m}')}" for c in raw for m in ("med", "mad")])
    rows = zipped.selectExpr("user_id", "inline(arrays_zip(_rows, "
                             + ", ".join(q(f"_{c}_{m}") for c in raw for m in ("med", "mad")) + "))")
    return rows.selectExpr("user_id", *[f"_rows.{q(c)}" for c in rest],
                           *[f"CAST({q(f'_{c}_med')} AS {dtypes[c]}) AS {q(c + '_med_self')}" for c in raw],
                           *[f"{q(f'_{c}_mad')} AS {q(f'_{c}_dev')}" for c in raw])


def peer_statistics(activity: DataFrame, raw_columns, dtypes=None) -> DataFrame:
    """Per (group, day): non-null count and sums of every measure."""
    dtypes = dtypes or dict(activity.dtypes)
    aggs: list[Column] = []
    for c in raw_columns:
        aggs.append(F.count(c).alias(f"_{c}_n"))
        if dtypes[c] in _INTEGRAL:
            xdec = F.col(c).cast("decimal(38,0)")
            aggs += [F.sum(xdec).alias(f"_{c}_s1"),
                     F.try_sum(xdec * xdec).alias(f"_{c}_s2"),
                     F.sum(F.col(c).cast("double")).alias(f"_{c}_s1d"),
                     F.sum(F.col(c).cast("double") * F.col(c).cast("double")).alias(f"_{c}_s2d")]
        else:
            aggs += [F.avg(F.col(c).cast("double")).alias(f"_{c}_mean"),
                     (F.var_pop(F.col(c).cast("double")) * F.count(c)).alias(f"_{c}_m2")]
    return activity.groupBy("group", "day").agg(*aggs)


def _join_peer_stats(df: DataFrame, source: DataFrame, raw, dtypes,
                     params: FeatureParams) -> DataFrame:
    stats = peer_statistics(source.select("group", "day", *raw), raw, dtypes)
    stats, _ = bounded_broadcast(stats, params.peer_broadcast_max_keys)
    return df.join(stats, ["group", "day"], "left")


def _peer_loo(c: str, integral: bool) -> tuple[str, str]:
    n = q(f"_{c}_n")
    if integral:
        return loo_peer_exact(q(c), n, q(f"_{c}_s1"), q(f"_{c}_s2"),
                              q(f"_{c}_s1d"), q(f"_{c}_s2d"))
    return loo_peer_float(q(c), n, q(f"_{c}_mean"), q(f"_{c}_m2"))
