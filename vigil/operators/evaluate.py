"""Ranking and evaluation of scored rows.

A *scored* table has the columns

    [run keys...], user_id, day, is_anomaly, anomaly_type, score

where the run keys (e.g. ``config``, ``seed``) identify independent runs;
every operator here is keyed by them, so any number of runs is evaluated in
one job.  Higher score = more anomalous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.params import AGGREGATIONS, EvalParams
from vigil.session import materialize

_AGG = {"sum": F.sum, "max": F.max, "mean": F.avg}


def check_aggregation(aggregation: str) -> None:
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation {aggregation!r} is none of {', '.join(AGGREGATIONS)}")


_KEY_RANGE = 1 << 24


def key_figures(rows: DataFrame, run_keys=()) -> DataFrame:
    """rows and key checksum (user_id, day) of a table, per run."""
    return rows.groupBy(*run_keys).agg(F.count("*").alias("rows"), F.sum(_key_part()).alias("keys"))


def _key_part() -> Column:
    return F.pmod(F.xxhash64(F.col("user_id").cast("long"), F.col("day").cast("int")), F.lit(_KEY_RANGE))


def alignment(rows: DataFrame, figures: DataFrame, run_keys=()) -> DataFrame:
    """F1: per run the table's rows, the scored rows and whether they hold the same keys.

    ``figures`` has one row a run, or one row a run and user as ``user_totals`` makes with
    ``keyed``; so the check reads what the roll-up made and no row is joined to its score.
    """
    totals = figures.groupBy(*run_keys).agg(F.sum("rows").alias("scored_rows"), F.sum("keys").alias("scored_keys"))
    return totals.join(F.broadcast(key_figures(rows)), F.lit(True)).select(        # one row
        *run_keys, "rows", "scored_rows",
        ((F.col("rows") == F.col("scored_rows")) & F.col("keys").eqNullSafe(F.col("scored_keys"))).alias("aligned"))


def check_alignment(rows: DataFrame, figures: DataFrame, run_keys=(), runs: int = 1) -> None:
    """F1: every run must have scored exactly the rows."""
    found = alignment(rows, figures, run_keys).collect()       # one row a run
    bad = [r for r in found if not r["aligned"]]
    if bad or (len(found) != runs and not rows.isEmpty()):
        raise ValueError("Score table does not match the rows: " + (
            f"{bad[0]['scored_rows']} rows scored of {bad[0]['rows']}" if bad else f"{len(found)} runs of {runs}"))


def user_totals(scored: DataFrame, test_window_start: int, aggregation: str = "sum",
                run_keys=(), keyed: bool = False) -> DataFrame:
    """Row scores of the test window rolled up to one row per (run, user).

    A hash aggregate with partial aggregation.  With ``keyed`` it also counts and
    checksums the keys of the rows it has read (see ``alignment``).
    """
    check_aggregation(aggregation)
    extra = [F.count("*").alias("rows"), F.sum(_key_part()).alias("keys")] if keyed else []
    return (scored.where(F.col("day") >= F.lit(int(test_window_start)))
            .groupBy(*run_keys, "user_id")
            .agg(_AGG[aggregation](F.col("score").cast("double")).alias("agg_score"), *extra))


def user_labels(labelled: DataFrame, test_window_start: int) -> DataFrame:
    """Attackers of the test window (user_id, is_attacker, attack_type).

    ``is_attacker`` — any anomalous row in the window; ``attack_type`` — the
    label of the earliest labelled row, '' if none.  Labels do not depend on the run, so they
    are read once, from the labelled rows of the table that carries them.
    """
    flag = F.coalesce(F.col("is_anomaly"), F.lit(False))
    first = F.when(F.col("anomaly_type") != "", F.struct("day", "anomaly_type"))
    return (labelled.where(F.col("day") >= F.lit(int(test_window_start)))
            .where(flag | (F.coalesce(F.col("anomaly_type"), F.lit("")) != ""))
            .groupBy("user_id").agg(F.bool_or(flag).alias("is_attacker"),
                                    F.coalesce(F.min(first)["anomaly_type"], F.lit("")).alias("attack_type")))


def with_labels(users: DataFrame, labels: DataFrame) -> DataFrame:
    """Label columns of every user; users without labelled rows are no attackers."""
    return users.join(labels, "user_id", "left").select(
        *users.columns, F.coalesce("is_attacker", F.lit(False)).alias("is_attacker"),
        F.coalesce("attack_type", F.lit("")).alias("attack_type"))


def user_scores(scored: DataFrame, test_window_start: int, aggregation: str = "sum",
                run_keys=(), labelled: DataFrame | None = None) -> DataFrame:
    """Score and labels of every user of every run.

    ``labelled``: the table with the labels, where it is cheaper to read than ``scored``.
    """
    users = user_totals(scored, test_window_start, aggregation, run_keys)
    return with_labels(users, user_labels(scored if labelled is None else labelled, test_window_start))


def _rank_order() -> list[Column]:
    return [F.col("agg_score").desc_nulls_last(), F.col("user_id").asc()]


def top_users(users: DataFrame, max_rank: int, run_keys=()) -> DataFrame:
    """F6 restricted to ranks <= max_rank.

    ``row_number() <= literal`` lets Spark insert a partial WindowGroupLimit,
    so each map task forwards at most ``max_rank`` users per run: the
    per-run partition after the shuffle is bounded by max_rank x map tasks,
    however many users a run has.
    """
    w = Window.partitionBy(*run_keys).orderBy(*_rank_order())
    return (users.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(int(max_rank))))


def rank_users(users: DataFrame, run_keys=()) -> DataFrame:
    """full 1-based ranking of every user of every run, distributed.

    A global sort (range partitioning on run keys, score desc, user_id) puts
    each run's users in order across partitions; each row's position inside
    its partition plus the number of the run's rows in earlier partitions
    (a table with one row per partition and run) gives its rank.  No run is
    ever gathered into one task.  Ties are broken by user_id.
    """
    ordered = (users.orderBy(*[F.col(k) for k in run_keys], *_rank_order())
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = materialize(ordered)          # fixes the partition assignment
    seg = (ordered.groupBy("_pid", *run_keys)
           .agg(F.count("*").alias("_cnt"), F.min("_mid").alias("_first")))
    before = Window.partitionBy(*run_keys).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    # one row per (partition, run): bounded by the partition count + runs
    n_parts = ordered.rdd.getNumPartitions()
    seg_b = F.broadcast(seg) if n_parts <= 1_000_000 else seg
    out = ordered.join(seg_b, ["_pid", *run_keys])
    return out.select(*run_keys, "user_id", "agg_score", "is_attacker", "attack_type",
                      (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("int")
                      .alias("rank"))


def victim_counts(victims: DataFrame) -> dict[str, int]:
    """F9 inputs: victims per attack type (one row per type, parameter-sized)."""
    return {r["attack_type"]: int(r["n"]) for r in
            victims.groupBy("attack_type").agg(F.count("*").alias("n")).collect()}


def metric_columns(params: EvalParams) -> list[str]:
    """flat metric names in record order."""
    return ([f"precision_at_{k}" for k in params.top_k_values]
            + [f"recall_at_{k}" for k in params.top_k_values]
            + [f"caught_{t}" for t in params.attack_types_tracked])


def run_metrics(top: DataFrame, victims: DataFrame, params: EvalParams,
                run_keys=()) -> DataFrame:
    """One wide row of metrics per run.

    ``top`` holds each run's users with ``rank`` <= max(K) (see ``top_users``).
    precision@K = attackers in the top K / K; recall@K = attackers in the top
    K / all victims (0 without victims); caught_T = victims of type T in the
    top primary-K / victims of type T (0 when T has none).
    """
    counts = victim_counts(victims)
    n_total = sum(counts.values())
    types = victims.groupBy("user_id").agg(F.collect_set("attack_type").alias("_types"))
    hit = lambda k: F.col("rank") <= F.lit(int(k))
    j = top.join(types, "user_id", "left").groupBy(*run_keys).agg(
        *[F.count_if(hit(k) & F.col("is_attacker")).alias(f"_hits_{k}") for k in params.top_k_values],
        *[F.count_if(hit(params.primary_top_k) & F.array_contains("_types", t)).alias(f"_caught_{t}")
          for t in params.attack_types_tracked])
    cols: list[Column] = []
    for k in params.top_k_values:
        cols.append((F.col(f"_hits_{k}") / F.lit(float(k)) if k > 0 else F.lit(0.0))
                    .cast("double").alias(f"precision_at_{k}"))
    for k in params.top_k_values:
        cols.append((F.col(f"_hits_{k}") / F.lit(float(n_total)) if n_total > 0 else F.lit(0.0))
                    .cast("double").alias(f"recall_at_{k}"))
    for t in params.attack_types_tracked:
        n_t = counts.get(t, 0)
        cols.append((F.coalesce(F.col(f"_caught_{t}"), F.lit(0)) / F.lit(float(n_t))
                     if n_t > 0 else F.lit(0.0)).cast("double").alias(f"caught_{t}"))
    return j.select(*run_keys, *cols)


def metrics_long(wide: DataFrame, params: EvalParams, run_keys=()) -> DataFrame:
    """The same metrics as (run keys, metric, value) rows."""
    return wide.unpivot(list(run_keys), metric_columns(params), "metric", "value")


def evaluate(scored: DataFrame, victims: DataFrame, params: EvalParams,
             run_keys=(), labelled: DataFrame | None = None) -> DataFrame:
    """F2–F11 for any number of runs: scored rows → wide metric rows.

    The scored table is read once where ``labelled`` brings the labels.
    """
    users = user_totals(scored, params.test_window_start, params.aggregation, run_keys)
    return evaluate_users(users, scored if labelled is None else labelled, victims, params, run_keys)


def evaluate_users(users: DataFrame, labelled: DataFrame, victims: DataFrame, params: EvalParams,
                   run_keys=()) -> DataFrame:
    """F4–F11 from the users' scores: only each run's top users meet their labels."""
    max_k = max(list(params.top_k_values) + [params.primary_top_k])
    top = with_labels(top_users(users.select(*run_keys, "user_id", "agg_score"), max_k, run_keys),
                      user_labels(labelled, params.test_window_start))
    return run_metrics(top, victims, params, run_keys)
