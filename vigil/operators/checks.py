"""Parameter checks and table checks (H2–H9).

Table checks are single aggregates (or joins against the small victim
ledger), so they cost one pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.params import AGGREGATIONS, FAMILY_ORDER, AnalysisParams


def membership_rules(params: AnalysisParams, n_days: int | None = None) -> list[tuple]:
    """H2 as one table: (rule, subject, value, the values allowed)."""
    ev, computed = params.evaluation, params.features.families
    rules = [("aggregation", "evaluation", ev.aggregation, AGGREGATIONS),
             ("primary_top_k", "evaluation", ev.primary_top_k, ev.top_k_values)]
    rules += [("family_known", "features", f, FAMILY_ORDER) for f in computed]
    rules += [("family_computed", name, f, computed)
              for name, families in params.feature_sets.items() for f in families]
    if n_days is not None:
        rules.append(("test_window_start", "evaluation", ev.test_window_start, range(n_days)))
    return rules


def parameter_violations(spark: SparkSession, params: AnalysisParams, n_days: int | None = None) -> DataFrame:
    """H2: one row (rule, subject, value) per broken rule."""
    return spark.createDataFrame(
        [(rule, subject, str(value)) for rule, subject, value, allowed in membership_rules(params, n_days)
         if value not in allowed], "rule string, subject string, value string")


def validate(params: AnalysisParams, n_days: int | None = None) -> None:
    """H2: raise one error that names every broken rule."""
    broken = [f"{rule} of {subject}: {value!r}"
              for rule, subject, value, allowed in membership_rules(params, n_days) if value not in allowed]
    if broken:
        raise ValueError("; ".join(broken))


def unknown_target_groups(scenarios: DataFrame, users: DataFrame) -> DataFrame:
    """H2: scenarios whose target group has no users (left anti join)."""
    groups = users.select(F.col("group").alias("target_group")).distinct()
    return scenarios.join(groups, "target_group", "left_anti").select("name", "target_group")


def target_shortfalls(scenarios: DataFrame, users: DataFrame) -> DataFrame:
    """Per scenario the victims asked for, the users of its group and how many are missing.

    Scenarios are drawn in order, so the users that earlier attacks on the same
    group take are not there for later ones.
    """
    sizes = users.groupBy("group").agg(F.count("*").alias("users"))
    asked = scenarios.join(sizes, F.col("target_group") == F.col("group"), "left") \
        .withColumn("users", F.coalesce("users", F.lit(0))) \
        .withColumn("asked", F.coalesce(F.col("n_victims").cast("long"), F.greatest(
            F.lit(1).cast("long"), F.floor(F.col("victim_share") * F.col("users")))))
    earlier = Window.partitionBy("target_group").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)  # scenarios
    left = F.greatest(F.lit(0), F.col("users") - F.coalesce(F.sum("asked").over(earlier), F.lit(0)))
    return asked.select("ordinal", "name", "target_group", "users", "asked",
                        F.greatest(F.lit(0), F.col("asked") - left).alias("missing"))


def check_target_groups(scenarios: DataFrame, users: DataFrame) -> None:
    bad = unknown_target_groups(scenarios, users).collect()      # parameter-sized
    if bad:
        raise ValueError("no users in the group aimed at: " + ", ".join(
            f"{r['name']} -> {r['target_group']}" for r in bad))


def key_violations(activity: DataFrame) -> DataFrame:
    """H3: (user_id, day) keys that occur more than once."""
    return (activity.groupBy("user_id", "day").agg(F.count("*").alias("rows"))
            .where(F.col("rows") > 1))


def days_per_user(activity: DataFrame) -> DataFrame:
    """H3: distinct days per user."""
    return activity.groupBy("user_id").agg(F.count_distinct("day").alias("days"))


def range_checks(activity: DataFrame, raw_columns=("bytes", "logins", "hosts", "fails")) -> DataFrame:
    """H4: day range and negative-measure counts in one aggregate."""
    return activity.agg(
        F.min("day").alias("min_day"), F.max("day").alias("max_day"),
        *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in raw_columns],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in raw_columns])


def users_per_group(activity: DataFrame) -> DataFrame:
    """H5: distinct users per group."""
    return activity.groupBy("group").agg(F.count_distinct("user_id").alias("users"))


def profile(activity: DataFrame) -> DataFrame:
    """H6: rows, users, distinct days and the day range."""
    return activity.agg(
        F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"),
        F.count_distinct("day").alias("days"), F.min("day").alias("min_day"),
        F.max("day").alias("max_day"))


def labels_by_type(activity: DataFrame) -> DataFrame:
    """H7: labelled rows and users per attack type."""
    return (activity.where(F.col("is_anomaly"))
            .groupBy("anomaly_type")
            .agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("users")))


def label_violations(activity: DataFrame, victims: DataFrame, test_window_start: int) -> DataFrame:
    """H8: violation counts as (check, violations) rows.

    early_labels     — labelled rows before the test window
    wrong_type       — labelled rows whose type differs from the victim's attack
    unlisted_labels  — labelled rows of users that are no victim
    dirty_clean_rows — unlabelled rows with a non-empty type
    shared_victims   — users listed under more than one attack
    """
    v = victims.select("user_id", F.col("attack_type").alias("_victim_type"))
    per_user = v.groupBy("user_id").agg(F.count("*").alias("_k"), F.min("_victim_type").alias("_vt"))
    rows = activity.join(per_user, "user_id", "left")
    row_checks = rows.agg(
        F.count_if(F.col("is_anomaly") & (F.col("day") < F.lit(int(test_window_start))))
        .alias("early_labels"),
        F.count_if(F.col("is_anomaly") & F.col("_vt").isNotNull()
                   & (F.col("anomaly_type") != F.col("_vt"))).alias("wrong_type"),
        F.count_if(F.col("is_anomaly") & F.col("_vt").isNull()).alias("unlisted_labels"),
        F.count_if(~F.col("is_anomaly") & (F.col("anomaly_type") != "")).alias("dirty_clean_rows"),
    ).unpivot([], ["early_labels", "wrong_type", "unlisted_labels", "dirty_clean_rows"],
              "check", "violations")
    shared = per_user.agg(F.lit("shared_victims").alias("check"),
                          F.count_if(F.col("_k") > 1).alias("violations"))
    return row_checks.unionByName(shared)


def trajectory(activity: DataFrame, user_id: int, day_from: int, day_to: int,
               columns=("bytes", "logins", "hosts", "fails", "is_anomaly", "anomaly_type")) -> DataFrame:
    """H9: one user's rows over a day range, in day order."""
    return (activity.where((F.col("user_id") == F.lit(user_id))
                           & F.col("day").between(day_from, day_to))
            .select("user_id", "day", *columns).orderBy("day"))


def trajectories(activity: DataFrame, users: DataFrame, day_from: int, day_to: int,
                 columns=("bytes", "logins", "hosts", "fails", "is_anomaly", "anomaly_type")) -> DataFrame:
    """H9 for a table of users (``user_id`` and any labels): their rows over a day range."""
    return activity.where(F.col("day").between(day_from, day_to)).select("user_id", "day", *columns) \
        .join(users, "user_id")
