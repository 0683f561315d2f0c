"""Labelled incident scenarios overlaid on an activity table.

A scenario table has one row per attack, in application order:

    ordinal int, name string, target_group string, n_victims int,
    victim_share double, duration_days int, start_day_offset int,
    bytes_multiplier double, logins_add long, fails_add long, hosts_add long,
    days_offset array<int>, ramp_start_multiplier double, ramp_step double

Unused fields are null.  ``n_victims`` is an absolute count; when it is null
``victim_share`` gives the count as a share of the target group's users
(floor, at least one).

Victims are drawn per attack, in order, from the target group minus users
already drawn, ordered by md5('seed|attack|user_id') — a seeded, engine
independent draw without replacement.  Every target (user, day) is then
overlaid in ONE broadcast join: victims are disjoint, so the attacks commute.
The target table is bounded by the scenario parameters (sum of victims x
attack days), which is what makes the broadcast safe.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.params import ATTACK_TYPES
from vigil.session import materialize

SCENARIO_SCHEMA = T.StructType([
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("target_group", T.StringType(), False),
    T.StructField("n_victims", T.IntegerType(), True),
    T.StructField("victim_share", T.DoubleType(), True),
    T.StructField("duration_days", T.IntegerType(), True),
    T.StructField("start_day_offset", T.IntegerType(), True),
    T.StructField("bytes_multiplier", T.DoubleType(), True),
    T.StructField("logins_add", T.LongType(), True),
    T.StructField("fails_add", T.LongType(), True),
    T.StructField("hosts_add", T.LongType(), True),
    T.StructField("days_offset", T.ArrayType(T.IntegerType()), True),
    T.StructField("ramp_start_multiplier", T.DoubleType(), True),
    T.StructField("ramp_step", T.DoubleType(), True),
])

# Attack names with an overlay rule (fixed values).
KNOWN_ATTACKS = ATTACK_TYPES


def scenario_table(spark: SparkSession, scenarios) -> DataFrame:
    """Build the (tiny, parameter-sized) scenario table from dicts."""
    rows = []
    for i, s in enumerate(scenarios):
        row = {f.name: None for f in SCENARIO_SCHEMA.fields}
        row.update({k: v for k, v in s.items() if k in row})
        row["ordinal"] = i
        if row["start_day_offset"] is None:
            row["start_day_offset"] = 0
        for k in ("bytes_multiplier", "victim_share", "ramp_start_multiplier", "ramp_step"):
            if row[k] is not None:
                row[k] = float(row[k])
        rows.append(tuple(row[f.name] for f in SCENARIO_SCHEMA.fields))
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def check_scenario_names(scenarios: DataFrame) -> None:
    """An attack without an overlay rule is an error."""
    known = F.array(*[F.lit(a) for a in KNOWN_ATTACKS])
    bad = scenarios.where(~F.array_contains(known, F.col("name"))).select("name").collect()
    if bad:
        raise ValueError(f"no overlay rule is defined for {bad[0]['name']}")


def _draw_key(seed: int) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("attack_type"),
                             F.col("user_id").cast("string")))


def victim_plan(users: DataFrame, scenarios: DataFrame) -> list[dict]:
    """Per attack, in order: victims to draw and the size of the target group.

    Parameter-sized (one row per attack), so it is collected to the driver.
    """
    rows = sorted(scenarios.select("ordinal", "name", "target_group", "duration_days", "days_offset", "n_victims",
                                   "victim_share").collect(), key=lambda r: r["ordinal"])      # one row per attack
    groups = sorted({r["target_group"] for r in rows})
    sizes = {r["group"]: int(r["n"]) for r in users.where(F.col("group").isin(groups))
             .groupBy("group").agg(F.count("*").alias("n")).collect()} if groups else {}
    plan = []
    for r in rows:
        n_days = (len(set(r["days_offset"] or [])) if r["name"] == "subtle_exfil"
                  else max(int(r["duration_days"] or 0), 0))
        size = sizes.get(r["target_group"], 0)
        n = r["n_victims"] if r["n_victims"] is not None else max(1, math.floor(r["victim_share"] * size))
        plan.append(dict(ordinal=r["ordinal"], attack_type=r["name"], n=int(n), target_group=r["target_group"],
                         group_users=size, n_days=n_days))
    return plan


#: hex digits of the draw key that are counted before anything is ranked
PREFIX_DIGITS = 4


def _cutoffs(candidates: DataFrame, wanted: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Per attack (ordinal): the key prefix that holds its last victim and the candidates before it.

    Radix selection: candidates are counted per prefix (16 ** PREFIX_DIGITS counts an attack
    at most, whatever the number of users) and the running counts meet the number wanted in one prefix.
    """
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in candidates.groupBy("ordinal", "_prefix").agg(F.count("*").alias("k")).collect():
        counts.setdefault(r["ordinal"], []).append((r["_prefix"], r["k"]))
    out = {}
    for ordinal, found in counts.items():
        before = 0
        for prefix, k in sorted(found):
            if before < wanted[ordinal] <= before + k:
                out[ordinal] = (prefix, before)
            before += k
    return out


def pick_victims(users: DataFrame, scenarios: DataFrame, seed: int,
                 validate: bool = True, plan: list[dict] | None = None) -> DataFrame:
    """Victims per attack as a table (ordinal, attack_type, user_id).

    ``users`` is the user → group dimension.  An attack takes the users of its
    group with the smallest draw keys that no earlier attack has taken.  Attacks on
    different groups cannot meet, so round r draws the r-th attack of every group; a round
    counts its candidates by key prefix, takes all before the prefix that
    holds the last victim and ranks only the few inside it, so no group is
    sorted or gathered however many victims it gives.
    """
    if validate:
        check_scenario_names(scenarios)
    plan = victim_plan(users, scenarios) if plan is None else plan
    spark = users.sparkSession
    if not plan:
        return spark.createDataFrame([], "ordinal int, attack_type string, user_id long")
    rounds: dict[int, list[dict]] = {}
    seen: dict[str, int] = {}
    for p in plan:
        g = p["target_group"]
        rounds.setdefault(seen.get(g, 0), []).append(p)
        seen[g] = seen.get(g, 0) + 1
    picked = None
    for r in sorted(rounds):
        attacks = {p["ordinal"]: p["n"] for p in rounds[r]}
        sc = spark.createDataFrame([(p["ordinal"], p["attack_type"], p["target_group"]) for p in rounds[r]],
                                   "ordinal int, attack_type string, target_group string")
        cand = users.join(F.broadcast(sc), users["group"] == sc["target_group"])
        if picked is not None:
            cand = cand.join(picked.select("user_id"), "user_id", "left_anti")
        cand = cand.select("ordinal", "attack_type", "user_id").withColumn("_key", _draw_key(seed)) \
            .withColumn("_prefix", F.conv(F.substring("_key", 1, PREFIX_DIGITS), 16, 10).cast("int"))
        cuts = _cutoffs(cand, attacks)
        # groups smaller than the attack asks for give all they have
        places = {o: cuts.get(o, (16 ** PREFIX_DIGITS, 0)) for o in attacks}
        of = lambda values: F.try_element_at(F.create_map(
            *[F.lit(int(v)) for pair in values.items() for v in pair]), F.col("ordinal"))
        last = of({o: p for o, (p, _) in places.items()})
        before = cand.where(F.col("_prefix") < last).select("ordinal", "attack_type", "user_id")
        rank = F.row_number().over(Window.partitionBy("ordinal").orderBy("_key", "user_id"))
        inside = cand.where(F.col("_prefix") == last).withColumn("_rank", rank) \
            .where(F.col("_rank") <= of({o: attacks[o] - b for o, (_, b) in places.items()})) \
            .select("ordinal", "attack_type", "user_id")
        mine = materialize(before.unionByName(inside))
        picked = mine if picked is None else picked.unionByName(mine)
        short = [p for p in rounds[r] if p["n"] > 0 and p["ordinal"] not in cuts]
        if validate and short:
            got = mine.where(F.col("ordinal") == short[0]["ordinal"]).count()
            raise ValueError(f"{short[0]['attack_type']} asks for {short[0]['n']} victims, its group offers {got}")
    return picked


def attack_targets(activity: DataFrame, scenarios: DataFrame, victims: DataFrame,
                   test_window_start: int, broadcast_victims: bool = True) -> DataFrame:
    """Every (user_id, day) an attack touches, with its overlay rule.

    Bounded by the parameters: sum over attacks of victims x attack days.
    ``broadcast_victims`` says whether victim-sized tables (the slow-ramp
    victims and their base medians) are under the broadcast bound.
    """
    hint = F.broadcast if broadcast_victims else (lambda d: d)
    start = F.lit(int(test_window_start))
    sc = scenarios.select(
        F.col("name").alias("attack_type"), "duration_days", "start_day_offset",
        "bytes_multiplier", "logins_add", "fails_add", "hosts_add", "days_offset",
        "ramp_start_multiplier", "ramp_step")
    days = (
        F.when(F.col("attack_type") == "subtle_exfil",
               F.transform(F.array_distinct(F.col("days_offset")), lambda d: start + d))
        .otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("duration_days"), F.lit(0)) - 1,
                                            F.lit(-1))),
            lambda i: start + F.coalesce(F.col("start_day_offset"), F.lit(0)) + i)))
    # sequence(0, -1) is [0, -1]; drop non-positive durations explicitly
    days = F.when((F.col("attack_type") != "subtle_exfil")
                  & (F.coalesce(F.col("duration_days"), F.lit(0)) <= 0),
                  F.array().cast("array<int>")).otherwise(days)
    tgt = (victims.select("attack_type", "user_id").join(F.broadcast(sc), "attack_type")
           .select("*", F.posexplode(days).alias("_i", "day")))

    # slow ramp: base = int(median of the user's bytes before the window)
    ramp_users = tgt.where(F.col("attack_type") == "slow_ramp").select("user_id").distinct()
    base = (activity.where(F.col("day") < start).select("user_id", "bytes")
            .join(hint(ramp_users), "user_id", "left_semi")
            .groupBy("user_id")
            .agg(F.percentile(F.col("bytes").cast("double"), 0.5).alias("_median"))
            .select("user_id", F.col("_median").cast("long").alias("_ramp_base")))
    tgt = tgt.join(hint(base), "user_id", "left")
    ramp_bytes = (F.col("_ramp_base")
                  * (F.col("ramp_start_multiplier") + F.col("ramp_step") * F.col("_i"))).cast("long")
    return tgt.select(
        "user_id", F.col("day").cast("int").alias("day"), "attack_type",
        F.when(F.col("attack_type").isin("exfil", "subtle_exfil"), F.col("bytes_multiplier"))
        .alias("_t_mult"),
        F.when(F.col("attack_type") == "slow_ramp", ramp_bytes).alias("_t_bytes"),
        F.when(F.col("attack_type") == "cred_theft", F.col("logins_add")).alias("_t_logins"),
        F.when(F.col("attack_type") == "cred_theft", F.col("fails_add")).alias("_t_fails"),
        F.when(F.col("attack_type") == "lateral", F.col("hosts_add")).alias("_t_hosts"),
    )


def overlay(activity: DataFrame, targets: DataFrame, broadcast_targets: bool = True) -> DataFrame:
    """Apply every target to its row in one broadcast left join.

    Rows without a target pass through unchanged; days outside the data touch
    nothing.  Touched rows get ``is_anomaly`` and ``anomaly_type``.
    """
    t = targets.withColumnRenamed("attack_type", "_t_type")
    j = activity.join(F.broadcast(t) if broadcast_targets else t, ["user_id", "day"], "left")
    hit = F.col("_t_type").isNotNull()
    bytes_ = (F.when(F.col("_t_mult").isNotNull(),
                     (F.col("bytes") * F.col("_t_mult")).cast("long"))
              .when(F.col("_t_type") == "slow_ramp", F.col("_t_bytes"))
              .otherwise(F.col("bytes")))
    cols = {
        "bytes": bytes_,
        "logins": F.col("logins") + F.coalesce(F.col("_t_logins"), F.lit(0)),
        "fails": F.col("fails") + F.coalesce(F.col("_t_fails"), F.lit(0)),
        "hosts": F.col("hosts") + F.coalesce(F.col("_t_hosts"), F.lit(0)),
        "is_anomaly": F.coalesce(F.col("is_anomaly"), F.lit(False)) | hit,
        "anomaly_type": F.when(hit, F.col("_t_type"))
        .otherwise(F.coalesce(F.col("anomaly_type"), F.lit(""))),
    }
    return j.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in activity.columns])


def plant(activity: DataFrame, scenarios: DataFrame, seed: int, test_window_start: int,
          users: DataFrame | None = None, validate: bool = True,
          max_broadcast_targets: int = 5_000_000) -> tuple[DataFrame, DataFrame]:
    """Apply every scenario; returns (overlaid activity, victims).

    The target table's size is bounded from the parameters alone (sum of
    victims x attack days); it is broadcast only under ``max_broadcast_targets``.
    """
    from vigil.sources.activity import user_groups
    users = materialize(user_groups(activity) if users is None else users)      # read by every round
    plan = victim_plan(users, scenarios)
    empty = [f"{p['attack_type']} -> {p['target_group']}" for p in plan if not p["group_users"]]
    if validate and empty:
        raise ValueError("no users in the group aimed at: " + ", ".join(empty))
    victims = pick_victims(users, scenarios, seed, validate=validate, plan=plan)
    bound = sum(p["n"] * max(p["n_days"], 1) for p in plan)
    small = bound <= max_broadcast_targets
    targets = attack_targets(activity, scenarios, victims, test_window_start,
                             broadcast_victims=small)
    return (overlay(activity, targets, broadcast_targets=small),
            victims.select("attack_type", "user_id"))
