"""Ranking and metrics on the analytic toy scenario (6 users x 8 days)."""

import pytest
from pyspark.sql import functions as F

from vigil.operators.evaluate import (
    check_aggregation,
    check_alignment,
    evaluate,
    key_figures,
    rank_users,
    top_users,
    user_scores,
    user_totals,
)
from vigil.params import EvalParams

START = 5
PARAMS = EvalParams(test_window_start=START, top_k_values=(1, 2, 3), primary_top_k=2,
                    attack_types_tracked=("exfil", "lateral", "cred_theft"))


def _scored(spark, attackers=(0, 1)):
    rows = []
    for user in range(6):
        atype = {0: "exfil", 1: "lateral"}.get(user, "") if user in attackers else ""
        for day in range(8):
            inw = day >= START
            rows.append((user, day, bool(atype) and inw, atype if inw else "",
                         float(10 - user) if inw else 0.01))
    return spark.createDataFrame(rows, "user_id long, day int, is_anomaly boolean, "
                                       "anomaly_type string, score double")


def _victims(spark, pairs=(("exfil", 0), ("lateral", 1))):
    return spark.createDataFrame(list(pairs), "attack_type string, user_id long")


def test_unknown_aggregation_rejected():
    with pytest.raises(ValueError, match="aggregation"):
        check_aggregation("median")


def test_ranking_sorted_and_window_only(spark):
    r = rank_users(user_scores(_scored(spark), START, "sum")).orderBy("rank").collect()
    assert [x["user_id"] for x in r] == [0, 1, 2, 3, 4, 5]
    assert [x["rank"] for x in r] == [1, 2, 3, 4, 5, 6]
    assert r[0]["agg_score"] == pytest.approx(30.0)
    assert r[0]["is_attacker"] and r[0]["attack_type"] == "exfil"
    assert r[2]["attack_type"] == "" and not r[2]["is_attacker"]


def test_full_rank_equals_row_number_for_many_runs(spark):
    from pyspark.sql import functions as F
    users = spark.range(0, 5000).select(
        (F.col("id") % 7).alias("run"), F.col("id").alias("user_id"),
        (F.col("id") * 37 % 101).cast("double").alias("agg_score"),   # many ties
        F.lit(False).alias("is_attacker"), F.lit("").alias("attack_type"))
    got = rank_users(users.repartition(13), run_keys=("run",))
    exp = top_users(users, 10_000, run_keys=("run",))
    diff = got.select("run", "user_id", "rank").exceptAll(exp.select("run", "user_id", "rank"))
    assert diff.count() == 0 and got.count() == 5000


def test_precision_recall_caught(spark):
    m = evaluate(_scored(spark), _victims(spark), PARAMS).collect()[0].asDict()
    assert m["precision_at_1"] == 1.0 and m["precision_at_2"] == 1.0
    assert m["precision_at_3"] == pytest.approx(2 / 3)
    assert m["recall_at_1"] == 0.5 and m["recall_at_2"] == 1.0
    assert m["caught_exfil"] == 1.0 and m["caught_lateral"] == 1.0
    assert m["caught_cred_theft"] == 0.0                       # no victims of that type
    assert list(m)[:3] == ["precision_at_1", "precision_at_2", "precision_at_3"]


@pytest.mark.parametrize("aggregation", ["sum", "max", "mean"])
def test_all_aggregations(spark, aggregation):
    p = EvalParams(**{**PARAMS.__dict__, "aggregation": aggregation})
    m = evaluate(_scored(spark), _victims(spark), p).collect()[0]
    assert m["precision_at_2"] == 1.0


def test_recall_zero_without_attackers(spark):
    m = evaluate(_scored(spark, attackers=()), _victims(spark, ()).limit(0), PARAMS).collect()[0]
    assert m["recall_at_2"] == 0.0 and m["precision_at_2"] == 0.0


def test_precision_divides_by_k_with_few_users(spark):
    p = EvalParams(test_window_start=START, top_k_values=(10,), primary_top_k=10,
                   attack_types_tracked=("exfil",))
    m = evaluate(_scored(spark), _victims(spark), p).collect()[0]
    assert m["precision_at_10"] == pytest.approx(2 / 10)


def test_keyed_runs_in_one_job(spark):
    from pyspark.sql import functions as F
    s = _scored(spark)
    runs = s.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("seed")).withColumn(
        "score", F.when(F.col("seed") == 1, -F.col("score")).otherwise(F.col("score")))
    m = {r["seed"]: r for r in evaluate(runs, _victims(spark), PARAMS, run_keys=("seed",)).collect()}
    assert m[0]["precision_at_2"] == 1.0
    assert m[1]["precision_at_2"] == 0.0          # reversed scores put attackers last


def test_scores_must_align_with_rows(spark):
    s = _scored(spark)
    check_alignment(s, key_figures(s))
    check_alignment(s, user_totals(s, 0, "sum", keyed=True))
    with pytest.raises(ValueError, match="does not match"):
        check_alignment(s, key_figures(s.where("NOT (user_id = 3 AND day = 6)")))
    with pytest.raises(ValueError):                        # as many rows, another key
        check_alignment(s, key_figures(s.withColumn("user_id", F.expr("if(user_id = 3 AND day = 6, 99, user_id)"))))
