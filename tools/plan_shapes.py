"""Print condensed physical plans (operator trees) of the key operators.

    python tools/plan_shapes.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")


def shape(df) -> str:
    df.write.format("noop").mode("overwrite").save()       # run, so adaptive plans are final
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "== Final Plan ==" in plan:
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    out = []
    for line in plan.splitlines():
        m = re.match(r"^([ :+\-|]*)(\*\(\d+\) )?([A-Za-z][A-Za-z ]*?)(\s*[\[(].*)?$", line)
        if not m:
            continue
        name = m.group(3).strip()
        detail = ""
        if name in ("Exchange",):
            detail = " " + (line.split("Exchange", 1)[1].split(",")[0].strip())
        if name.startswith("WindowGroupLimit"):
            detail = " " + ("Partial" if "Partial" in line else "Final")
        if name.startswith("FileScan"):
            detail = "".join(f" {k}: {v}" for k, v in re.findall(r"(PartitionFilters|ReadSchema): (\[.*?\](?=,)|struct<.*?>(?=$|,))", line))
        out.append(f"{m.group(1)}{m.group(2) or ''}{name}{detail}")
    return "\n".join(out)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from pyspark.sql import functions as F

    from vigil.operators.evaluate import rank_users, top_users, user_scores, user_totals
    from vigil.operators.features import compute_features
    from vigil.operators.forest import prepare_matrix, sample_rows
    from vigil.operators.scenarios import plant, scenario_table
    from vigil.operators.sweep import config_columns, score_all_runs, union_columns
    from vigil.params import AnalysisParams
    from vigil.plans.catalog import _activity
    from vigil.session import default_session, materialize, scratch_path
    from vigil.sources import tables
    from vigil.sources.activity import activity_from_testdata

    spark = default_session()
    p = AnalysisParams()
    act = _activity(spark, sf)
    att, victims = plant(act, scenario_table(spark, p.scenarios), 42, 23)
    feats = compute_features(att)
    cols = union_columns(config_columns())
    matrix = materialize(prepare_matrix(materialize(feats), cols))
    scored = feats.select("user_id", "day", "is_anomaly", "anomaly_type",
                          F.abs("bytes_z_self").alias("score"))
    users = user_scores(scored, 23)
    store = scratch_path(spark, "plan-features")
    tables.write_features(feats, store)
    _, walked = score_all_runs(materialize(feats), config_columns(), p.forest, 23)
    sections = [
        ("A2 user-day rollup (before the checkpoint)", activity_from_testdata(spark, sf)),
        ("B + D: overlay and all feature families on the checkpointed user-day table", feats),
        ("E5 forest sample (psi rows per seed and tree)", sample_rows(matrix, matrix.count(), p.forest)),
        ("E6 + F2 scoring of the test window by every forest, rolled up to (run, user)",
         user_totals(walked, 23, "sum", ("_block", "run"), keyed=True)),
        ("A4 feature store: two columns of the test window",
         tables.read_features(spark, store, ["user_id", "bytes_z_self"], 23)),
        ("F6/F7 top-K users per run", top_users(users, 100)),
        ("F6 full ranking (range sort + per-partition offsets)", rank_users(users)),
    ]
    print("# Plan shapes\n")
    print(f"Condensed physical plans from `tools/plan_shapes.py` on `{sf}` "
          "(local[8], 8 shuffle partitions, adaptive execution on; "
          "`*(n)` = whole-stage generated code).\n")
    for title, df in sections:
        print(f"## {title}\n\n```\n{shape(df)}\n```\n")


if __name__ == "__main__":
    main()
