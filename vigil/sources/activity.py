"""User-day activity tables (A1–A3).

The activity table has one row per (user_id, day):

    user_id long, group string, day int, bytes long, logins long,
    hosts long, fails long, is_anomaly boolean, anomaly_type string
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.params import EVENTS_DAY_ZERO, RAW_COLUMNS

ACTIVITY_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("group", T.StringType(), False),
    T.StructField("day", T.IntegerType(), False),
    T.StructField("bytes", T.LongType(), True),
    T.StructField("logins", T.LongType(), True),
    T.StructField("hosts", T.LongType(), True),
    T.StructField("fails", T.LongType(), True),
    T.StructField("is_anomaly", T.BooleanType(), True),
    T.StructField("anomaly_type", T.StringType(), True),
])

ACTIVITY_COLUMNS = [f.name for f in ACTIVITY_SCHEMA.fields]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """A1: load an activity table with the declared schema (no inference)."""
    return spark.read.schema(ACTIVITY_SCHEMA).parquet(path)


def user_day_from_events(events: DataFrame, customers: DataFrame,
                         day_zero: str = EVENTS_DAY_ZERO) -> DataFrame:
    """A2: roll raw events up to the user-day activity table.

    day    = days since ``day_zero``
    bytes  = floor of the exact decimal sum of event values
    logins = number of 'view' events, fails = number of 'error' events
    hosts  = number of distinct ``props`` values
    group  = the customer's market segment

    The aggregate is partial (map-side) for the sums and counts; the distinct
    count is planned as a (user, day, props) pre-aggregation, so a user with a
    third of all events is combined map-side before any shuffle.  The
    dimension join is left to Spark's size-based join choice (AQE may turn it
    into a broadcast at run time); the dimension grows with the data, so no
    unconditional broadcast hint.
    """
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit(day_zero)))
    rolled = (
        events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
        .select("user_id", day.alias("day"), "event_type", "value", "props")
        .groupBy("user_id", "day")
        .agg(
            F.floor(F.sum(F.col("value").cast("decimal(18,2)"))).cast("long").alias("bytes"),
            F.count_if(F.col("event_type") == "view").cast("long").alias("logins"),
            F.count_distinct("props").cast("long").alias("hosts"),
            F.count_if(F.col("event_type") == "error").cast("long").alias("fails"),
        )
    )
    groups = customers.select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("group"))
    return rolled.join(groups, "user_id", "inner").select(
        "user_id", "group", F.col("day").cast("int").alias("day"),
        "bytes", "logins", "hosts", "fails",
        F.lit(False).alias("is_anomaly"), F.lit("").alias("anomaly_type"),
    )


def event_days(events: DataFrame, day_zero: str = EVENTS_DAY_ZERO) -> tuple[int, int] | None:
    """First and last day of the event log (one narrow scan), None if it is empty."""
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit(day_zero)))
    lo, hi = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()) \
        .agg(F.min(day), F.max(day)).first()
    return None if lo is None else (lo, hi)


def complete_days(activity: DataFrame, first: int, last: int, measures=RAW_COLUMNS) -> DataFrame:
    """A2: one row for every user and day from ``first`` to ``last``.

    A day without events is a row of zeros, not a gap, so that sums over a user's days, histories and
    windows compare users by what they did and not by how often they appear.  A
    user's missing days are the day spine without the days it has (at most one
    spine a user, whatever its events); no join, and the rows there are pass through.
    """
    spine = F.sequence(F.lit(int(first)), F.lit(int(last)))
    missing = activity.groupBy("user_id").agg(F.min("group").alias("group"), F.collect_set("day").alias("_days")) \
        .select("user_id", "group", F.explode(F.array_except(spine, F.col("_days"))).alias("day"))
    zeros = missing.select("user_id", "group", "day", *[F.lit(0).cast("long").alias(c) for c in measures],
                           F.lit(False).alias("is_anomaly"), F.lit("").alias("anomaly_type"))
    return activity.unionByName(zeros)


def user_day_grid(events: DataFrame, customers: DataFrame, day_zero: str = EVENTS_DAY_ZERO) -> DataFrame:
    """A2: the complete user × day table of an event log."""
    days = event_days(events, day_zero)
    rolled = partition_by_user(user_day_from_events(events, customers, day_zero))
    return rolled if days is None else complete_days(rolled, *days)


def users_without_group(events: DataFrame, customers: DataFrame) -> DataFrame:
    """A2: users of the event log, and those (with their events) that no group claims (the roll-up leaves users out that the dimension does not hold)."""
    per_user = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()) \
        .groupBy("user_id").agg(F.count("*").alias("_events"))
    known = customers.where(F.col("c_mktsegment").isNotNull()).select(F.col("c_custkey").alias("user_id")).distinct() \
        .withColumn("_known", F.lit(True))
    out = F.col("_known").isNull()
    return per_user.join(known, "user_id", "left").agg(
        F.count("*").alias("users"), F.count_if(out).alias("users_without_group"),
        F.coalesce(F.sum(F.when(out, F.col("_events"))), F.lit(0)).alias("events_without_group"))


def activity_from_testdata(spark: SparkSession, sf_dir: str,
                           day_zero: str = EVENTS_DAY_ZERO) -> DataFrame:
    """A2 over the shipped ``events`` and ``customer`` tables: the complete grid."""
    return user_day_grid(
        read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "customer"), day_zero)


def user_groups(activity: DataFrame) -> DataFrame:
    """A3: the user → group dimension (one group per user)."""
    return activity.select("user_id", "group").distinct()


def partition_by_user(activity: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``user_id`` with an explicit partition count.

    An explicit count is not coalesced by adaptive execution, so a checkpoint
    of the result keeps advertising ``hashpartitioning(user_id, n)`` and the
    per-user windows that follow need no further exchange.  Default: the
    session's ``spark.sql.shuffle.partitions``.
    """
    n = num_partitions or int(activity.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return activity.repartition(n, "user_id")
