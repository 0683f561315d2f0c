"""Persisted tables of a run.

Everything is Parquet (CSV only for the human-readable summary); there are
no pickles or local files: paths are expected to be on shared storage.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VICTIMS_SCHEMA = T.StructType([
    T.StructField("attack_type", T.StringType(), False),
    T.StructField("user_id", T.LongType(), False),
])

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("config", T.StringType(), False),
    T.StructField("seed", T.IntegerType(), False),
    T.StructField("n_features", T.IntegerType(), False),
    T.StructField("algorithm", T.StringType(), False),
    T.StructField("n_estimators", T.IntegerType(), False),
    T.StructField("max_samples", T.IntegerType(), False),
    T.StructField("aggregation", T.StringType(), False),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False),
])


MANIFEST_SCHEMA = "fingerprint string, parameters string, inputs string"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _hadoop_path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _success(spark: SparkSession, path: str) -> bool:
    """Whether a table's last write came to its end."""
    return _hadoop_path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def input_state(tables: list[DataFrame]) -> list[tuple[str, int, int]]:
    """Path, length and time of every file that the tables read, by path."""
    out = []
    for df in tables:
        for name in df.inputFiles():
            fs, p = _hadoop(df.sparkSession, name)
            status = fs.getFileStatus(p)
            out.append((name, int(status.getLen()), int(status.getModificationTime())))
    return sorted(out)


def fingerprint(parameters, tables: list[DataFrame]) -> tuple[str, str, str]:
    """A5: (digest, parameters, inputs) of a computation: same digest, same result."""
    plain = asdict(parameters) if is_dataclass(parameters) else parameters
    said = json.dumps(plain, sort_keys=True, default=str), json.dumps(input_state(tables))
    return hashlib.sha256("\n".join(said).encode()).hexdigest(), *said


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def stamp(spark: SparkSession, path: str, mark: tuple[str, str, str] | None) -> None:
    """A5: record what the table at ``path`` was made from; None: nothing valid is there."""
    spark.createDataFrame([mark or ("", "", "")], MANIFEST_SCHEMA).coalesce(1) \
        .write.mode("overwrite").parquet(_manifest(path))


def has_cached(spark: SparkSession, path: str, mark: tuple[str, str, str]) -> bool:
    """A5: whether the table at ``path`` is whole and was made from these parameters and inputs."""
    if not _success(spark, path) or not _success(spark, _manifest(path)):
        return False
    row = spark.read.schema(MANIFEST_SCHEMA).parquet(_manifest(path)).first()
    return row is not None and row["fingerprint"] == mark[0]


def write_features(features: DataFrame, path: str, days: tuple[int, int] | None = None) -> None:
    """A4: write the feature table, one folder a day.

    With ``days`` (first, last) only those days are written, each replaced whole
    (dynamic partition overwrite), and the others stay.  Rows are dealt by day and user
    first, so a day is a few files and no day one task.
    """
    if days is not None:
        features = features.where(F.col("day").between(*days))
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = features.repartition(parts, "day", F.pmod(F.xxhash64("user_id"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static" if days is None else "dynamic") \
        .partitionBy("day").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None,
                  from_day: int | None = None) -> DataFrame:
    """The stored features; ``columns`` are pruned in the scan, days by their folders."""
    out = spark.read.parquet(path).withColumn("day", F.col("day").cast("int"))
    if from_day is not None:
        out = out.where(F.col("day") >= F.lit(int(from_day)))
    return out if columns is None else out.select(*columns)


def features_or_compute(spark: SparkSession, path: str, mark: tuple[str, str, str], compute) -> DataFrame:
    """A5: the stored feature table if its stamp matches, else computed, written and stamped.

    The old stamp goes before the first file is written and the new one comes after the last,
    so a run that dies in between leaves nothing that counts as cached.
    """
    if not has_cached(spark, path, mark):
        stamp(spark, path, None)
        write_features(compute(), path)
        stamp(spark, path, mark)
    return read_features(spark, path)


def write_victims(victims: DataFrame, path: str) -> None:
    """Persist the victim ledger as a table."""
    victims.select("attack_type", "user_id").write.mode("overwrite").parquet(path)


def read_victims(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VICTIMS_SCHEMA).parquet(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """The summary has one row per feature set, so one file is fine."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def run_log(run_metrics: DataFrame, metric_columns: list[str], *, run_id: str, algorithm: str,
            n_estimators: int, max_samples: int, aggregation: str,
            tags: dict[str, str]) -> DataFrame:
    """One record per (config, seed) run: run id, params, metrics map, tags map."""
    metrics = F.create_map(*[x for m in metric_columns
                             for x in (F.lit(m), F.col(m).cast("double"))])
    tag_map = (F.create_map(*[F.lit(x) for kv in sorted(tags.items()) for x in kv])
               if tags else F.create_map().cast("map<string,string>"))
    return run_metrics.select(
        F.lit(run_id).alias("run_id"),
        "config", F.col("seed").cast("int").alias("seed"),
        F.col("n_features").cast("int").alias("n_features"),
        F.lit(algorithm).alias("algorithm"),
        F.lit(n_estimators).alias("n_estimators"),
        F.lit(max_samples).alias("max_samples"),
        F.lit(aggregation).alias("aggregation"),
        metrics.alias("metrics"), tag_map.alias("tags"))


def write_run_log(log: DataFrame, path: str, run_id: str) -> None:
    """Put a run's records into the log.  A run has a folder of its own, so a retried
    run replaces what it wrote before and other runs' writers are not met."""
    log.drop("run_id").write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of all runs whose write came to its end."""
    fs, p = _hadoop(spark, path)
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    whole = [str(f) for f in found if f.getName().startswith("run_id=") and _success(spark, str(f))]
    if not whole:
        return spark.createDataFrame([], RUN_LOG_SCHEMA)
    columns = [f.name for f in RUN_LOG_SCHEMA.fields]
    stored = T.StructType([f for f in RUN_LOG_SCHEMA.fields if f.name != "run_id"] + [RUN_LOG_SCHEMA["run_id"]])
    return spark.read.schema(stored).option("basePath", path).parquet(*whole).select(*columns)
