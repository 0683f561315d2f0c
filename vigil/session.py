"""Session-level helpers: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` (or the directory already set on the
    SparkContext).  Only when neither is set — a local test session — a
    scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="vigil-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    A checkpointed table survives executor loss (it is re-read from the
    shared folder, not recomputed).  With ``keep_partitioning`` the
    checkpoint also records the plan's hash partitioning (e.g. by
    ``user_id``), so later per-user windows and joins reuse it without an
    exchange; adaptive execution is paused for that one job because an
    adaptive plan does not report its final partitioning up front.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def bounded_broadcast(small: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast ``small`` only if it has at most ``max_rows`` rows.

    The count is taken on the (already small, aggregated) side, which is
    checkpointed so the join does not compute it again; above the bound the frame
    is returned unhinted so Spark plans a shuffle join, where AQE can split
    skewed partitions.
    """
    # checkpoint (not persist): the join then reads the small table instead of
    # recomputing it — a persisted frame is not matched when it derives from
    # the same relation as the other join side (the analyzer re-aliases it)
    small = materialize(small)
    n = small.count()
    if n <= max_rows:
        return F.broadcast(small), True
    return small, False


def default_session(master: str = "local[8]", shuffle_partitions: int = 8,
                    app: str = "vigil") -> SparkSession:
    """A local session for tests and the bench (a cluster brings its own)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vigil`` importable in Python workers (once per application).

    Grouped-map and map-in-pandas functions reference this package, so the
    workers must import it; like ``--py-files``, the package is zipped and
    distributed with ``SparkContext.addPyFile``.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="vigil-pkg-"), "vigil.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


_CLASSES: dict[tuple[str, str], object] = {}


def java_function(spark: SparkSession, source: str, name: str, returns: str) -> Callable[..., Column]:
    """A function of columns from the class ``name`` (a UDF1, UDF2, ...) of the Java file ``source``.

    The file is compiled by the compiler that Spark's own generated code goes through, once
    per application, and shipped to the executors as a jar.
    """
    sc = spark.sparkContext
    key = (sc.applicationId, source)
    if key not in _CLASSES:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        with open(source) as f:
            compiler.cook(f.read())
        stem = os.path.splitext(os.path.basename(source))[0]
        path = os.path.join(tempfile.mkdtemp(prefix="vigil-jar-"), f"vigil-{stem}.jar")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
            for cls, code in compiler.getBytecodes().items():
                zf.writestr(f"{cls.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(path)
        _CLASSES[key] = compiler.getClassLoader()
    none = lambda kind: sc._gateway.new_array(kind, 0)
    function = name.replace(".", "_").replace("$", "_").lower()
    if not spark.catalog.functionExists(function):
        made = _CLASSES[key].loadClass(name).getDeclaredConstructor(none(sc._jvm.java.lang.Class)) \
            .newInstance(none(sc._jvm.java.lang.Object))
        spark._jsparkSession.udf().register(function, made, sc._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return lambda *columns: F.call_function(function, *columns)
