"""Isolation forest on Spark.

Algorithm (Liu, Ting & Zhou, 2008): each tree is grown on psi = min(256, N)
rows drawn without replacement; a node splits on a random non-constant
feature at a uniform threshold between the node's min and max, until depth
ceil(log2 psi) or a single row.  A row's path length in a tree is the depth
of its leaf plus c(leaf size), where c(n) is the average path length of an
unsuccessful search in a binary search tree; the anomaly score is
2 ** (-mean path / c(psi)) — higher is more anomalous.

Every draw is an md5 of its key, so the model depends on the data and the
parameters alone (not on partitions, tree blocks, other feature sets or the size
of the input) and plain SQL can repeat it.

* **sample** — a row enters every tree independently with the same rate.  Keyed
  geometric gaps walk from one tree that takes the row to the next, so a row costs one hash
  per tree it enters plus one, and a row that enters none is dropped by one
  comparison.  Each tree keeps its psi smallest keyed hashes.  A tree with
  fewer rows raises.  One law at every size; the sample does not depend on the
  feature set, so one sample per seed serves every set.
* **fit** — ``groupBy(seed, tree block).applyInPandas``: a group holds about
  block x oversample x psi rows (bounded by the parameters, not by the data) and grows every tree of
  the block for every feature set in one vectorised, level-wise pass.  Feature
  and threshold of a node come from the md5 of (seed, set, tree, node).  The
  model *is* a table with one row a tree; nodes are numbered 1, 2n, 2n + 1.
* **score** — the tree table is bounded by sets x seeds x trees rows of 2 psi
  entries; it is counted against that bound and broadcast, one row a run.  Blocks of rows are
  exploded to runs and walked down the run's trees level by level in the JVM
  (``ForestWalk.java``), without Python and without a row per tree.  Path lengths are summed in whole
  micro-units, so scores do not depend on the order of summation.
"""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.params import ForestParams
from vigil.session import java_function, materialize, ship_package

TREE_SCHEMA = ("config string, seed int, tree int, psi int, feature array<int>, threshold array<double>, "
               "size array<int>, path array<bigint>")

#: path lengths are whole numbers of this part of an edge
MICRO = 1_000_000
#: rows that are walked down a tree together
SCORE_ROWS = 512
#: rows scored in one task
PART_ROWS = 50_000
#: the classes that walk them
WALK_SOURCE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "ForestWalk.java")


def path_adjustment(n) -> np.ndarray:
    """c(n): average path length of an unsuccessful BST search over n items."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def max_depth_for(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


# ------------------------------------------------------------------ E3/E4

def prepare_matrix(features: DataFrame, columns: list[str], decimals: int | None = None,
                   keep=("user_id", "day", "is_anomaly", "anomaly_type")) -> DataFrame:
    """The feature columns as doubles with nulls (and NaN) set to 0.

    With ``decimals`` values are rounded (half to even), so that the last bits of a
    windowed mean cannot turn a comparison with a threshold.
    """
    def clean(c: str) -> Column:
        v = F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        if decimals is not None:
            scale = F.lit(10.0 ** decimals)
            v = F.rint(v * scale) / scale + F.lit(0.0)
        return v.alias(c)

    return features.select(*[k for k in keep if k in features.columns], *map(clean, columns))


# --------------------------------------------------------------------- E5

def _key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _fraction(digest: Column) -> Column:
    """Uniform in (0, 1) from the first 52 bits of a hex digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sample_rate(n_rows: int, params: ForestParams) -> float:
    """Probability that a row is drawn for a tree, before the cut to psi."""
    psi = min(params.max_samples, n_rows)
    return min(1.0, params.oversample * psi / max(n_rows, 1))


def drawn_rows(matrix: DataFrame, n_rows: int, params: ForestParams) -> DataFrame:
    """Every (seed, tree, row) drawn, with the row's columns and its hash ``_h`` in the tree.

    The k-th gap between trees that take a row is floor(ln u / ln(1 - rate)), u keyed by
    (seed, row, k): the gaps of independent draws at that rate.
    """
    rate, last = sample_rate(n_rows, params), int(params.n_trees)

    def gap(seed: Column, k: Column) -> Column:
        if rate >= 1.0:
            return F.lit(0)
        u = _fraction(_key(seed, F.col("user_id"), F.col("day"), k))
        return F.least(F.floor(F.log(u) / F.lit(math.log1p(-rate))), F.lit(last)).cast("int")

    first = [gap(F.lit(int(s)), F.lit(0)) for s in params.seeds]
    entered = F.least(*first) if len(first) > 1 else first[0]
    seeds = F.explode(F.array(*[F.struct(F.lit(int(s)).alias("seed"), g.alias("first"))
                                for s, g in zip(params.seeds, first)])).alias("_s")
    hits = matrix.where(entered < last).select("*", seeds) \
        .select(*matrix.columns, F.col("_s.seed").alias("seed"), F.col("_s.first").alias("_first")) \
        .where(F.col("_first") < last)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(last)), F.array("_first"),
        lambda seen, k: F.when(F.element_at(seen, -1) >= last, seen).otherwise(
            F.concat(seen, F.array(F.element_at(seen, -1) + 1 + gap(F.col("seed"), k)))))
    trees = hits.withColumn("tree", F.explode(F.filter(walk, lambda t: t < last))).drop("_first")
    return trees.withColumn("_h", _key(F.col("seed"), F.col("tree"), F.col("user_id"), F.col("day"), F.lit("cut")))


def sample_rows(matrix: DataFrame, n_rows: int, params: ForestParams) -> DataFrame:
    """The psi rows of every (seed, tree): the smallest hashes among those drawn."""
    psi = min(params.max_samples, n_rows)
    w = Window.partitionBy("seed", "tree").orderBy("_h", "user_id", "day")
    return (drawn_rows(matrix, n_rows, params).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= F.lit(int(psi))).drop("_rn"))


def node_draws(seed: int, config: str, trees, nodes) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers of every node from the md5 of (seed, set, tree, node)."""
    digests = [hashlib.md5(f"{seed}|{config}|{t}|{n}".encode()).hexdigest() for t, n in zip(trees, nodes)]
    return (np.array([int(h[:8], 16) for h in digests], float) / float(1 << 32),
            np.array([int(h[8:21], 16) for h in digests], float) / float(1 << 52))


def grow_trees(X: np.ndarray, root_rows: list[np.ndarray], draws,
               max_depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grow many isolation trees at once, level-wise.

    ``X`` holds sample rows in the columns of one feature set; tree r grows on the
    rows ``root_rows[r]``.  ``draws(roots, nodes)`` gives two uniform numbers a node: the first
    picks among its non-constant columns, the second the threshold in [min, max).  Rows
    go left when ``x <= threshold``.

    Returns per tree, by node number (1, children 2n and 2n + 1): the split's column,
    its threshold (infinite where the node is no split) and the node's size.
    """
    n_roots, width = len(root_rows), 1 << max_depth
    feature = np.zeros((n_roots, width), np.int32)
    threshold = np.full((n_roots, width), np.inf)
    size = np.zeros((n_roots, 2 * width), np.int32)
    lengths = np.array([len(r) for r in root_rows], np.int64)
    row = np.concatenate(root_rows) if n_roots else np.zeros(0, np.int64)
    key = np.repeat(np.arange(n_roots), lengths) * (2 * width) + 1
    size[:, 1] = lengths
    counts = size.reshape(-1)
    for _ in range(max_depth):
        live = counts[key] >= 2
        row, key = row[live], key[live]
        if not len(row):
            break
        at = np.argsort(key, kind="stable")
        row, key = row[at], key[at]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        r, n = key[starts] // (2 * width), key[starts] % (2 * width)
        values = X[row]
        lo, hi = np.minimum.reduceat(values, starts, axis=0), np.maximum.reduceat(values, starts, axis=0)
        usable = hi > lo
        many = usable.sum(axis=1)
        split = np.flatnonzero(many)
        u, v = draws(r[split], n[split])
        pick = np.floor(u * many[split])
        f = np.zeros(len(starts), np.int64)
        f[split] = (np.cumsum(usable[split], axis=1) > pick[:, None]).argmax(axis=1)
        low, high = lo[split, f[split]], hi[split, f[split]]
        t = np.full(len(starts), np.inf)
        t[split] = low + v * (high - low)
        t[split] = np.where(t[split] >= high, low, t[split])
        feature[r[split], n[split]], threshold[r[split], n[split]] = f[split], t[split]
        # rows of split nodes go on; the others stay where they are
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))
        moving = many[of] > 0
        row, key, of = row[moving], key[moving], of[moving]
        root = key // (2 * width) * (2 * width)
        key = root + 2 * (key - root) + (X[row, f[of]] > t[of])
        np.add.at(counts, key, 1)
    return feature, threshold, size


def leaf_paths(threshold: np.ndarray, size: np.ndarray, max_depth: int) -> np.ndarray:
    """Path lengths in micro-units by the place a walk of ``max_depth`` steps ends at (a walk
    that has met its leaf goes left: thresholds there are infinite)."""
    width = 1 << max_depth
    out = np.zeros((len(size), width), np.int64)
    split = np.zeros_like(size, dtype=bool)
    split[:, :width] = np.isfinite(threshold)
    tree, node = np.nonzero((size > 0) & ~split)
    depth = np.frexp(node.astype(float))[1] - 1
    paths = np.rint((depth + path_adjustment(size[tree, node])) * MICRO).astype(np.int64)
    out[tree, (node << (max_depth - depth)) - width] = paths
    return out


def make_tree_builder(config_columns: dict[str, list[str]], psi: int, trees: int, block: int):
    """Grouped-map function: rows drawn for one (seed, tree block) → one row a tree
    and feature set."""
    max_depth = max_depth_for(psi)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tree", "_h", "user_id", "day"], kind="mergesort")
        pdf = pdf.groupby("tree", sort=True).head(psi)          # psi smallest hashes per tree
        seed, first = int(pdf["seed"].iloc[0]), int(pdf["_block"].iloc[0]) * block
        wanted = np.arange(first, min(first + block, trees))
        ids, starts, counts = np.unique(pdf["tree"].to_numpy(), return_index=True, return_counts=True)
        if not np.array_equal(ids, wanted) or (counts < psi).any():
            raise RuntimeError(f"a tree of seed {seed} in {first}..{first + block - 1} drew fewer than {psi} rows; "
                               "raise oversample")
        rows = [np.arange(a, a + psi) for a in starts]
        out = []
        for name, columns in config_columns.items():
            feature, threshold, size = grow_trees(
                pdf[columns].to_numpy(dtype=float), rows,
                lambda r, n, name=name: node_draws(seed, name, ids[r], n), max_depth)
            out.append(pd.DataFrame({
                "config": name, "seed": np.int32(seed), "tree": ids.astype(np.int32), "psi": np.int32(psi),
                "feature": list(feature), "threshold": list(threshold), "size": list(size),
                "path": list(leaf_paths(threshold, size, max_depth))}))
        return pd.concat(out)

    return build


def fit_forests(matrix: DataFrame, config_columns: dict[str, list[str]],
                params: ForestParams, n_rows: int | None = None) -> DataFrame:
    """E5: one row for every tree of every (feature set, seed) forest."""
    n_rows = matrix.count() if n_rows is None else n_rows
    psi = min(params.max_samples, n_rows)
    all_cols = sorted({c for cols in config_columns.values() for c in cols})
    ship_package(matrix.sparkSession)          # the grouped-map function lives here
    drawn = drawn_rows(matrix.select("user_id", "day", *all_cols), n_rows, params)
    # trees are grown in blocks: one Python call per (seed, block) amortises
    # the per-call overhead
    step = int(params.trees_per_block)
    block = F.floor(F.col("tree") / F.lit(step)).cast("int")
    return (drawn.withColumn("_block", block).groupBy("seed", "_block")
            .applyInPandas(make_tree_builder(config_columns, psi, int(params.n_trees), step), TREE_SCHEMA))


def adjustment(n: Column) -> Column:
    """c(n) as a column."""
    m = n.cast("double")
    return F.when(m <= 1, 0.0).when(m == 2, 1.0).otherwise(
        2.0 * (F.log(m - 1.0) + F.lit(float(np.euler_gamma))) - 2.0 * (m - 1.0) / m)


def node_table(trees: DataFrame) -> DataFrame:
    """E5: the nodes (config, seed, tree, node, feature, threshold, left, right, depth, size, path);
    leaves have feature, left and right -1."""
    nodes = trees.select("config", "seed", "tree", "feature", "threshold", F.posexplode("size").alias("node", "size")) \
        .where("size > 0")
    split = F.coalesce(F.get("threshold", F.col("node")) < float("inf"), F.lit(False))
    depth = F.length(F.bin("node")) - 1
    return nodes.select(
        "config", "seed", "tree", "node",
        F.when(split, F.get("feature", F.col("node"))).otherwise(-1).alias("feature"),
        F.when(split, F.get("threshold", F.col("node"))).otherwise(0.0).alias("threshold"),
        F.when(split, 2 * F.col("node")).otherwise(-1).alias("left"),
        F.when(split, 2 * F.col("node") + 1).otherwise(-1).alias("right"),
        depth.alias("depth"), "size", (depth + adjustment(F.col("size"))).alias("path"))


# --------------------------------------------------------------------- E6

def run_table(spark, config_columns: dict[str, list[str]], params: ForestParams, columns: list[str]) -> DataFrame:
    """run, config, seed and the places of the set's columns in ``columns``: one row per run."""
    place = {c: i for i, c in enumerate(columns)}
    rows = [(i * len(params.seeds) + j, config, int(seed), [place[c] for c in cols])
            for i, (config, cols) in enumerate(config_columns.items()) for j, seed in enumerate(params.seeds)]
    return spark.createDataFrame(rows, "run int, config string, seed int, place array<int>")


def scoring_table(trees: DataFrame, runs: DataFrame, params: ForestParams) -> DataFrame:
    """Tree rows numbered ``t`` = run x trees + tree, features as places in the matrix."""
    n = int(params.n_trees)
    known = lambda a, none: F.transform(a, lambda v: F.coalesce(v, F.lit(none)))  # noqa: E731  (no null checks in a walk)
    out = trees.join(F.broadcast(runs), ["config", "seed"]).select(
        (F.col("run") * n + F.col("tree")).alias("t"), "run", "psi",
        known(F.transform("feature", lambda f: F.get(F.col("place"), f)), 0).alias("feature"),
        known("threshold", float("inf")).alias("threshold"), known("path", 0).alias("path"))
    out = materialize(out)
    expected = runs.count() * n
    if (got := out.count()) != expected:
        raise RuntimeError(f"{got} trees for {expected}")
    return out


def score_runs(matrix: DataFrame, trees: DataFrame, runs: DataFrame, params: ForestParams,
               columns: list[str], psi: int, n_rows: int) -> DataFrame:
    """(_block, user_id, day, run, score) of every row and forest, without Python.

    Users are dealt to blocks of about ``SCORE_ROWS`` rows; a block is exploded to runs, walked
    down the trees of each, and then exploded to its rows, so that a tree is read from memory once a
    block and a row leaves once a run with its sum.  Everything after that one exchange (a roll-up
    per ``_block``, run and user too) stays in its stage.  Rows with the same key share one sum.
    """
    spark = matrix.sparkSession
    pack_tree, pack_rows, walk = (java_function(spark, WALK_SOURCE, f"vigil.ForestWalk${name}", kind) for name, kind in (
        ("PackTree", "binary"), ("PackRows", "binary"), ("Walk", "array<bigint>")))
    # one row a run, counted against its bound by ``scoring_table``
    forests = materialize(trees.groupBy("run").agg(
        F.collect_list(pack_tree("feature", "threshold", "path")).alias("trees")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // PART_ROWS))
    block = F.pmod(F.xxhash64("user_id"), F.lit(max(parts, -(-n_rows // SCORE_ROWS)))).alias("_block")
    # a null goes left, and so does minus infinity
    x = F.array(*[F.coalesce(F.col(c), F.lit(float("-inf"))) for c in columns]).alias("x")
    rows = matrix.select(block, "user_id", "day", x).repartition(parts, "_block") \
        .groupBy("_block", "user_id", "day").agg(F.collect_list("x").alias("xs")) \
        .groupBy("_block").agg(F.collect_list(F.struct("user_id", "day", "xs")).alias("rows"))
    packed = rows.select(
        "_block", F.arrays_zip("rows.user_id", "rows.day").alias("keys"), pack_rows(F.col("rows.xs")).alias("packed"))
    lengths = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(runs.count() - 1))).alias("run")) \
        .join(F.broadcast(forests), "run") \
        .select("_block", "run", F.explode(F.arrays_zip("keys", walk("packed", "trees").alias("length"))).alias("row"))
    norm = float(path_adjustment(np.array([psi]))[0]) or 1.0
    return lengths.select("_block", "row.keys.user_id", "row.keys.day", "run", F.pow(
        F.lit(2.0), -(F.col("row.length") / F.lit(float(params.n_trees) * MICRO)) / F.lit(norm)).alias("score"))


def with_run_names(scored: DataFrame, runs: DataFrame) -> DataFrame:
    """config and seed for the run number."""
    return scored.join(F.broadcast(runs.select("run", "config", "seed")), "run").drop("run") \
        .select("config", "seed", "user_id", "day", "score")


# --------------------------------------------------------------------- E7

def score_summary(scored: DataFrame, run_keys=("config", "seed")) -> DataFrame:
    """Min / max / mean row score per run."""
    return scored.groupBy(*run_keys).agg(
        F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.avg("score").alias("score_mean"), F.count("*").alias("rows"))


def top_rows_by_type(scored: DataFrame, labels: DataFrame, n: int = 50, run_keys=("config", "seed")) -> DataFrame:
    """Label counts among each run's ``n`` highest-scoring rows (ties by key).

    Labels (user_id, day, anomaly_type) are joined to the top rows only.
    """
    w = Window.partitionBy(*run_keys).orderBy(F.col("score").desc(), "user_id", "day")
    top = scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.lit(n))
    top = top.select(*run_keys, "user_id", "day")              # runs x n rows
    return labels.select("user_id", "day", "anomaly_type").join(F.broadcast(top), ["user_id", "day"]) \
        .groupBy(*run_keys, "anomaly_type").agg(F.count("*").alias("rows"))
