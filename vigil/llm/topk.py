"""Operator 8 — exact top-k search by pivot-table elimination.

Vectors become integers floor(scale * x).  Distances of every vector to a fixed set of
many pivots are computed once.  They fix the vector's place in the space that the pivots
span and its distance to that space; these are the pivot table.  The distance of two such places
bounds the distance of the vectors from below and is never less than |d(q,p) - d(x,p)| of any
pivot p: it is the maximum lower bound over the pivots taken together.  It bounds the inner
product (|q|^2 + |x|^2 - d^2) / 2 from above.  Candidates are evaluated exactly in the
order of that bound until it falls under the k-th score found (ties are
evaluated too).  Queries and candidates travel as blocks; candidate blocks are dealt
evenly, every pair of blocks is one unit of work, and the k best of each are merged.

Pivots are chosen for the tightest table of a bounded sample (PIVOT_SAMPLE rows of the
smallest hash among those under a hash rate): each is the row farthest from the space that
the ones before span, or farthest from them once they span all.  They affect speed only.  Vectors of different length
are not compared.  Defined results: vectors that are null, empty or hold a null or
non-finite component take no part, nor do rows without an id; equal rows are rows
of their own; ties go to the smaller id; other columns are ignored.  Scores must
fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import row_parallelism, stored
from vigil.session import ship_package

#: pivots: three quarters of a vector's length, this many at least
PIVOTS = 32
PIVOT_SAMPLE = 2048
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """rid, vec_id, dim, x (integers) of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                       F.transform(vector_col, lambda c: c.cast("double")).alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)
    return v.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("x").alias("dim"),
                    F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def low_hashes(v: DataFrame, sample: int = PIVOT_SAMPLE) -> DataFrame:
    """rid, dim, x of about twice ``sample`` rows of each vector length, by a hash rate from
    the counts (all rows where there are fewer), so no task ranks the whole table."""
    rate = v.groupBy("dim").agg(F.count("*").alias("n")).select(
        F.col("dim").alias("d"), F.least(F.lit(1.0), 2.0 * sample / F.col("n")).alias("rate"))
    low = F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    return v.join(F.broadcast(rate), F.col("dim") == F.col("d")).where(low).select("rid", "dim", "x")


def pick_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x (all, if fewer), each farthest from the space of those before."""
    picked = [int(np.linalg.norm(x - x.mean(axis=0), axis=1).argmax())]
    rest = x - x[picked[0]]
    near = np.linalg.norm(rest, axis=1)
    flat = 1e-6 * near.max()
    while len(picked) < min(n, len(x)):
        off = np.linalg.norm(rest, axis=1)
        at = int(off.argmax())
        if off[at] > flat:
            way = rest[at] / off[at]
            rest = rest - np.outer(rest @ way, way)
        else:
            near[picked] = -1
            at = int(near.argmax())
        picked.append(at)
        near = np.minimum(near, np.linalg.norm(x - x[at], axis=1))
    return x[picked]


def choose_pivots(v: DataFrame, n: int | None = None, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """n pivots of each vector length, from at most ``sample`` rows each."""
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("rid")))
    rows = low_hashes(v, sample).withColumn("r", rank).where(F.col("r") <= sample).select("dim", "x").collect()
    return {dim: pick_pivots(np.asarray([r.x for r in rows if r.dim == dim], dtype=np.float64),
                             n or max(PIVOTS, dim * 3 // 4)) for dim in {r.dim for r in rows}}


def pivot_table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of each row from its distances to the pivots: coordinates along the axes of
    the pivots seen from the first, the distance to their space, and the most by which
    rounding may have moved the place."""
    gaps = pivots[1:] - pivots[0]
    d2 = np.stack([((x - p) ** 2).sum(axis=1) for p in pivots.astype(np.float64)], axis=1)
    to, size, _ = np.linalg.svd(gaps, full_matrices=False)
    use = size > 1e-8 * size.max(initial=1.0)
    along = (d2[:, :1] - d2[:, 1:] + (gaps ** 2).sum(axis=1)) / 2     # inner products with the gaps
    place = along @ (to[:, use] / size[use])
    off = np.sqrt(np.maximum(d2[:, 0] - (place ** 2).sum(axis=1), 0))
    error = 1e-14 * len(pivots) * (d2.max(axis=1) + (gaps ** 2).sum(axis=1).max(initial=0)) \
        / size[use].min(initial=np.inf) + 1e-7 * np.sqrt(d2[:, 0])
    return np.column_stack([place, off, error])


def _matrix(cell: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(cell, "<i8").reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], pivots: dict, size: int) -> Iterator[pa.RecordBatch]:
    """Rows to blocks: ids, integers, and the precomputed pivot table."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for lo in range(0, len(at), size):
                part = b.take(pa.array(at[lo:lo + size]))
                x = np.asarray(part.column("x").flatten().to_numpy(), "<i8").reshape(-1, dim)
                table = pivot_table(x, pivots[int(dim)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(dim)], pa.int32()),
                     pa.array([part.column("rid").to_numpy().astype("<i8").tobytes()], pa.binary()),
                     pa.array([part.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                     pa.array([x.tobytes()], pa.binary()),
                     pa.array([np.ascontiguousarray(table, "<f8").tobytes()], pa.binary())],
                    ["dim", "rids", "ids", "x", "table"])


def search_block(q, q_rid, q_table, x, x_rid, x_id, x_table, k: int):
    """For each query (-score, id, candidate index) of its k best, by falling bound; and how
    many candidates were evaluated for each."""
    top_q, top_x = (int(max(abs(int(m.min())), abs(int(m.max())))) if m.size else 0 for m in (q, x))
    if top_q * top_x * max(q.shape[1], 1) < 1 << 53:         # sums of products are exact in doubles
        q, x = q.astype(np.float64), x.astype(np.float64)
    qn, xn = ((m.astype(np.float64) ** 2).sum(axis=1) for m in (q, x))
    (q_table, eq), (x_table, ex) = ((t[:, :-1], t[:, -1]) for t in (q_table, x_table))
    tq, tx = (q_table ** 2).sum(axis=1), (x_table ** 2).sum(axis=1)
    low2 = tq[:, None] + tx - 2 * (q_table @ x_table.T)
    low = np.sqrt(np.maximum(low2, 0))
    low = np.maximum(low - eq[:, None] - ex, 0)
    bounds = (qn[:, None] + xn - low * low) / 2
    bounds += 1e-9 * (qn[:, None] + xn + tq[:, None] + tx) + 1e-6      # floating error of the products
    out, evaluated = [], []
    for bound, one, rid in zip(bounds, q, q_rid):
        best: list[tuple[int, int, int]] = []
        left, step, seen = np.arange(len(bound)), 64, 0
        while len(left):
            if len(left) > step:                             # the highest bounds that are left
                cut = np.argpartition(-bound[left], step - 1)
                part, left = left[cut[:step]], left[cut[step:]]
            else:
                part, left = left, left[:0]
            score = x[part] @ one
            ok = x_rid[part] != rid
            part, score = part[ok], score[ok]
            top = np.lexsort((x_rid[part], x_id[part], -score))[:k]
            best = sorted(best + [(-int(score[t]), int(x_id[part[t]]), int(part[t])) for t in top])[:k]
            seen += len(part)
            step *= 2
            if len(best) == k:
                left = left[bound[left] >= -best[-1][0]]
        out.append(best)
        evaluated.append(seen)
    return out, evaluated


#: columns of the pairs found; the first row of a query and block carries their counts
FOUND = ["qrid", "query_id", "vec_id", "rid", "score", "evaluated", "met"]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            dim = r["dim"]
            x, q = _matrix(r["x"], dim), _matrix(r["qx"], dim)
            rid, vid = np.frombuffer(r["rids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            q_rid, q_id = np.frombuffer(r["qrids"], "<i8"), np.frombuffer(r["qids"], "<i8")
            table = np.frombuffer(r["table"], "<f8").reshape(len(x), -1)
            q_table = np.frombuffer(r["qtable"], "<f8").reshape(len(q), -1)
            found, evaluated = search_block(q, q_rid, q_table, x, rid, vid, table, k)
            rows = [(int(q_rid[i]), int(q_id[i]), v, int(rid[c]), -s, 0 if at else evaluated[i], 0 if at else len(x))
                    for i, best in enumerate(found) for at, (s, v, c) in enumerate(best)]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], FOUND)


def top_k(vectors: DataFrame, queries=None, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector_col: str = "embedding", share: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query row.  With
    ``share`` also evaluated_share: the part of the candidates whose score was computed."""
    spark = vectors.sparkSession
    ship_package(spark)
    queries = F.col("vec_id") % 50 == 0 if queries is None else queries
    v = stored(usable(vectors, id_col, vector_col, scale), "vectors")
    pivots = choose_pivots(v)
    kind = "dim int, rids binary, ids binary, x binary, table binary"
    cands = v.mapInArrow(partial(_blocks, pivots=pivots, size=CANDIDATE_BLOCK), kind)
    asked = v.where(queries).mapInArrow(partial(_blocks, pivots=pivots, size=QUERY_BLOCK), kind)
    n = row_parallelism(spark)
    cands = stored(cands.repartition(n).withColumn("at", F.spark_partition_id()), "candidate-blocks")
    asked = asked.toDF("dim", "qrids", "qids", "qx", "qtable") \
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = asked.join(cands, ["dim", "at"]).drop("at").mapInArrow(
        partial(_search, k=k), ", ".join(f"{c} bigint" for c in FOUND))
    best = Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id", "rid")
    more = []
    if share:
        whole = Window.partitionBy("qrid")
        found = found.withColumn("evaluated_share", F.sum("evaluated").over(whole) / F.sum("met").over(whole))
        more = ["evaluated_share"]
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *more)
