"""Operator 13 — Merkle dataset manifest, climbed by a recursive query.

A leaf is the digest of one row.  The leaves of a tree (one language) in key order
are paired level by level up to its subroot, the subroots likewise up to the root.

*Build.*  Leaves take their positions from a range sort and the counts of earlier
partitions, so no tree is gathered in one task.  A block of ``2 ** STRIDE``
neighbouring nodes is one bounded group: its levels are built together and every
member becomes a stored node row that holds its siblings up to the top of the block
and the link to its parent row, the block's top, a member of the next storey.

*Climb.*  ``WITH RECURSIVE`` starts at every leaf (tampered ones with their changed
digest) and follows the parent links to the root; each step appends the siblings of
``STRIDE`` levels and folds the digest through them.  One row a node would repeat
the step for every level; the rows cover the same levels in a tenth of the joins.  Rows
of high nodes are stored once for every ``CHUNK`` leaves below them and the leaves
of a chunk meet their own copy, so no node row is met by an unbounded group.

Defined results: nulls count as ``-``; a null key sorts first; rows of equal key
stand by their digest, equal rows side by side, each a leaf of its own; a null
tree is one of its own before all others, not the empty text; other columns are
ignored; an empty table has no rows and no root.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import crc_of_id, stored

#: levels that a node row covers
STRIDE = 10
#: leaves that share one copy of a node row
CHUNK = 4096
#: key of the tree of subroots; keys of other trees are empty or start with "="
TOP = "top"
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "array<struct<l:binary,r:binary>>"


def record_text(*columns: Column) -> Column:
    """The digest's input: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                      for t in texts])


def digest(*columns: Column) -> Column:
    return F.sha2(record_text(*columns), 256)


def tree_key(column: Column) -> Column:
    """Null first, then bytewise; no null, so it joins."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column))


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``pos`` (0-based within its tree, by ``order``) and ``n`` (size of the tree) added."""
    keys = ["tree", *order]
    ranged = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id())
                    .withColumn("mid", F.monotonically_increasing_id()), "merkle-order")
    runs = ranged.groupBy("part", "tree").agg(F.count("*").alias("k"), F.min("mid").alias("first"))
    tree = Window.partitionBy("tree")           # one row a partition that holds the tree
    runs = stored(runs.select(
        "part", "tree", F.sum("k").over(tree).alias("n"),
        (F.sum("k").over(tree.orderBy("part")) - F.col("k") - F.col("first")).alias("shift")), "merkle-runs")
    return ranged.join(runs, ["part", "tree"]) \
        .withColumn("pos", F.col("mid") + F.col("shift")).drop("part", "mid", "shift")


def height(n: Column) -> Column:
    """Levels above ``n`` nodes, paired until one remains."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _storey(members: DataFrame, stride: int, carried: list[str]) -> DataFrame:
    """Members (tree, pos, hash, rise, ...) of one storey with ``path`` to the top of their
    block and ``up_hash``, the digest there.  ``rise``: levels left in the tree."""
    block = F.shiftright("pos", stride)
    groups = members.groupBy("tree", block.alias("up_pos"), "rise").agg(F.array_sort(F.collect_list(
        F.struct("pos", "hash", *carried))).alias("m"))            # 2 ** stride rows at most
    pair = "sha2(concat(a[2 * j], coalesce(get(a, 2 * j + 1), '')), 256)"
    above = f"transform(sequence(0, (size(a) + 1) div 2 - 1), j -> {pair.replace('a[', 'x[').replace('(a,', '(x,')})" \
        .replace("size(a)", "size(x)")
    levels = groups.withColumn("d", F.least(F.lit(stride), "rise")).withColumn("levels", F.expr(
        f"""CASE WHEN d = 0 THEN array(transform(m, v -> v.hash)) ELSE
            aggregate(sequence(1, d), array(transform(m, v -> v.hash)),
                      (acc, i) -> concat(acc, transform(slice(acc, -1, 1), x -> {above}))) END"""))
    sibling = "get(levels[i], shiftright(j, i) ^ 1)"
    path = f"""CASE WHEN d = 0 THEN CAST(array() AS {PATH}) ELSE transform(sequence(0, d - 1), i -> struct(
        CASE WHEN shiftright(j, i) % 2 = 1 THEN unhex({sibling}) END AS l,
        CASE WHEN shiftright(j, i) % 2 = 0 THEN unhex({sibling}) END AS r)) END"""
    rows = levels.select("tree", "up_pos", F.expr("levels[d][0]").alias("up_hash"), F.col("rise") - F.col("d"),
                         F.explode(F.expr(f"transform(m, (v, j) -> struct(v AS v, {path} AS path))")).alias("e"))
    return rows.toDF("tree", "up_pos", "up_hash", "up_rise", "e").select(
        "tree", "up_pos", "up_hash", "up_rise", "e.v.*", "e.path")


def _build(base: DataFrame, stride: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(member rows of every storey, tops of the trees (tree, hash, n)) of placed nodes."""
    members = base.withColumn("rise", height(F.col("n")))
    storeys, tops = [], None
    while True:
        extra = [*carried, "n"] if not storeys else ["n"]
        rows = stored(_storey(members, stride, extra), f"merkle-storey-{len(storeys)}")
        storeys.append(rows)
        above = rows.select("tree", "n", F.col("up_pos").alias("pos"), F.col("up_hash").alias("hash"),
                            F.col("up_rise").alias("rise")).distinct()
        ended = above.where("rise = 0").select("tree", "hash", "n")
        tops = ended if tops is None else tops.unionByName(ended)
        members = above.where("rise > 0")
        if members.isEmpty():
            return storeys, tops


def _copies(rows: DataFrame, stride: int, storey: int, top: bool) -> DataFrame:
    """One copy of a node row for every CHUNK leaves below it."""
    if top:
        lo, hi = F.lit(0).cast("long"), F.col("width") - 1
    else:
        lo = F.shiftleft(F.col("pos"), stride * storey)
        hi = F.least(F.shiftleft(F.col("pos") + 1, stride * storey), F.col("n")) - 1
    return rows.withColumn("chunk", F.explode(F.sequence(F.floor(lo / CHUNK), F.floor(hi / CHUNK))))


def build(leaves: DataFrame, carried: list[str], stride: int = STRIDE) -> tuple[DataFrame, DataFrame]:
    """(leaf rows, node rows) of the manifest over ``leaves`` (tree, key, hash, carried...).

    Both have path, up_tree, up_storey, up_pos (null: the root is reached), subroot
    (where the row's path ends at it) and root (likewise); leaf rows also have hash,
    chunk and the carried columns, node rows the place (tree, storey, pos, chunk)
    that links lead to.
    """
    storeys, tops = _build(placed(leaves, "key", "hash"), stride, carried)
    # the tree of subroots: tops take their positions by their tree's key
    tops = stored(tops, "merkle-tops")
    ranks = placed(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("below"), "hash",
                               F.col("n").alias("width")), "below")
    ranks = stored(ranks, "merkle-ranks")
    upper, root = _build(ranks, stride, ["width", "below"])
    widest = ranks.agg(F.max("width")).first()[0]
    rank_of = ranks.select(F.col("below").alias("tree"), F.col("pos").alias("rank"), F.col("n").alias("trees"),
                           F.col("hash").alias("top"))

    def linked(rows: DataFrame, storey: int) -> DataFrame:
        """Links of member rows of a tree: on to the next storey, or over to the tree of subroots."""
        done = F.col("up_rise") == 0
        alone = done & (F.col("trees") == 1)
        return rows.join(rank_of, "tree").select(
            *rows.columns, F.when(done, F.col("top")).alias("subroot"), F.when(alone, F.col("top")).alias("root"),
            F.when(alone, F.lit(None)).when(done, F.lit(TOP)).otherwise(F.col("tree")).alias("up_tree"),
            F.when(done, F.lit(0)).otherwise(F.lit(storey + 1)).alias("up_storey"),
            F.when(done, F.col("rank")).otherwise(F.col("up_pos")).alias("to_pos"))

    shape = ["path", "up_tree", "up_storey", F.col("to_pos").alias("up_pos"), "subroot", "root"]
    leaf_rows = linked(storeys[0], 0).select("hash", F.floor(F.col("pos") / CHUNK).alias("chunk"), *carried, *shape)
    place = ["tree", "storey", "pos", "chunk"]
    nodes = [linked(_copies(r, stride, k, False), k).withColumn("storey", F.lit(k)).select(*place, *shape)
             for k, r in enumerate(storeys) if k]
    for k, r in enumerate(upper):
        done = F.col("up_rise") == 0
        if k:
            r = r.withColumn("width", F.lit(widest).cast("long"))
        nodes.append(_copies(r, stride, k, True).select(
            "tree", F.lit(k).alias("storey"), "pos", "chunk", "path",
            F.when(~done, F.lit(TOP)).alias("up_tree"), F.lit(k + 1).alias("up_storey"), "up_pos",
            F.lit(None).cast("string").alias("subroot"), F.when(done, F.col("up_hash")).alias("root")))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return stored(leaf_rows, "merkle-leaves"), stored(out, "merkle-nodes")


@contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def climb(leaf_rows: DataFrame, node_rows: DataFrame, start: str, carried: list[str]) -> DataFrame:
    """Every leaf taken to the root: folded (from the digest in column ``start``), proof
    (the siblings' digests, level by level, left to right, as bytes), subroot, root."""
    spark = leaf_rows.sparkSession
    fold = "aggregate({p}, {a}, (a, x) -> sha2(concat(coalesce(lower(hex(x.l)), ''), a, " \
           "coalesce(lower(hex(x.r)), '')), 256))"
    proof = "aggregate({p}, {a}, (a, x) -> concat(a, coalesce(x.l, x.r, X'')))"
    kept = "".join(f"`{c}`, " for c in carried)
    sql = f"""
    WITH RECURSIVE climb MAX RECURSION LEVEL 1000 AS (
      SELECT {kept} hash, chunk, up_tree, up_storey, up_pos, subroot, root,
             {fold.format(p='path', a=f'`{start}`')} AS folded, {proof.format(p='path', a="X''")} AS proof
      FROM {{leaves}}
      UNION ALL
      SELECT {''.join(f'c.`{x}`, ' for x in carried)} c.hash, c.chunk, n.up_tree, n.up_storey, n.up_pos,
             coalesce(c.subroot, n.subroot), n.root,
             {fold.format(p='n.path', a='c.folded')}, {proof.format(p='n.path', a='c.proof')}
      FROM climb c JOIN {{nodes}} n
        ON c.up_tree = n.tree AND c.up_storey = n.storey AND c.up_pos = n.pos AND c.chunk = n.chunk)
    SELECT {kept} hash, subroot, root, folded, proof FROM climb WHERE up_tree IS NULL"""
    with _conf(spark, "spark.sql.cteRecursionRowLimit", "-1"):      # a step returns every leaf
        return stored(spark.sql(sql, leaves=leaf_rows, nodes=node_rows), "merkle-climbed")


def tampered_chars(id_col: str = "doc_id", count_col: str = "n_chars") -> Column:
    """The count that a tampered row holds: one more where 7 divides the id's crc32."""
    hit = F.coalesce(F.pmod(crc_of_id(id_col), F.lit(7)) == 0, F.lit(False))
    return F.when(hit, F.col(count_col) + 1).otherwise(F.col(count_col))


def manifest(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    fields = {c: F.col(c) for c in LEAF_COLUMNS}
    leaves = docs.select(
        tree_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("key"),
        digest(*fields.values()).alias("hash"),
        digest(*(fields | {"n_chars": tampered_chars()}).values()).alias("found"))
    leaves = stored(leaves, "merkle-digests")
    leaf_rows, node_rows = build(leaves, ["key", "found"], stride)
    out = climb(leaf_rows, node_rows, "found", ["key"])
    return out.select(F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
                      F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
                      F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
