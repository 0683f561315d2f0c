"""Operator 2 — benchmark decontamination by SimHash item-sized windows.

A benchmark item of L words is compared with windows of L words of the
documents.  Only a window that shares a word shingle with an item of its size
can reach the similarity, so windows are laid where shared shingles line up and
at every start between two such places; all others score zero.  Each distinct
window is fingerprinted with a 64-bit SimHash; 8 blocks of 8 bits, each indexed
with all values within 2 bits, find every item of that size within Hamming
distance 23 (24 differences over 8 blocks leave one block with at most 2).  The
survivors are verified by weighted Jaccard similarity of their shingles,
weights being the multiplicities.

Words are runs of letters and digits in lower case; a shingle is five words, or
all words of a shorter item.  Defined results: null, empty and too short texts
are clean; items without words match nothing; equal texts share one result;
equal items are reported under each of their ids; null item ids are dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import fresh, stored

SHINGLE = 5
SIMILARITY = 0.75
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: rows of the item shingle table (three longs each) up to which it is broadcast
BROADCAST_SHINGLES = 2_000_000


def words(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles(w: str, k: int):
    """xxhash64 of every run of k words of the array column ``w`` (empty if shorter)."""
    run = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return F.expr(f"if(size({w}) < {k}, cast(array() as array<bigint>), "
                  f"transform(sequence(0, size({w}) - {k}), i -> xxhash64({run})))")


def simhash(sh: str):
    """64-bit SimHash of an array of hashes; two 32-bit counters share one long, and
    a bit is set where over half of the shingles have it."""
    lanes = [f"aggregate({sh}, 0L, (a, x) -> a + (shiftrightunsigned(x, {b}) & 4294967297L))"
             for b in range(32)]
    low = [f"if(2 * (c[{b}] & 4294967295L) > size({sh}), {1 << b}L, 0L)" for b in range(32)]
    high = [f"if(2 * shiftrightunsigned(c[{b}], 32) > size({sh}), shiftleft(1L, {32 + b}), 0L)"
            for b in range(32)]
    return F.expr(f"transform(array(array({', '.join(lanes)})), c -> {' | '.join(low + high)})[0]")


def tagged(sh: str):
    """Sorted array of (hash, occurrence number): sets whose overlaps count multiplicities."""
    return F.expr(f"transform(array(array_sort({sh})), s -> transform(s, (x, i) -> "
                  f"xxhash64(x, i - array_position(s, x))))[0]")


def near_values() -> list[int]:
    """All masks of at most BLOCK_RADIUS bits of a block."""
    return sorted(sum(1 << b for b in bits) for r in range(BLOCK_RADIUS + 1)
                  for bits in combinations(range(BLOCK_BITS), r))


def _blocks(df: DataFrame, spread: bool) -> DataFrame:
    """One row per (block number, block value) of ``fp``; with ``spread`` also of the near values."""
    value = f"cast(shiftrightunsigned(fp, b * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} as int)"
    out = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))) \
            .withColumn("v", F.expr(value))
    if spread:
        out = out.withColumn("m", F.explode(F.array(*map(F.lit, near_values())))) \
                 .withColumn("v", F.expr("v ^ m")).drop("m")
    return out


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text",
                  similarity: float = SIMILARITY) -> DataFrame:
    """(k1, k2, item_id, similarity) for every distinct text and item found in it."""
    it = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")) \
              .where("item_id IS NOT NULL AND size(w) > 0")
    it = stored(it.withColumn("l", F.size("w")).withColumn("k", F.least("l", F.lit(SHINGLE))), "items")
    kinds = [r.k for r in it.select("k").distinct().orderBy("k").collect()]      # 1 to 5 at most
    texts = docs.select(F.xxhash64(text_col).alias("k1"), F.xxhash64(text_col, F.lit(1)).alias("k2"),
                        F.col(text_col).alias("text")).where("text IS NOT NULL")
    found = [_contaminated(texts, it.where(F.col("k") == k), k, similarity) for k in kinds]
    if not found:
        return texts.limit(0).select("k1", "k2", F.lit(0).cast(items.schema[item_id].dataType)
                                     .alias("item_id"), F.lit(0.0).alias("similarity"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _contaminated(texts: DataFrame, it: DataFrame, k: int, similarity: float) -> DataFrame:
    it = it.withColumn("sh", shingles("w", k)).select("item_id", "l", "sh")
    seeds = it.select("l", F.posexplode("sh").alias("o", "h"))
    seeds = seeds.groupBy("h", "l", "o").agg(F.lit(1).alias("one")).drop("one")
    seeds = stored(seeds, "item-shingles")
    if seeds.count() <= BROADCAST_SHINGLES:
        seeds = F.broadcast(seeds)

    # places where an item's shingle lines up with a document's
    hits = (texts.select("k1", "k2", words(F.col("text")).alias("w"))
            .select("k1", "k2", F.size("w").alias("n"), F.posexplode(shingles("w", k)).alias("p", "h"))
            .join(seeds, "h"))
    starts = hits.groupBy("k1", "k2", "n", "l", (F.col("p") - F.col("o")).alias("start")) \
                 .agg(F.lit(1).alias("one")).drop("one")
    step = F.lead("start").over(Window.partitionBy("k1", "k2", "l").orderBy("start")) - F.col("start")
    starts = starts.withColumn("step", step).withColumn("start", F.explode(F.when(
        F.col("step") < 2 * F.col("l"), F.expr("sequence(start, start + step - 1)"))
        .otherwise(F.array("start"))))
    # a window over the edge moves inside; a text shorter than the item is one window
    places = starts.groupBy("k1", "k2").agg(F.collect_set(F.struct(
        "l", F.greatest(F.lit(0), F.least("start", F.col("n") - F.col("l"))).alias("start")))
        .alias("places"))
    places = stored(places, "windows")

    near = texts.join(places, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    near = near.select("k1", "k2", "places", words(F.col("text")).alias("w")) \
               .select("k1", "k2", "places", shingles("w", k).alias("sh"))
    windows = near.select("k1", "k2", "sh", F.explode("places").alias("at")).select(
        "k1", "k2", F.col("at.l").alias("l"), F.expr(f"slice(sh, at.start + 1, at.l - {k - 1})").alias("sh"))
    windows = stored(windows.withColumn("wid", F.xxhash64("sh", "l")), "window-shingles")
    distinct = windows.groupBy("wid", "l").agg(F.first("sh").alias("sh")) \
                      .withColumn("fp", simhash("sh"))
    distinct = stored(distinct, "window-prints")

    prints = stored(it.withColumn("fp", simhash("sh")), "item-prints")
    probe = _blocks(distinct.select("wid", "l", "fp"), spread=False)
    index = _blocks(prints.select("item_id", "l", F.col("fp").alias("fp")), spread=True) \
        .withColumnRenamed("fp", "item_fp")
    cands = (probe.join(index, ["l", "b", "v"])
             .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
             .groupBy("wid", "l", "item_id").agg(F.lit(1).alias("one")).drop("one"))
    sets = prints.select("item_id", tagged("sh").alias("item_set"))
    both = (cands.join(distinct.select("wid", "l", "sh"), ["wid", "l"]).join(sets, "item_id")
            .select("wid", "item_id", F.size("item_set").alias("n_item"), F.size("sh").alias("n_win"),
                    F.size(F.array_intersect(tagged("sh"), "item_set")).alias("common")))
    sim = F.col("common") / (F.col("n_item") + F.col("n_win") - F.col("common"))
    same = both.withColumn("similarity", sim).where(F.col("similarity") >= similarity)
    return (windows.select("k1", "k2", "wid").join(same.select("wid", "item_id", "similarity"), "wid")
            .groupBy("k1", "k2", "item_id").agg(F.max("similarity").alias("similarity")))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text",
                  similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` plus contaminated, items (ascending ids found) and similarity (the best)."""
    k1, k2, flag, ids, best = fresh(docs, "k1", "k2", "contaminated", "items", "similarity")
    found = contamination(docs, items, text_col, item_id, item_text, similarity)
    per_text = found.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("best"))
    per_text = stored(per_text, "contaminated").select(
        F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("items").alias(ids), F.col("best").alias(best))
    keyed = docs.withColumns({k1: F.xxhash64(text_col), k2: F.xxhash64(text_col, F.lit(1))})
    joined = keyed.join(per_text, [k1, k2], "left")
    empty = F.array().cast(joined.schema[ids].dataType)
    return joined.select(*docs.columns, F.col(ids).isNotNull().alias(flag),
                         F.coalesce(F.col(ids), empty).alias(ids),
                         F.coalesce(F.col(best), F.lit(0.0)).alias(best))
