"""Operator 10 — line dedup by distinct-site spread.

A line's identity is the xxhash64 of the line without surrounding blanks.  One
aggregation per line hash merges HyperLogLog sketches of its sites; lines whose
estimate is near the threshold get an exact distinct count.  A line found on at
least ``min_sites`` sites is boilerplate, one of LONG_WORDS words or more (a passage,
seldom the same by chance) on LONG_SITES sites already: its first occurrence (smallest
id, then position) stays, every other one goes, so nothing vanishes from the corpus.

Defined results: null and empty texts and blank lines pass unchanged; a null
site counts as no site; rows equal in id and text get the same result; other
columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WORD, fresh, stored

MIN_SITES = 10
#: a line of so many words is long, and boilerplate from so many sites on
LONG_WORDS, LONG_SITES = 50, 3
#: relative half-width of the band counted exactly; over 9 standard errors at lg_k 12
BAND = 0.15
LG_K = 12


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, doc key, pos, line hash, whether it is long, site of every line that is not blank."""
    base = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"),
        F.xxhash64(F.col(text_col), F.col(id_col), F.lit(1)).alias("k2"),
        F.col(site_col).cast("string").alias("site"),
        F.split(F.col(text_col), "\n", -1).alias("lines"))
    lines = base.select("id", "k1", "k2", "site", F.posexplode("lines").alias("pos", "line"))
    line = F.expr("btrim(line, ' \\t\\r')")
    # words are counted only where the line is long enough to hold them
    long = F.when(F.length(line) >= 2 * LONG_WORDS - 1, F.regexp_count(line, F.lit(WORD)) >= LONG_WORDS) \
        .otherwise(F.lit(False))
    return lines.where(line != "").select("id", "k1", "k2", "pos", F.xxhash64(line).alias("h"),
                                          long.alias("long"), "site")


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND,
                      lg_k: int = LG_K) -> DataFrame:
    """h, keep (its first occurrence) of each line on ``min_sites`` sites or more, of each
    long one on LONG_SITES or more."""
    need = F.when(F.col("long"), F.least(F.lit(min_sites), F.lit(LONG_SITES))).otherwise(F.lit(min_sites))
    sketched = lines.groupBy("h", "long").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"),
        F.min(F.struct("id", "k1", "k2", "pos")).alias("keep")).withColumn("need", need)
    spread = stored(sketched.where(F.col("estimate") >= F.col("need") * (1 - band)), "line-spread")
    near = spread.where(F.col("estimate") <= F.col("need") * (1 + band))
    exact = (lines.join(near.select("h"), "h", "left_semi").where("site IS NOT NULL")
             .groupBy("h", "site").agg(F.lit(1).alias("one"))
             .groupBy("h").agg(F.count("*").alias("sites")))
    sure = spread.where(F.col("estimate") > F.col("need") * (1 + band))
    return sure.select("h", "keep").unionByName(
        near.join(exact, "h").where(F.col("sites") >= F.col("need")).select("h", "keep"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, plus n_lines and n_removed."""
    lines = stored(line_table(docs, id_col, text_col, site_col), "lines")
    keep = boilerplate_lines(lines, min_sites)
    here = F.struct("id", "k1", "k2", "pos")
    k1, k2, gone, arr = fresh(docs, "k1", "k2", "gone", "lines")
    cut = (lines.drop("site", "long").join(keep, "h").where(~here.eqNullSafe(F.col("keep")))
           .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
           .select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(gone)))
    cut = stored(cut, "line-cuts")
    keyed = docs.withColumns({k1: F.xxhash64(F.col(id_col), F.col(text_col)),
                              k2: F.xxhash64(F.col(text_col), F.col(id_col), F.lit(1))})
    joined = keyed.join(cut, [k1, k2], "left").withColumn(arr, F.split(F.col(text_col), "\n", -1))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(
        F.col(arr), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n"))
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    return joined.select(
        *[text.alias(c) if c.lower() == text_col.lower() else F.col(c) for c in docs.columns],
        F.coalesce(F.size(arr), F.lit(0)).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_removed))
