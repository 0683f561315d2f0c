"""Operator 1 — sharding by fixed virtual slots.

Every record hashes into one of ``n_slots`` fixed virtual slots; bytes and rows
are aggregated per slot, and a versioned slot-to-shard map says where a slot
lives.  Version 0 deals slots round-robin; :func:`rebalance` writes the next
version, which holds only the edited slots.  Records never move between slots,
so a rebalance rewrites the map (``n_slots`` rows), not the hash.

Defined results: a null text has no bytes, a null id hashes like a value, equal
rows share a slot (their order inside it is immaterial), an empty table gives an
empty result with a valid map; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored

N_SLOTS = 4096
ROW_OVERHEAD = 8


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every row (texts are read once, not moved)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = docs.select(F.col(id_col).alias("doc_id"),
                      (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
                      F.crc32(text).alias("text_crc32"))
    return out.withColumn("virtual_slot", F.pmod(
        F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int"))


def slot_totals(slots: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Bytes and rows of each of the ``n_slots`` slots, empty ones included."""
    sums = slots.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    every = slots.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("b", F.lit(0)).alias("slot_bytes"),
        F.coalesce("n", F.lit(0)).alias("slot_rows"))


def first_map(totals: DataFrame, n_shards: int) -> DataFrame:
    """Version 0: slots dealt round-robin."""
    return totals.select(F.lit(0).alias("version"), "virtual_slot",
                         F.pmod("virtual_slot", F.lit(n_shards)).cast("int").alias("shard"))


def current_map(versions: DataFrame) -> DataFrame:
    """The newest entry of each slot."""
    return versions.groupBy("virtual_slot").agg(
        F.max(F.struct("version", "shard")).alias("m")).select("virtual_slot", "m.version", "m.shard")


def rebalance(versions: DataFrame, totals: DataFrame, n_shards: int) -> DataFrame:
    """The edited slots of the next map version.

    Each shard keeps its largest slots while they fit under the mean; the rest
    go, largest first, to the shard with the least bytes.  The work is on
    ``n_slots`` rows whatever the size of the data.
    """
    now = current_map(versions).join(totals, "virtual_slot")
    by_size = Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot") \
                    .rowsBetween(Window.unboundedPreceding, 0)
    ranked = now.withColumn("run", F.sum("slot_bytes").over(by_size))
    one = ranked.agg(
        F.collect_list(F.struct("slot_bytes", "virtual_slot", "shard", "run")).alias("s"),
        (F.sum("slot_bytes") / n_shards).alias("mean"), F.max("version").alias("v"))
    one = one.select(
        "v",
        F.expr(f"transform(sequence(0, {n_shards - 1}), k -> aggregate(filter(s, x -> x.shard = k "
               "AND x.run <= mean), 0L, (a, x) -> a + x.slot_bytes))").alias("loads"),
        F.expr("reverse(array_sort(filter(s, x -> x.run > mean)))").alias("pool"))
    # [0] of a one-element transform binds the least loaded shard once per slot
    placed = one.select("v", "pool", F.expr(
        """aggregate(pool, named_struct('loads', loads, 'to', cast(array() as array<int>)), (a, x) ->
             transform(array(cast(array_position(a.loads, array_min(a.loads)) as int)), m -> named_struct(
               'loads', concat(slice(a.loads, 1, m - 1), array(a.loads[m - 1] + x.slot_bytes),
                               slice(a.loads, m + 1, size(a.loads))),
               'to', array_append(a.to, m - 1)))[0]).to""").alias("to"))
    moves = placed.select("v", F.explode(F.arrays_zip(
        F.col("pool.virtual_slot").alias("slot"), F.col("pool.shard").alias("was"),
        F.col("to").alias("to"))).alias("m"))
    return moves.where("m.was <> m.to").select(
        (F.col("v") + 1).alias("version"), F.col("m.slot").alias("virtual_slot"),
        F.col("m.to").alias("shard"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS,
                   id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(placed rows, versioned map).  ``slot`` is the gapless place inside the shard:
    the slot's start in its shard plus the row's place inside the slot."""
    rows = stored(slotted(docs, id_col, text_col, n_slots), "shard-rows")
    totals = stored(slot_totals(rows, n_slots), "shard-totals")
    v0 = first_map(totals, n_shards)
    versions = stored(v0.unionByName(rebalance(v0, totals, n_shards)), "shard-map")
    starts = current_map(versions).join(totals, "virtual_slot").withColumn(
        "start", F.sum("slot_rows").over(Window.partitionBy("shard").orderBy("virtual_slot"))
        - F.col("slot_rows")).select("virtual_slot", "shard", "start")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = (rows.withColumn("place", F.row_number().over(inside) - 1)
              .join(F.broadcast(starts), "virtual_slot")      # n_slots rows
              .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                      (F.col("start") + F.col("place")).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
    return placed, versions
