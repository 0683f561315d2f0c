"""Operator 4 — n-gram Jaccard join by universe partition and pigeonhole.

A document is the set of its distinct five-word shingles.  Sets with J >= t
differ in at most D = (|r|+|s|)(1-t)/(1+t) shingles.  Per size band (powers of
two; the larger set of a pair names the band) the shingle universe is hashed
into m segments, so of the non-empty segments of the smaller set at most D
differ and one more finds the pair.  The first m/8 segments also index their
one-deletion neighbourhood: such a segment finds the pair at one difference and
counts twice.  Small bands take every shingle as its own segment.

Cost-based allocation: a linked set shares all but D of a set's units, so the
set may leave out some and still require the others to match.  It leaves out the
dearest by the measured length of their lists, half of what it can spare, and a
candidate must match all but D of the rest; lists that hold no other set cost
nothing, so a set without partners probes nothing.  A set whose units fall short
of D+1 (empty segments) is compared on its shingles directly.

Candidates are verified exactly.  Hub rounds first link sets to one likely member
of their lists, the one that shares most with the others to begin with; after them
only pairs whose components still differ are verified, so a group of copies costs
its size and not its square.  The sets that lie in long lists with a quarter of their
units count the shingles that any other of them holds: no overlap of two of them
exceeds that number, and the variants too far from all others meet none of them.  Pairs whose
bitmaps already differ too much leave before the sets themselves move.

The index travels as packed blocks (eight bytes an entry, ten beside unit numbers from
65,536 on) dealt by signature, their number follows the data.  Shingles are 64-bit hashes.

Defined results: null, empty and word-free texts are empty sets, linked with
nothing, component_id their own id; equal sets are linked; a null id is ignored
by the smallest id of a component (null if it holds no other); other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import textvec as tv
from vigil.llm.common import dropped, fresh, row_parallelism, stored
from vigil.session import ship_package

PERCENT = 75
#: smallest set size that is cut into segments
SEGMENTED = 16
#: index entries meant for one block of signatures
BLOCK_ENTRIES = 1_000_000
#: bytes of text whose sets are packed together
SLICE_BYTES = 1 << 21
#: bytes of text hashed at once: hashing holds several arrays of eight bytes a byte of text, and a
#: worker keeps what it once took, so its peak stays with the executor for all later stages
HASH_BYTES = 1 << 18
#: shingles whose index entries are made at once; packed before the next are made
PART_SHINGLES = 100_000
#: rows of the live lists that leave a task at once
LIST_ROWS = 100_000
#: hub rounds before the remaining pairs are verified one by one
HUB_ROUNDS = 2
#: members from which a list is long
LONG_LIST = 64
#: a class of equal sets with this share of the rows is indexed by one row only
HOT_SHARE = 1e-3
BROADCAST_KEYS = 1_000_000

U = np.uint64
_ENTITY = np.dtype([("cid", "<i8"), ("n", "<i4"), ("band", "<i2"), ("units", "<i4")])
#: 32 bits of the signature beside the block; the upper half of larger unit numbers travels apart
_ENTRY = np.dtype([("sig", "<u4"), ("entity", "<u2"), ("unit", "<u2")])


def segments_of(band):
    """(segments, of which with deletion neighbourhoods) of a band of sizes [2**band, 2**(band+1))."""
    top = np.left_shift(1, np.asarray(band, np.int64) + 1)
    # the share keeps the units five deviations over D+1; small bands leave more segments empty
    m = np.maximum(1, top * np.where(top >= 128, 33, np.where(top >= 64, 40, 45)) // 100)
    return m, np.maximum(1, m // 8)


def differences(n, band, percent: int = PERCENT):
    """Most differences of a set of n and a linked one no smaller and inside the band."""
    partner = np.minimum((n * 100) // percent, np.left_shift(1, band + 1) - 1)
    return (n + partner) * (100 - percent) // (100 + percent)


def index_entries(tokens: np.ndarray, sizes: np.ndarray, cids: np.ndarray, percent: int = PERCENT):
    """(entities, signature, entity, unit) of the given sets.  ``units`` is what an
    entity can count; unit 2i is segment i, unit 2i+1 its deletions."""
    live = np.flatnonzero(sizes)
    first = (np.cumsum(sizes) - sizes)[live]
    n = sizes[live].astype(np.int64)
    band = np.floor(np.log2(n)).astype(np.int64)
    up = np.flatnonzero((n * 100) // percent >= np.left_shift(1, band + 1))
    who = np.concatenate([np.arange(len(live)), up])
    eband = np.concatenate([band, band[up] + 1])
    en, efirst = n[who], first[who]
    own = np.arange(len(who)) < len(live)
    ents = np.zeros(len(who), _ENTITY)
    ents["cid"], ents["n"], ents["band"] = cids[live][who].view(np.int64), en, eband
    need = differences(en, eband, percent) + 1

    start = np.cumsum(en) - en
    ent = np.repeat(np.arange(len(who)), en)
    tok = tokens[np.arange(int(en.sum())) - np.repeat(start - efirst, en)]
    whole = np.left_shift(1, eband) < SEGMENTED           # every shingle its own segment
    salt = tv.mix(eband.astype(np.uint64) + U(77))
    t = whole[ent]
    sig_a = tv.mix(tok[t] + salt[ent[t]])
    ent_a = ent[t]
    rank = np.arange(len(tok))[t] - start[ent_a]
    keep = own[ent_a] | (rank < need[ent_a])
    sig_a, ent_a, unit_a = sig_a[keep], ent_a[keep], 2 * rank[keep]

    tok, ent = tok[~t], ent[~t]
    m, designated = segments_of(eband)
    m, designated = np.where(whole, 0, m), np.where(whole, 0, designated)
    base = np.cumsum(m) - m
    hashed = tv.mix(tok ^ U(0xC0FFEE))
    seg = (((hashed >> U(33)) * m[ent].astype(np.uint64)) >> U(31)).astype(np.int64)
    at = base[ent] + seg
    total = int(m.sum())
    acc = np.zeros(total, np.uint64)
    np.add.at(acc, at, hashed)
    cnt = np.bincount(at, minlength=total)
    seg_ent = np.repeat(np.arange(len(who)), m)
    seg_no = np.arange(total) - base[seg_ent]
    seg_salt = tv.mix(salt[seg_ent] + seg_no.astype(np.uint64))
    full = np.flatnonzero(cnt)
    upto = np.cumsum(cnt > 0) - 1
    before = np.zeros(len(who), np.int64)
    filled = np.bincount(seg_ent[full], minlength=len(who))
    before = np.cumsum(filled) - filled
    enough = ~own & (filled >= need)                     # a probe needs no more than D+1
    pick = full[~enough[seg_ent[full]] | (upto[full] - before[seg_ent[full]] < need[seg_ent[full]])]
    sig_b, ent_b, unit_b = tv.mix(acc[pick] + seg_salt[pick]), seg_ent[pick], 2 * seg_no[pick]
    gap = np.flatnonzero((seg < designated[ent]) & (cnt[at] >= 2) & ~enough[ent])
    sig_c = tv.mix(acc[at[gap]] - hashed[gap] + seg_salt[at[gap]])
    ent_c, unit_c = ent[gap], 2 * seg[gap] + 1
    twice = np.bincount(seg_ent[(seg_no < designated[seg_ent]) & (cnt >= 2)], minlength=len(who))
    ents["units"] = np.where(whole, np.where(own, en, np.minimum(en, need)),
                             np.where(enough, need, filled + twice))
    return (ents, need, np.concatenate([sig_a, sig_b, sig_c]), np.concatenate([ent_a, ent_b, ent_c]),
            np.concatenate([unit_a, unit_b, unit_c]))


def _hashed_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, sizes, ids) of the rows between the offsets, hashed a few at a time."""
    tokens, sizes, cids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in tv.slices(off, HASH_BYTES):
        t, n = tv.shingle_sets(*tv.word_hashes(data, off[i:j + 1]))
        tokens.append(t)
        sizes.append(n)
        cids.append(tv.set_ids(t, n))
    return np.concatenate(tokens), np.concatenate(sizes), np.concatenate(cids)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = tv.text_buffers(b.column("text"))
        sizes, cids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for i, j in tv.slices(off, SLICE_BYTES):
            _, size, cid = _hashed_sets(data, off[i:j + 1])
            sizes.append(size)
            cids.append(cid)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(np.concatenate(sizes)),
             pa.array(np.concatenate(cids).view(np.int64)), b.column("k1"), b.column("k2")],
            ["id", "n", "cid", "k1", "k2"])


def _distinct_sets(b: pa.RecordBatch, hot: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, sizes, ids) of a batch's slices; of a hot class only its smallest id's rows."""
    data, off = tv.text_buffers(b.column("text"))
    ids = b.column("id").to_pylist() if hot else None
    for i, j in tv.slices(off, SLICE_BYTES):
        tokens, sizes, cids = _hashed_sets(data, off[i:j + 1])
        rows = sizes > 0
        if hot:                                              # before the first of each set is taken
            rows &= np.fromiter((hot.get(c, d) == d for c, d in zip(cids.view(np.int64).tolist(), ids[i:j])),
                                bool, len(sizes))
        rows = np.flatnonzero(rows)
        take = np.zeros(len(sizes), bool)
        take[rows[np.unique(cids[rows], return_index=True)[1]]] = True
        yield tokens[np.repeat(take, sizes)], sizes[take], cids[take]


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sets with about PART_SHINGLES shingles; a larger set stands alone."""
    stop = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(stop, stop[lo] - sizes[lo] + PART_SHINGLES, "right")))
        yield lo, hi
        lo = hi


def _packed(tokens: np.ndarray, sizes: np.ndarray, cids: np.ndarray, blocks: int, percent: int) -> pa.RecordBatch:
    """The index of some sets by block.  Entries are made and packed part by part."""
    ents, shorts, entity, block, rows, high = [], [], [], [], [], []
    stop = np.cumsum(sizes)
    for lo, hi in _parts(sizes):
        e, need, sig, ent, unit = index_entries(tokens[stop[lo] - sizes[lo]:stop[hi - 1]], sizes[lo:hi],
                                                cids[lo:hi], percent)
        entity.append((ent + sum(map(len, ents))).astype("<u2"))
        ents.append(e)
        shorts.append(e["cid"][e["units"] < need])
        block.append((((sig >> U(48)) * U(blocks)) >> U(16)).astype(np.int32))
        row = np.empty(len(sig), _ENTRY)
        row["sig"], row["entity"], row["unit"] = sig & U(0xFFFFFFFF), 0, unit & 0xFFFF
        rows.append(row)
        high.append((unit >> 16).astype("<u2"))
    ents, short, block = np.concatenate(ents), np.unique(np.concatenate(shorts)), np.concatenate(block)
    order = np.argsort(block, kind="stable")
    block, rows, high = block[order], np.concatenate(rows)[order], np.concatenate(high)[order]
    rows["entity"] = np.concatenate(entity)[order]
    del order, entity
    names, at = np.unique(block, return_index=True)
    out = []
    for no, p, q in zip(names, at, [*at[1:], len(block)]):
        used, rows["entity"][p:q] = np.unique(rows["entity"][p:q], return_inverse=True)
        out.append((int(no), ents[used].tobytes(), rows[p:q].tobytes(),
                    high[p:q].tobytes() if high[p:q].any() else b""))
    if len(short):
        out.append((-1, short.tobytes(), b"", b""))
    cells = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cells[1:])],
                                      ["block", "entities", "entries", "high"])


def _index(batches: Iterator[pa.RecordBatch], blocks: int, hot: dict,
           percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Packed index blocks; blocks under zero hold the ids whose units fall short."""
    for b in batches:
        for tokens, sizes, cids in _distinct_sets(b, hot):
            for lo in range(0, len(sizes), 30_000):          # entity numbers have 16 bits
                n, upto = sizes[lo:lo + 30_000], int(sizes[:lo].sum())
                yield _packed(tokens[upto:upto + int(n.sum())], n, cids[lo:lo + 30_000], blocks, percent)


def _cells(column: pa.Array) -> list[memoryview]:
    """The values of a binary column as views of its buffer."""
    if not len(column):
        return []
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], wide)[column.offset:column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    return [data[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist())]


def _live_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a block that hold two sets or more, and the ids that fall short (a
    null key).  Rows arrive sorted by block."""
    def flush(block: int, ents: list, rows: list, high: list) -> Iterator[pa.RecordBatch]:
        sizes = [len(r) for r in rows]
        sig = np.concatenate([r["sig"] for r in rows])
        order = np.argsort(sig, kind="stable")               # most signatures are met once and go first
        same = np.diff(sig[order]) == 0
        order = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])
        key = (block << 32) | sig[order].astype(np.int64)
        del sig, same
        shift = np.cumsum([0] + [len(e) for e in ents], dtype=np.int32)
        cut = np.searchsorted(order, np.cumsum([0] + sizes))
        picks = [order[p:q] - z for p, q, z in zip(cut[:-1], cut[1:], np.cumsum([0] + sizes[:-1]))]
        who = np.concatenate([r["entity"][p].astype(np.int32) + s for r, p, s in zip(rows, picks, shift)])
        unit = np.concatenate([r["unit"][p] for r, p in zip(rows, picks)])
        if any(len(h) for h in high):
            above = np.concatenate([h[p] if len(h) else np.zeros(len(p), "<u2") for h, p in zip(high, picks)])
            unit = unit | (above.astype(np.int32) << 16)
        ent = np.concatenate(ents)
        ents.clear()
        rows.clear()
        high.clear()
        if not len(order):
            return
        order = np.lexsort((ent["cid"][who], key))
        key, who, unit = key[order], who[order], unit[order]
        del order, picks
        cid = ent["cid"][who]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        # repeats of an entry (copies in other batches) go; deletions may meet their own segment
        fresh = new_key | np.concatenate([[True], (cid[1:] != cid[:-1])
                                          | (ent["band"][who[1:]] != ent["band"][who[:-1]])
                                          | (unit[1:] != unit[:-1])])
        new_cid = new_key | np.concatenate([[True], cid[1:] != cid[:-1]])
        group = np.cumsum(new_key) - 1
        many = np.bincount(group, weights=new_cid) >= 2
        keep = fresh & many[group]
        kept = np.flatnonzero(keep)
        del cid, fresh, new_key, new_cid, group, many, keep
        for lo in range(0, len(kept), LIST_ROWS):
            at = kept[lo:lo + LIST_ROWS]
            e = ent[who[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at]), pa.array(e["cid"]), pa.array(e["n"]), pa.array(e["band"].astype(np.int32)),
                 pa.array(e["units"]), pa.array(unit[at].astype(np.int32))],
                ["key", "cid", "n", "band", "units", "unit"])

    def short(ids: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(ids), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([none[0], pa.array(ids), *none[1:]],
                                          ["key", "cid", "n", "band", "units", "unit"])

    now, ents, rows, high = None, [], [], []
    for b in batches:
        for block, e, r, h in zip(b.column("block").to_pylist(), *map(_cells, b.columns[1:])):
            if block < 0:
                yield short(np.frombuffer(e, "<i8"))
                continue
            if block != now and rows:
                yield from flush(now, ents, rows, high)
            now = block
            ents.append(np.frombuffer(e, _ENTITY))
            rows.append(np.frombuffer(r, _ENTRY))
            high.append(np.frombuffer(h, "<u2"))
    if rows:
        yield from flush(now, ents, rows, high)


def _token_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for tokens, sizes, cids in _distinct_sets(b, {}):
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids.view(np.int64)), pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                    pa.array(tokens.view(np.int64)))], ["cid", "tokens"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and bitmap of every set, two to four bits a shingle; of half the length by an OR of its halves."""
    for b in batches:
        for tokens, sizes, cids in _distinct_sets(b, {}):
            bits = np.maximum(64, np.left_shift(4, np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)))
            start = np.concatenate([[0], np.cumsum(bits)])
            flags = np.zeros(start[-1], bool)
            flags[np.repeat(start[:-1], sizes) + (tokens & np.repeat(bits - 1, sizes).astype(U)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(
                    pa.array((start // 64).astype(np.int32)), pa.array(np.packbits(flags, bitorder="little").view("<i8")))],
                ["cid", "n", "bits"])


def _small(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """A table of a few longs per row, broadcast only when its counted rows are few."""
    return F.broadcast(df) if df.count() <= limit else df


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact overlap.  Only the sets that pairs name move."""
    pairs = _small(pairs)
    a = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a")
    named = _small(stored(pairs.select("b").distinct(), "named"))
    b = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")).join(named, "b", "left_semi")
    both = a.join(b, "b").select(
        "a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"),
        F.size(F.array_intersect("ta", "tb")).alias("c"))
    return stored(both.where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c")))
                  .select("a", "b"), "links")


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a no larger than b) that their sketches leave possible: a bit that one set has and
    the other lacks stands for at least one shingle that is not shared."""
    sketches = _small(sketches, BROADCAST_KEYS // 4)
    both = pairs.join(sketches.toDF("a", "na", "x"), "a").join(sketches.toDF("b", "nb", "y"), "b")
    half = F.size("x")
    folded = F.when(F.size("y") > half, F.zip_with(F.slice("y", 1, half), F.slice("y", half + 1, half),
                                                   lambda p, q: p.bitwiseOR(q))).otherwise(F.col("y"))
    only = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))),
                                    F.lit(0), lambda total, c: total + c)
    shared = F.least(F.col("na") - only("x", "y"), F.col("nb") - only("y", "x"))
    return both.withColumn("y", folded).where((100 + percent) * shared >= percent * (F.col("na") + F.col("nb"))) \
        .select("a", "b")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(cid, label) after the links (a, b) joined components: each old label gets the
    smallest label reachable, by label passing and jumps on the graph of old labels."""
    la, lb = labels.toDF("a", "x"), labels.toDF("b", "y")
    edges = links.join(la, "a").join(lb, "b").where("x <> y").select("x", "y")
    edges = stored(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
                   .distinct(), "edges")
    if edges.isEmpty():
        return labels
    now = edges.select("x", F.col("x").alias("label")).distinct()
    while True:
        near = edges.join(now.toDF("y", "via"), "y").groupBy("x").agg(F.min("via").alias("via"))
        step = now.join(near, "x").select("x", F.least("label", "via").alias("next"), "label")
        jump = step.select(F.col("x").alias("next"), F.col("next").alias("jump"))
        new = stored(step.join(jump, "next").select("x", "jump", "label"), "labels-step")
        now = new.select("x", F.col("jump").alias("label"))
        if new.where("jump <> label").isEmpty():
            break
    return stored(labels.join(now.toDF("label", "new"), "label", "left").select(
        "cid", F.coalesce("new", "label").alias("label")), "labels")


def link_sets(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members: id, n, cid per row; labels: cid, label of the sets that have links)."""
    spark = docs.sparkSession
    ship_package(spark)
    members = stored(docs.mapInArrow(_members, "id bigint, n bigint, cid bigint, k1 bigint, k2 bigint"),
                     "members")
    rows, tokens = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot_rows = max(50, int(HOT_SHARE * rows))              # so at most 1000 classes are hot
    hot = {r.cid: r.first for r in members.where("n > 0").groupBy("cid").agg(
        F.count("*").alias("c"), F.min("id").alias("first")).where(F.col("c") >= hot_rows).collect()
        if r.first is not None}
    blocks = max(row_parallelism(spark), int(tokens * 0.7) // BLOCK_ENTRIES + 1)
    index = docs.select("id", "text").mapInArrow(
        partial(_index, blocks=blocks, hot=hot, percent=percent),
        "block int, entities binary, entries binary, high binary")
    found = stored(index.repartition(blocks, "block").sortWithinPartitions("block")
                   .mapInArrow(_live_lists, "key bigint, cid bigint, n int, band int, units int, unit int"),
                   "lists")
    live, short = found.where("key IS NOT NULL"), found.where("key IS NULL").select("cid").distinct()

    # cost-based allocation: all units of each (set, band) but the dearest it can spare
    delta = F.expr(f"(n + least(n * 100 div {percent}, shiftleft(1L, band + 1) - 1)) "
                   f"* {100 - percent} div {100 + percent}")
    lists = live.groupBy("key").agg(F.count("*").alias("length"))
    costed = live.join(lists, "key").withColumn("deletion", F.col("unit") % 2)
    unit_cost = costed.groupBy("cid", "band", "n", "units", "unit", "deletion").agg(
        F.sum("length").alias("cost"))
    seg = Window.partitionBy("cid", "band", F.expr("unit div 2"))
    unit_cost = unit_cost.withColumn("cost", F.max("cost").over(seg.orderBy("unit")))
    mine = Window.partitionBy("cid", "band")
    spare = F.floor(F.greatest(F.col("units") - delta, F.lit(0)) / 2)
    chosen = unit_cost.withColumn("place", F.row_number().over(mine.orderBy("cost", "deletion", "unit"))) \
        .withColumn("free", F.col("units") - F.count("*").over(mine)) \
        .withColumn("asked", (F.col("units") - spare).cast("int")) \
        .where((F.col("free") <= delta) & (F.col("place") <= F.col("asked") - F.col("free")))
    chosen = stored(chosen.withColumn("weight", F.count("*").over(seg))
                    .select("cid", "band", "unit", "asked", "weight"), "chosen")
    marked = stored(live.join(chosen, ["cid", "band", "unit"], "left"), "marked")
    dropped(chosen)
    probed = marked.where("asked IS NOT NULL").select("key").distinct()
    lists = stored(marked.join(probed, "key", "left_semi"), "probed-lists")
    dropped(marked)

    links = _exhaustive(docs, members, short, percent)
    dropped(found)
    nodes = lists.select("cid").unionByName(links.select(F.col("a").alias("cid"))) \
        .unionByName(links.select(F.col("b").alias("cid"))).distinct()
    labels = components(stored(nodes.select("cid", F.col("cid").alias("label")), "nodes"), links)

    def after(pairs: DataFrame) -> DataFrame:
        sets = _sets_of(docs, members, _named(pairs))
        links = _verified(pairs, sets, percent)
        dropped(sets)
        return components(labels, links)

    for turn in range(HUB_ROUNDS):
        labels = after(stored(_hub_pairs(lists, labels, turn, percent), "pairs"))
    open_lists = _open_lists(lists, labels)
    dropped(lists)
    pairs = stored(_open_pairs(open_lists, _shared_shingles(docs, members, open_lists), percent), "pairs")
    dropped(open_lists)
    # most share a common passage only: their number grows with the square of the sets that hold it, so
    # they leave by sketches and not by whole sets
    sketches = _sets_of(docs, members, _named(pairs), _sketches, "n int, bits array<bigint>")
    possible = stored(_possible(pairs, sketches, percent), "pairs")
    dropped(sketches, pairs)
    return members, after(possible)


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()


def _sets_of(docs: DataFrame, members: DataFrame, wanted: DataFrame, made=_token_arrays,
             columns: str = "tokens array<bigint>") -> DataFrame:
    """cid, tokens (or what else is made) of the wanted sets, hashed again from one text of each.  Texts
    and tokens stay in their tasks, but for the sets whose row is there more than once."""
    keys = stored(members.join(wanted, "cid", "left_semi").groupBy("cid", "k1", "k2").agg(F.count("*").alias("c"))
                  .groupBy("cid").agg(F.min(F.struct("k1", "k2", "c")).alias("k"))
                  .groupBy("k.k1", "k.k2").agg(F.max("k.c").alias("c")), "set-texts")

    def arrays(some: DataFrame) -> DataFrame:
        found = None
        turns = -(-some.count() // BROADCAST_KEYS) or 1      # each meets the texts without moving them
        for turn in range(turns):
            part = some.where(F.pmod(F.xxhash64("k1"), F.lit(turns)) == turn).select("k1", "k2")
            texts = docs.join(F.broadcast(part), ["k1", "k2"], "left_semi")
            one = texts.select("id", "text").mapInArrow(made, f"cid bigint, {columns}")
            found = one if found is None else found.unionByName(one)
        return found

    sets, again = arrays(keys.where("c = 1")), keys.where("c > 1")
    if not again.isEmpty():
        sets = sets.unionByName(arrays(again).groupBy("cid").agg(*[F.first(c).alias(c) for c in sets.columns[1:]]))
    return stored(sets, "sets")


def _exhaustive(docs: DataFrame, members: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """Links of the sets whose units fall short (rare: empty segments), on their shingles."""
    if short.isEmpty():
        return docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    sets = _sets_of(docs, members, short)
    few = sets.select(F.col("cid").alias("a"), F.size("tokens").alias("na"), F.explode("tokens").alias("t"))
    every = docs.select("id", "text").mapInArrow(_token_arrays, "cid bigint, tokens array<bigint>") \
        .select(F.col("cid").alias("b"), F.size("tokens").alias("nb"), F.explode("tokens").alias("t")) \
        .join(_small(stored(few.select("t").distinct(), "short-shingles")), "t", "left_semi").distinct()
    both = every.join(few, "t").where("a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    links = stored(both.where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c")))
                   .select("a", "b"), "short-links")
    dropped(sets)
    return links


def _hub_pairs(lists: DataFrame, labels: DataFrame, turn: int, percent: int) -> DataFrame:
    """One pair per set: the hub of another component that most of its lists name, where
    they are a good part of the set's.  The first hubs are the sets with the longest lists
    (the middle of a group), later ones are drawn.  Which pairs are tried decides speed only."""
    at = lists.where("unit % 2 = 0")
    if turn == 0:
        lengths = at.groupBy("key").agg(F.count("*").alias("length"))
        reach = at.join(lengths, "key").groupBy("cid").agg((-F.sum("length")).alias("rank"))
        at = at.join(labels.join(reach, "cid"), "cid")
    else:
        at = at.join(labels, "cid").withColumn("rank", F.xxhash64("label", F.lit(turn)))
    hubs = at.groupBy("key").agg(F.min(F.struct("rank", "cid", "n", "label")).alias("hub"),
                                 F.min("label").alias("lo"), F.max("label").alias("hi"))
    hubs = hubs.where("lo <> hi").select("key", "hub")
    votes = at.join(hubs, "key").where(
        (F.col("label") != F.col("hub.label"))
        & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))) \
        .groupBy("cid", F.col("hub.cid").alias("h"), "units", "band").agg(F.count("*").alias("c")) \
        .where(F.col("c") >= 0.25 * F.col("units"))
    return votes.groupBy("cid").agg(F.max(F.struct("c", "h")).alias("best")).select(
        F.col("cid").alias("a"), F.col("best.h").alias("b"))


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold several components, with the largest of them (``main``) and the list's length."""
    at = lists.join(labels, "cid")
    sizes = at.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("k"),
                                    F.sum("c").alias("length")) \
        .where("k > 1").select("key", F.col("m.label").alias("main"), "length")
    return stored(at.join(main, "key").withColumn("own", F.expr("shiftleft(1, band) <= n")), "open-lists")


def _shared_shingles(docs: DataFrame, members: DataFrame, open_lists: DataFrame) -> DataFrame:
    """cid, alone of the sets with a quarter of their units in long lists: the number of
    their shingles that no other such set holds."""
    crowd = open_lists.where(f"length >= {LONG_LIST}").groupBy("cid", "band").agg(
        F.count("*").alias("c"), F.max("units").alias("units")).where("4 * c >= units").select("cid").distinct()
    crowd = stored(crowd, "crowd")
    if crowd.isEmpty():
        return crowd.select("cid", F.lit(0).cast("long").alias("alone"))
    sets = _sets_of(docs, members, crowd)
    tokens = sets.select("cid", F.explode("tokens").alias("t"))
    single = tokens.groupBy("t").agg(F.min("cid").alias("cid"), F.count("*").alias("c")).where("c = 1")
    alone = single.groupBy("cid").agg(F.count("*").alias("alone"))
    out = stored(crowd.join(alone, "cid", "left").select("cid", F.coalesce("alone", F.lit(0)).alias("alone")), "alone")
    dropped(sets)
    return out


def _open_pairs(open_lists: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Every pair of a probing set and one no smaller whose components differ and which
    matches all but D of the units asked for.  In a list only members outside its main
    component meet the others."""
    at = open_lists.join(_small(shared), "cid", "left").withColumn("most", F.col("n") - F.col("alone"))

    def meet(r: DataFrame, s: DataFrame) -> DataFrame:
        r = r.where("asked IS NOT NULL").alias("r")
        s = s.where("own").alias("s")
        both = r.join(s, F.expr(
            "r.key = s.key AND r.label <> s.label AND (r.n < s.n OR (r.n = s.n AND r.cid < s.cid)) "
            f"AND 100 * r.n >= {percent} * s.n AND (r.unit % 2 = 0 OR s.unit % 2 = 0) "
            "AND (r.most IS NULL OR s.most IS NULL "         # both count each other's shingles
            f"OR {100 + percent} * least(r.most, s.most) >= {percent} * (r.n + s.n))"))
        return both.select(F.col("r.cid").alias("a"), F.col("s.cid").alias("b"), "r.weight",
                           (F.col("r.asked") - F.expr(f"(r.n + s.n) * {100 - percent} div {100 + percent}"))
                           .alias("least"))

    off, on = at.where("label <> main"), at.where("label = main")
    # a segment matches one key of the other set; the band is that of the larger set
    return meet(off, at).unionByName(meet(on, off)).groupBy("a", "b") \
        .agg(F.sum("weight").alias("w"), F.max("least").alias("least")).where("w >= least").select("a", "b")


def row_keys(id_col: str, text_col: str) -> tuple:
    """Two hashes that name a row by its id and text."""
    i = F.col(id_col).cast("long")
    return F.xxhash64(i, F.col(text_col)), F.xxhash64(F.col(text_col), i, F.lit(1))


def grouped_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 percent: int = PERCENT) -> DataFrame:
    """id, n, k1, k2, label (null for an empty set), component_id of every row."""
    k1, k2 = row_keys(id_col, text_col)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       k1.alias("k1"), k2.alias("k2"))
    members, labels = link_sets(text, percent)
    classes = members.where("n > 0").groupBy("cid").agg(F.min("id").alias("least"))
    whole = classes.join(labels, "cid", "left").select(
        "cid", "least", F.coalesce("label", "cid").alias("label"))
    comps = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = stored(whole.join(comps, "label").select("cid", "label", "component_id"), "components")
    return members.join(by_class, "cid", "left").select(
        "id", "n", "k1", "k2", "label",
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                              percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return grouped_rows(docs, id_col, text_col, percent).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component (the smallest id, then text hash); rows
    without words stay.  Only the keys of the rows that go are joined with the texts."""
    rows = grouped_rows(docs, id_col, text_col, percent).where("label IS NOT NULL") \
        .groupBy("label", "k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("c"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2"))
                                      .alias("f")).select("label", F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"))
    goes = (F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2"))
    marked = stored(rows.join(first, "label").select("k1", "k2", goes.alias("goes"), "c")
                    .where("goes OR c > 1"), "marked-rows")
    k1, k2 = fresh(docs, "k1", "k2")
    a, b = row_keys(id_col, text_col)
    keyed = docs.withColumns({k1: a, k2: b})
    gone = marked.where("goes").select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    left = keyed.join(gone, [k1, k2], "left_anti")         # rows without words are never marked
    again = marked.where("NOT goes").select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    if not again.isEmpty():                                # rows equal in id and text: one stays
        left = left.join(again, [k1, k2], "left_anti").unionByName(
            left.join(again, [k1, k2], "left_semi").dropDuplicates([k1, k2]))
    return left.select(*docs.columns)
