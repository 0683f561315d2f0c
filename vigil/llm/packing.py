"""Operator 6 — best-fit packing with large-item matching.

Texts become token ids plus an end id; only documents over the capacity are cut
into full pieces (the remainder first).  Packing works on the histogram of piece
lengths, which has at most ``capacity`` entries whatever the corpus: pieces over
a third of the capacity pair at most two to a sequence by greedy matching, the
others fill the tightest gaps in falling order of length.  The plan is a list of
runs "the pieces lo..hi of length l go k to a sequence from sequence s on"; the
pieces take their places by their rank within their length, so no task holds
more than the plan.

Defined results: a null text is empty and keeps its end id; equal rows are
packed one by one; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.session import ship_package

CAPACITY = 2048
END_ID = 0
#: parts into which the ranking of one length is split
SALTS = 64
#: distinct word chunks whose ids a worker keeps
CACHE = 600_000
#: longer words are encoded as texts are
LONG_WORD = 200


class ChunkEncoder:
    """Ids of whole texts, taken chunk by chunk from a bounded cache.

    The byte-level pattern always breaks before a space that precedes a word and
    between a letter or digit and a mark such as a stop, so a text is the
    concatenation of the chunks cut there and its white space; a text
    with white space other than blank, tab and line ends is encoded whole, and so is
    one that holds a special token's string, which the tokenizer takes for the token.
    """

    def __init__(self, path: str):
        import re

        import tokenizers
        self.whole = tokenizers.Tokenizer.from_file(path)
        # letters or digits before a mark or a gap end their piece; marks joined to words would
        # make many more distinct chunks
        self.chunks = re.compile(r" ?[A-Za-z0-9À-ÖØ-öø-ɏ]++(?![^\s.,;:!?$%])| ?[^\s]+|\s+(?!\S)|\s+").findall
        self.marks = sorted(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.odd = re.compile(r"[^\S \n\t\r]").search
        self.known: dict[str, bytes] = {}
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}      # the byte-level alphabet
        others = iter(range(256, 512))
        self.alphabet = [chr(b if b in plain else next(others)) for b in range(256)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of chunks or whole texts.  A run of letters with or without a blank before it is one
        piece of the byte-level pattern, so the vocabulary's merges are asked directly."""
        out: list[bytes | None] = [None] * len(texts)
        tokenize, rest = self.whole.model.tokenize, []
        for k, t in enumerate(texts):
            body = t[1:] if t[:1] == " " else t
            if not body.isalpha() or len(body) > LONG_WORD:
                rest.append(k)
                continue
            word = "".join(map(self.alphabet.__getitem__, t.encode()))
            out[k] = array("I", [x.id for x in tokenize(word)]).tobytes()
        for k, e in zip(rest, self.whole.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False)):
            out[k] = np.asarray(e.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known = self.known
        split = [None if self.odd(t) or any(m in t for m in self.marks) else self.chunks(t) for t in texts]
        wanted = set().union(*(s for s in split if s is not None))
        missing = list(wanted.difference(known))
        if len(known) + len(missing) > CACHE:
            known.clear()
            missing = list(wanted)
        known.update(zip(missing, self._ids(missing)))
        for t, s in zip(texts, split):
            yield self._ids([t])[0] if s is None else b"".join(map(known.__getitem__, s))


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    enc = _encoder(path)
    end = np.asarray([END_ID], "<u4").tobytes()
    for b in batches:
        rids, docs, texts = (b.column(i).to_pylist() for i in range(3))
        for lo in range(0, len(texts), 256):
            part = [t or "" for t in texts[lo:lo + 256]]
            out: list[list] = [[], [], [], [], [], []]
            for i, ids in enumerate(enc.encode(part), lo):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for p, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    for column, v in zip(out, (rids[i], docs[i], p, a, z - a, ids[4 * a:4 * z])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.binary())],
                ["rid", "doc_id", "piece", "start", "length", "ids"])


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """rid, doc_id, piece, start, length, ids (little-endian uint32) of every piece."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"),
                       F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(
        partial(_pieces, path=tokenizer_path, capacity=capacity),
        "rid bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"), "pieces")


class _Gaps:
    """Open sequences by the room they have left: runs (first sequence, how many)."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.runs:
                insort(self.sizes, gap)
            self.runs.setdefault(gap, []).append((first, count))

    def tightest(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.pop(at)
        return gap, first, count


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset), by length and rank."""
    left, used, out, opened = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps = _Gaps()

    def place(length: int, n: int, first: int, per: int, offset: int) -> None:
        out.append((length, used[length], first, per, offset))
        used[length] += n
        left[length] -= n

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            b = next((x for x in reversed(large) if x <= capacity - a and left[x] > (x == a)), None)
            if b is None:
                n = left[a]
                gaps.add(capacity - a, opened, n)
                place(a, n, opened, 1, 0)
            else:
                n = left[a] // 2 if a == b else min(left[a], left[b])
                gaps.add(capacity - a - b, opened, n)
                if a == b:
                    place(a, 2 * n, opened, 2, 0)
                else:
                    place(a, n, opened, 1, 0)
                    place(b, n, opened, 1, a)
            opened += n
    for a in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[a]:
            hit = gaps.tightest(a)
            if hit is None:
                hit = (capacity, opened, -(-left[a] // (capacity // a)))
                opened += hit[2]
            gap, first, count = hit
            per = gap // a
            full = min(count, left[a] // per)
            if full:
                gaps.add(gap - per * a, first, full)
                place(a, full * per, first, per, capacity - gap)
            if full < count:
                if left[a]:
                    gaps.add(gap - left[a] * a, first + full, 1)
                    place(a, left[a], first + full, per, capacity - gap)
                    full += 1
                gaps.add(gap, first + full, count - full)
    return sorted(out)


def _places(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    key = runs[:, 0] * (1 << 44) + runs[:, 1]
    for b in batches:
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        r = runs[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
        n = rank - r[:, 1]
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), b.column("piece"), pa.array(r[:, 2] + n // r[:, 3]),
             pa.array(r[:, 4] + (n % r[:, 3]) * length)], ["rid", "piece", "sequence_id", "offset"])


def placements(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rid, piece, sequence_id, offset of every piece."""
    narrow = pieces.select("rid", "piece", "length", F.pmod(F.xxhash64("rid", "piece"), F.lit(SALTS))
                           .cast("int").alias("salt"))
    sizes = narrow.groupBy("length", "salt").agg(F.count("*").alias("n"))   # capacity x SALTS rows at most
    sizes = stored(sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("salt")) - F.col("n")), "piece-lengths")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.asarray(plan(counts, capacity) or [(0, 0, 0, 1, 0)], dtype=np.int64)
    part = Window.partitionBy("length", "salt").orderBy("rid", "piece")
    ranked = narrow.withColumn("place", F.row_number().over(part) - 1) \
        .join(F.broadcast(sizes.drop("n")), ["length", "salt"]) \
        .select("rid", "piece", "length", (F.col("before") + F.col("place")).cast("long").alias("rank"))
    return ranked.mapInArrow(partial(_places, runs=runs),
                             "rid bigint, piece int, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, placements); join them on rid and piece."""
    pieces = token_pieces(docs, tokenizer_path, id_col, text_col, capacity)
    return pieces, placements(pieces, capacity)


def packed_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece with the crc32 of its ids and its place; ids are not moved."""
    pieces, places = pack(docs, tokenizer_path)
    digest = pieces.select("rid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digest.join(places, ["rid", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
