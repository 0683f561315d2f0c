"""Operator 11 — alignment of two tokenizers by inverted pair bitmaps.

A text with one space before it is encoded by a byte-level vocabulary (A) and by a
piece vocabulary (B, which adds that space itself).  Byte offsets where tokens of
both end cut the tokens into groups; an A and a B token link where their bytes overlap.

*Postings.*  Texts are gathered in blocks of at most ``BLOCK_DOCS`` documents and
about ``BLOCK_CHUNKS`` words.  For every linked id pair a block has one row of
document bitmaps, one per binary digit of the number of links in a document (the
multiplicity planes): a list of two-byte places, or 1 KB of bits from 512 places on.
*Counts.*  The planes of a row OR-merged are its documents, the popcounts of the
planes times their digits its links.  Blocks share no document, so the popcounts of
a pair's rows add up; Spark sums them with map-side aggregation and no pair is gathered.
*Scores.*  The rows join their pair's count (a pair has one row a block; adaptive
execution splits a pair that stands out) and each block's rows return the scores to
its documents.

Encoding works on chunks cut before a blank that follows other text.  No token
of either vocabulary reaches over such a place (A's pattern breaks there, no piece of B
holds a blank after other text; both checked when the files are read), so a text's
tokens and groups are those of its chunks, which a worker keeps in a bounded cache.

Defined results: a text that is null, empty, or that either vocabulary does not give
back byte for byte has no tokens: zeros and an empty digest.  Special tokens' strings
are plain text.  Rows of equal id or text are documents of their own; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored
from vigil.session import ship_package

BLOCK_DOCS = 8192
PLACE_BITS = 13
BLOCK_CHUNKS = 1_000_000
#: chunks that a worker keeps, and how many characters they may hold
CACHE = 250_000
CACHE_CHARS = 16 << 20
#: texts encoded together
SLICE = 256
BITMAP = BLOCK_DOCS // 8

STATS = ("n_a", "n_b", "n_groups", "n_links")
ROWS = ("block bigint, pair bigint, planes array<binary>, place int, doc_id bigint, "
        "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string")
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.int32(), pa.int64(), *[pa.int64()] * 4, pa.string()]
_NAMES = [f.split()[0] for f in ROWS.split(", ")]


def byte_level_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes in order for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in plain else next(rest)): b for b in range(256)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 of all i."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class PairEncoder:
    """Aligned tokens of texts, chunk by chunk."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_level_alphabet()
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        size = self.a.get_vocab_size()
        special = {t["id"] for t in spec["added_tokens"]}
        self.a_bytes = [b"" if i in special else bytes(map(of.__getitem__, self.a.id_to_token(i)))
                        for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces) or not spec["pre_tokenizer"].get("use_regex", False):
            raise ValueError("the vocabularies hold tokens over the start of a word")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id("▁")
        self.sizes = [np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes)]
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        self.marks = [[text(len(v), e) for e in (",", end)]
                      for v, end in ((self.a_bytes, "|"), (self.b_bytes, ";"))]
        self.chunks = re.compile(r"\s*+\S++(?:[^\S ]\s*+\S*+)*+|\s++").findall
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str | None] = []             # None: not given back byte for byte
        self.stats = np.zeros((1 << 12, len(STATS)), np.int64)
        self.ends = np.zeros(1 << 12, np.int64)        # of each chunk's pairs in self.pairs
        self.pairs = np.zeros(1 << 16, np.uint32)
        self.chars = 0

    def full(self, missing: list[str]) -> bool:
        return len(self.index) + len(missing) > CACHE or self.chars + sum(map(len, missing)) > CACHE_CHARS

    def _keep(self, stats: np.ndarray, n_pairs: np.ndarray, pairs: np.ndarray, groups: list[str | None]) -> None:
        n, k = len(self.groups), len(groups)
        end = int(self.ends[n - 1]) if n else 0
        while n + k > len(self.ends):
            self.stats, self.ends = (np.concatenate([v, np.zeros_like(v)]) for v in (self.stats, self.ends))
        while end + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.stats[n:n + k] = stats
        self.ends[n:n + k] = end + np.cumsum(n_pairs)
        self.pairs[end:end + len(pairs)] = pairs
        self.groups += groups

    def learn(self, chunks: list[str], named: bool = True) -> None:
        """Align chunks, each with its blank before it, and keep them."""
        first = len(self.groups)
        a, n_a = _flat([e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)])
        b, n_b = _flat([i if c != " " else [self.blank]
                        for c, i in zip(chunks, self.b.encode([c[1:] for c in chunks], num_threads=1))])
        raw = [c.encode() for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = []
        good = np.ones(len(raw), bool)
        for ids, n, table in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            joined = list(map(table.__getitem__, ids.tolist()))
            if b"".join(joined) != b"".join(raw):      # find the chunks that differ
                stop = np.cumsum(n)
                good &= [b"".join(joined[e - k:e]) == r for e, k, r in zip(stop, n, raw)]
            sides.append(joined)
        if not good.all():
            mask = np.repeat(good, n_a), np.repeat(good, n_b)
            a, b, n_a, n_b, size = a[mask[0]], b[mask[1]], n_a[good], n_b[good], size[good]
        a_end, b_end = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        a_start, b_start = a_end - self.sizes[0][a], b_end - self.sizes[1][b]
        # links: B tokens that end after an A token starts and start before it ends
        lo, hi = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        pairs = (np.repeat(a, hi - lo) << 16 | b[_spread(lo, hi - lo)]).astype(np.uint32)
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        stop = np.cumsum(size)                         # byte ends of the chunks; all are cuts

        def per_chunk(ends: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
            run = np.searchsorted(ends, stop, "right")
            if weight is not None:
                run = np.concatenate([[0], np.cumsum(weight)])[run]
            return np.diff(run, prepend=0)

        n_links = per_chunk(a_end, hi - lo)
        stats = np.stack([n_a, n_b, per_chunk(cuts), n_links], axis=1) if len(size) else np.zeros((0, 4), np.int64)
        # the digest's text: a group's A tokens, then its B tokens
        a_cut, b_cut = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)      # last tokens of the groups
        words = np.empty(len(a) + len(b), dtype=object)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[a_cut], b_last[b_cut] = True, True
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        before = np.concatenate([[0], b_cut + 1])[a_group] if len(a) else a_group
        words[np.arange(len(a)) + before] = np.where(a_last, self.marks[0][1][a], self.marks[0][0][a])
        words[np.arange(len(b)) + a_cut[b_group] + 1 if len(b) else b_group] = \
            np.where(b_last, self.marks[1][1][b], self.marks[1][0][b])
        words, ends = words.tolist(), np.cumsum(n_a + n_b).tolist()
        found = ["".join(words[e - k:e]) for e, k in zip(ends, (n_a + n_b).tolist())]
        if not good.all():
            full = np.zeros((len(raw), len(STATS)), np.int64)
            full[good] = stats
            left = np.zeros(len(raw), np.int64)
            left[good] = n_links
            rest = iter(found)
            stats, n_links, found = full, left, [next(rest) if g else None for g in good]
        self._keep(stats, n_links, pairs, found)
        if named:
            self.chars += sum(map(len, chunks))
            self.index.update(zip(chunks, range(first, first + len(chunks))))

    def whole(self, text: str) -> list[int]:
        """The text as one chunk of its own, or none where its bytes do not come back."""
        self.learn([text], named=False)
        return [] if self.groups[-1] is None else [len(self.groups) - 1]


@lru_cache(maxsize=1)
def _encoder(a_path: str, b_path: str) -> PairEncoder:
    return PairEncoder(a_path, b_path)


def planes_of(row: np.ndarray, place: np.ndarray, times: np.ndarray, rows: int) -> pa.ListArray:
    """Bitmap planes of the entries (row, place, times), ordered by row and place."""
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, row, times)
    n_planes = np.frexp(most.astype(float))[1]
    starts = np.cumsum(n_planes) - n_planes
    keys, places = [], []
    for k in range(int(n_planes.max(initial=0))):
        hit = times >> k & 1 == 1
        keys.append(starts[row[hit]] + k)
        places.append(place[hit])
    key, place = np.concatenate(keys or [row]), np.concatenate(places or [place])
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order].astype("<u2")
    total = int(n_planes.sum())
    count = np.bincount(key, minlength=total)
    dense = np.flatnonzero(count * 2 >= BITMAP)
    sizes = np.where(count * 2 >= BITMAP, BITMAP, count * 2)
    stop = np.cumsum(count)
    data, at = [], 0
    for d in dense:                                    # as bits
        bits = np.zeros(BLOCK_DOCS, bool)
        bits[place[stop[d] - count[d]:stop[d]]] = True
        data += [place[at:stop[d] - count[d]].tobytes(), np.packbits(bits).tobytes()]
        at = stop[d]
    data.append(place[at:].tobytes())
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.BinaryArray.from_buffers(pa.binary(), total, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_planes)]), pa.int32()), values)


def entries_of(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, digit) of every place in the planes; inverse of ``planes_of`` by digits."""
    offsets = np.asarray(planes.offsets)
    values = planes.values
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    at = at[lo:hi + 1].astype(np.int64)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    digit = np.arange(hi - lo) - np.repeat(offsets[:-1] - lo, n)
    sizes = np.diff(at)
    bits = sizes == BITMAP
    listed = np.flatnonzero(~bits)
    places = raw[_spread(at[:-1][listed], sizes[listed])].view("<u2").astype(np.int64)
    value = np.repeat(listed, sizes[listed] // 2)
    if bits.any():
        block = np.unpackbits(raw[_spread(at[:-1][bits], sizes[bits])].reshape(-1, BITMAP), axis=1)
        i, p = np.nonzero(block)
        value, places = np.concatenate([value, np.flatnonzero(bits)[i]]), np.concatenate([places, p])
    return row[value], places, digit[value]


class _Block:
    """Documents gathered until their postings are written."""

    def __init__(self, enc: PairEncoder):
        self.enc, self.docs, self.chunks, self.shas = enc, [], [], []
        self.n_chunks = 0

    def add(self, rid: int, doc_id: int | None, chunks: list[int]) -> None:
        text = "".join(map(self.enc.groups.__getitem__, chunks))[:-1]
        self.shas.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        self.docs.append((rid, doc_id))
        self.chunks.append(chunks)
        self.n_chunks += len(chunks)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        enc, n_docs = self.enc, len(self.docs)
        chunk, sizes = _flat(self.chunks)
        doc = np.repeat(np.arange(n_docs), sizes)
        stats = np.zeros((n_docs, len(STATS)), np.int64)
        for k in range(len(STATS)):
            stats[:, k] = np.diff(np.concatenate([[0], np.cumsum(enc.stats[chunk, k])])[
                np.concatenate([[0], np.cumsum(sizes)])])
        key, times = np.unique(chunk << PLACE_BITS | doc, return_counts=True)
        chunk, doc = key >> PLACE_BITS, key & (BLOCK_DOCS - 1)
        ends = enc.ends[chunk]
        starts = np.where(chunk > 0, enc.ends[chunk - 1], 0)
        n = ends - starts
        key = enc.pairs[_spread(starts, n)].astype(np.int64) << PLACE_BITS | np.repeat(doc, n)
        times = np.repeat(times, n)
        order = np.argsort(key)
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        key = key[first]
        pair, place = key >> PLACE_BITS, key & (BLOCK_DOCS - 1)
        new = np.diff(pair, prepend=-1) != 0
        planes = planes_of(np.cumsum(new) - 1, place, times, int(new.sum()))
        block, n_pairs = self.docs[0][0], len(planes)
        none = [pa.nulls(n_pairs, t) for t in _TYPES]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n_pairs, block), pa.int64()), pa.array(pair[new], pa.int64()), planes, *none[3:]], _NAMES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n_docs, block), pa.int64()), pa.nulls(n_docs, pa.int64()),
             pa.nulls(n_docs, _TYPES[2]), pa.array(np.arange(n_docs), pa.int32()),
             pa.array([d for _, d in self.docs], pa.int64()),
             *[pa.array(stats[:, k], pa.int64()) for k in range(len(STATS))], pa.array(self.shas, pa.string())], _NAMES)


def _encode(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    enc = _encoder(a_path, b_path)
    enc.reset()
    block = _Block(enc)
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            rids, ids, texts = (c.to_pylist() for c in batch.slice(lo, SLICE).columns)
            split = [enc.chunks(" " + t) if t else [] for t in texts]
            wanted = set().union(*split)
            missing = list(wanted.difference(enc.index))
            if missing and enc.full(missing):
                yield from block.rows()
                enc.reset()
                block, missing = _Block(enc), list(wanted)
            if missing:
                enc.learn(missing)
            for rid, doc_id, text, parts in zip(rids, ids, texts, split):
                chunks = list(map(enc.index.__getitem__, parts))
                if any(enc.groups[c] is None for c in chunks):
                    chunks = enc.whole(" " + text)
                block.add(rid, doc_id, chunks)
                if len(block.docs) == BLOCK_DOCS or block.n_chunks >= BLOCK_CHUNKS:
                    yield from block.rows()
                    block = _Block(enc)
    yield from block.rows()


def postings(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds: a pair's planes in a block (place is null), and a document's figures
    with its place in its block (pair is null)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(partial(_encode, a_path=a_path, b_path=b_path), ROWS), "alignment")


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, place, digit = entries_of(b.column("planes"))
        links = np.zeros(b.num_rows, np.int64)
        np.add.at(links, row, np.int64(1) << digit)
        merged = np.unique(row << PLACE_BITS | place) >> PLACE_BITS       # the planes' union
        yield pa.RecordBatch.from_arrays(
            [b.column("pair"), pa.array(np.bincount(merged, minlength=b.num_rows), pa.int64()), pa.array(links)],
            ["pair", "docs", "links"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, pair, docs, links of every linked id pair of the corpus, and whether no other
    pair of its A id is in more documents (``best``)."""
    ship_package(rows.sparkSession)
    held = rows.where("pair IS NOT NULL").select("pair", "planes") \
        .mapInArrow(_popcounts, "pair bigint, docs bigint, links bigint")
    sums = held.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    a = F.shiftright("pair", 16)
    most = F.max("docs").over(Window.partitionBy("a"))                     # a vocabulary's worth at most
    return stored(sums.withColumn("a", a).withColumn("b", F.col("pair").bitwiseAND(0xFFFF))
                  .withColumn("best", F.col("docs") == most), "pair-counts")


OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _scores(table: pa.Table) -> pa.Table:
    """The documents of one block with the sums over their links."""
    place = table.column("place")
    pairs = table.filter(place.is_null()).combine_chunks()
    docs = table.filter(place.is_valid())
    n_best, total = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
    if pairs.num_rows:
        for b in pairs.to_batches():
            row, at, digit = entries_of(b.column("planes"))
            links = np.int64(1) << digit
            np.add.at(total, at, links * b.column("docs").to_numpy()[row])
            np.add.at(n_best, at, links * np.asarray(b.column("best").to_numpy(zero_copy_only=False), bool)[row])
    at = docs.column("place").to_numpy()
    out = {n: docs.column(n) for n in ("doc_id", *STATS)}
    out |= {"n_best": pa.array(n_best[at]), "count_sum": pa.array(total[at]), "groups_sha256": docs.column("groups_sha256")}
    return pa.table({f.split()[0]: out[f.split()[0]] for f in OUT.split(", ")})


def scores(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Every document's figures and scores, returned by its block's postings."""
    counted = rows.where("pair IS NOT NULL").select("block", "pair", "planes") \
        .join(counts.select("pair", "docs", "best"), "pair")
    figures = rows.where("pair IS NULL").select("block", "place", "doc_id", *STATS, "groups_sha256")
    both = counted.drop("pair").unionByName(figures, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(_scores, OUT)


def alignment(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their scores, id pairs with their counts)."""
    rows = postings(docs, a_path, b_path)
    counts = pair_counts(rows)
    return scores(rows, counts), counts
