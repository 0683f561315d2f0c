"""Cross-tokenizer alignment against brute force on whole texts."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair string, block string, Planes string"


def _spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(rows):
    """Tokens of whole texts, links by interval overlap, counts by a dictionary."""
    import sentencepiece
    import tokenizers
    ta = tokenizers.Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found, held = [], Counter()
    for doc_id, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        x = [bytes(byte_of[c] for c in ta.id_to_token(i)) for i in a]
        y = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else
             sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + text).encode() if text else None
        if b"".join(x) != raw or b"".join(y) != raw:
            found.append((doc_id, 0, 0, 0, None, ""))
            continue
        sa, sb = _spans(x), _spans(y)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([], []) for _ in ends]
        for side, ids, spans in ((0, a, sa), (1, b, sb)):
            for i, (_, e) in zip(ids, spans):
                groups[bisect.bisect_left(ends, e)][side].append(str(i))
        links = Counter((i, j) for i, (s, e) in zip(a, sa) for j, (p, q) in zip(b, sb) if s < q and p < e)
        held.update(links.keys())
        digest = hashlib.sha256(";".join(",".join(g) + "|" + ",".join(h) for g, h in groups).encode()).hexdigest()
        found.append((doc_id, len(a), len(b), len(ends), links, digest))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return sorted(((d, n, m, g, sum(c.values()), sum(k for p, k in c.items() if held[p] == best[p[0]]),
                    sum(k * held[p] for p, k in c.items()), h) if c is not None else (d, 0, 0, 0, 0, 0, 0, "")
                   for d, n, m, g, c, h in found), key=str), held


def _texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abdeilnorstuéñ") for _ in range(rng.randrange(1, 11)))
    said = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", " ", "  ", "\n", "a ", " a", "  a  b ", "\na\n\nb \n c", "a\t\tb", "x\r\ny };\r\n", "a b",
             "a  b", "▁", "a ▁ b", "don't we'll", "<|endoftext|> x<|endoftext|>y", "<s> </s> <unk> <0x0A>",
             "日本語のテキスト", "👩‍👩‍👧 ok", "a\x00b", "1234567 3.14", "!!!??", "é" * 300, said(2000), "word " * 700,
             "z" * 3000, said(30), "x\x1c y", "　a"]
    texts += [said(rng.randrange(1, 60)) for _ in range(40)]
    return texts + texts[-5:]


def test_scores_equal_brute_force(spark):
    from vigil.llm.alignment import alignment
    rows = [(i, t) for i, t in enumerate(_texts())] + [(None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    scored, counts = alignment(docs, A, B)
    expected, held = brute(rows)
    assert sorted((tuple(r) for r in scored.collect()), key=lambda r: str((*r[:5], *r[5:]))) == expected
    assert {(r.a, r.b): r.docs for r in counts.collect()} == dict(held)
    assert all(r.links >= r.docs for r in counts.collect())


def test_empty_table(spark):
    from vigil.llm.alignment import alignment
    scored, counts = alignment(spark.createDataFrame([], SCHEMA), A, B)
    assert scored.collect() == [] and counts.collect() == []


@pytest.mark.parametrize("share", [0.001, 0.2, 0.9])
def test_planes_round_trip(share):
    from vigil.llm.alignment import BLOCK_DOCS, entries_of, planes_of
    rng = np.random.default_rng(3)
    row, place, times = [], [], []
    for r in range(6):
        at = np.flatnonzero(rng.random(BLOCK_DOCS) < (share if r % 2 else 0.01))
        if not len(at):
            at = np.array([r])
        row += [r] * len(at)
        place += at.tolist()
        times += rng.integers(1, 2 if r == 3 else 40, len(at)).tolist()
    planes = planes_of(np.array(row), np.array(place), np.array(times), 6)
    for lo, hi in ((0, 6), (2, 5)):                        # also as a slice of the array
        got = Counter()
        for r, p, k in zip(*entries_of(planes.slice(lo, hi - lo))):
            got[r + lo, p] += 1 << k
        assert got == {(r, p): t for r, p, t in zip(row, place, times) if lo <= r < hi}


def test_blocks_and_cache_resets(monkeypatch):
    """Small blocks and a cache that overflows give the same documents."""
    import pyarrow as pa

    from vigil.llm import alignment
    monkeypatch.setattr(alignment, "CACHE", 60)
    monkeypatch.setattr(alignment, "BLOCK_CHUNKS", 100)
    monkeypatch.setattr(alignment, "SLICE", 4)
    texts = _texts()
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64())] * 2 + [pa.array(texts, pa.string())], ["rid", "doc_id", "text"])
    out = [b for b in alignment._encode(iter([batch]), A, B)]
    table = pa.Table.from_batches(out).to_pylist()
    expected, held = brute(list(enumerate(texts)))
    docs = [r for r in table if r["pair"] is None]
    assert len({r["block"] for r in docs}) > 3
    assert sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in docs),
                  key=str) == sorted(((*r[:5], r[7]) for r in expected), key=str)
    sums = Counter()
    for b in alignment._popcounts(x for x in out if x.column("pair").null_count == 0):
        for pair, n in zip(b.column("pair").to_pylist(), b.column("docs").to_pylist()):
            sums[pair >> 16, pair & 0xFFFF] += n
    assert sums == held
