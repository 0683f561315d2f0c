"""Memory of the Python side of the n-gram join."""

import tracemalloc

import numpy as np
import pyarrow as pa


def test_hashing_takes_a_few_bytes_a_byte_of_text():
    from vigil.llm import ngram_join as nj
    from vigil.llm import textvec as tv
    drawn = np.random.default_rng(5).integers(0, 40_000, (1_500, 350))
    texts = [" ".join(f"w{x:x}" for x in row) for row in drawn] + [None, "", "one two"]
    ids, texts = pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())
    batch = pa.RecordBatch.from_arrays([ids, texts, ids, ids], ["id", "text", "k1", "k2"])
    assert batch.nbytes > 3_000_000

    whole = tv.shingle_sets(*tv.word_hashes(*tv.text_buffers(texts)))   # all texts at once
    want = tv.set_ids(*whole)
    tracemalloc.start()
    try:
        rows = [r for b in nj._members(iter([batch])) for r in b.to_pylist()]
        arrays = {r["cid"]: r["tokens"] for b in nj._token_arrays(iter([batch])) for r in b.to_pylist()[:20]}
        tracemalloc.reset_peak()
        for step in (nj._members, nj._token_arrays):
            for _ in step(iter([batch])):
                pass
        now, held = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held - now < 25_000_000                         # 2 MB of text hashed at once takes 44 MB
    assert [r["n"] for r in rows] == whole[1].tolist()
    assert [r["cid"] for r in rows] == want.view(np.int64).tolist()
    at = np.cumsum(whole[1]) - whole[1]
    sets = {c: whole[0][p:p + n].view(np.int64).tolist()
            for c, p, n in zip(want.view(np.int64).tolist(), at.tolist(), whole[1].tolist())}
    assert len(arrays) >= 20 and all(sets[c] == t for c, t in arrays.items())
