"""Scratch space of the n-gram join: what stays in the shared folder, and which sets move."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from vigil.llm import ngram_join as nj
from vigil.session import checkpoint_dir


def _docs(spark):
    """Texts of their own around one passage of twelve words, near copies, and rows that repeat."""
    draw = random.Random(5)
    own = lambda n: [f"w{draw.randrange(10 ** 9)}" for _ in range(n)]
    passage, rows = own(12), []
    for i in range(60):
        words = own(20 + i) + passage + own(20 + i)
        rows.append((i, " ".join(words)))
        if i % 6 == 0:
            words[3] = "changed"
            rows += [(100 + i, " ".join(words)), (200 + i, " ".join(own(4) + words)), (i, rows[-1][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def _shingles(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def test_stored_tables_go_when_nothing_reads_them(spark):
    docs, _ = _docs(spark)
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert nj.near_duplicate_components(docs).count() == docs.count()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert {"members", "components"} <= left
    assert not left & {"lists", "marked", "probes", "chosen", "probed-lists", "open-lists", "sets"}


def test_sketches_keep_every_linked_pair(spark):
    """Of all pairs, those under the similarity leave unless they are near it; linked ones stay."""
    _, rows = _docs(spark)
    texts = [t for _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    found = [b.to_pylist() for b in nj._sketches(iter([batch]))]
    sets = {frozenset(_shingles(t)) for t in texts}
    assert sorted(r["n"] for b in found for r in b) == sorted(map(len, sets))
    assert all(64 * len(r["bits"]) >= 2 * r["n"] for b in found for r in b)
    tokens = [r for b in nj._token_arrays(iter([batch])) for r in b.to_pylist()]
    real = {r["cid"]: set(r["tokens"]) for r in tokens}
    members = sorted(real, key=lambda c: (len(real[c]), c))
    pairs = [(a, b) for i, a in enumerate(members) for b in members[i + 1:] if 4 * len(real[a]) >= 3 * len(real[b])]
    kept = {tuple(r) for r in nj._possible(
        spark.createDataFrame(pairs, "a long, b long"),
        spark.createDataFrame([(r["cid"], r["n"], r["bits"]) for b in found for r in b], "cid long, n int, bits array<long>"),
        nj.PERCENT).collect()}
    alike = {p: len(real[p[0]] & real[p[1]]) / len(real[p[0]] | real[p[1]]) for p in pairs}
    assert {p for p in pairs if alike[p] >= 0.75} <= kept
    assert not [p for p in kept if alike[p] < 0.4] and len(pairs) > 500


def test_passage_pairs_leave_before_whole_sets_move(spark, monkeypatch):
    """Sets that share a passage only are not stored for the exact comparison."""
    docs, rows = _docs(spark)
    compared = []
    exact = nj._verified
    monkeypatch.setattr(nj, "_verified", lambda p, *a: compared.extend(p.collect()) or exact(p, *a))
    monkeypatch.setattr(nj, "HUB_ROUNDS", 0)
    out = {r.doc_id: r.component_id for r in nj.near_duplicate_components(docs).collect()}
    near = {i for i, _ in rows if i < 60 and i % 6 == 0}
    assert all(out[100 + i] == out[200 + i] == out[i] == i for i in near)
    assert len(set(out.values())) == 60 and len(compared) <= 3 * len(near)


def test_repeated_rows_give_one_set(spark):
    docs, rows = _docs(spark)
    k1, k2 = nj.row_keys("doc_id", "text")
    text = docs.select(F.col("doc_id").alias("id"), "text", k1.alias("k1"), k2.alias("k2")).repartition(5)
    members, _ = nj.link_sets(text)
    sets = nj._sets_of(text, members, members.select("cid").distinct())
    assert sets.count() == sets.select("cid").distinct().count() == len({frozenset(_shingles(t)) for _, t in rows})
