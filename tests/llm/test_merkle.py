"""Merkle manifest against a brute-force tree."""

import hashlib
import zlib

import pytest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _siblings(levels, at):
    for nodes in levels[:-1]:
        other = at ^ 1
        yield (nodes[other] if other < at else "", nodes[other] if at < other < len(nodes) else "")
        at >>= 1


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        mine = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        built[name] = mine, _levels([_leaf(r) for r in mine])
    top = _levels([built[x][1][-1][0] for x in names])
    root, out = top[-1][0] if names else None, []
    for k, name in enumerate(names):
        mine, levels = built[name]
        for at, r in enumerate(mine):
            path = [*_siblings(levels, at), *_siblings(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = _leaf(r, int(hit))
            for left, right in path:
                folded = _h(left, folded, right)
            out.append((r[0], _leaf(r), levels[-1][0], root, _h(*(a + b for a, b in path)), folded, folded == root))
    return sorted(out, key=str)


def _rows():
    rows = [(i, f"s{i % 3}", ("en", "de", "fr")[i % 5 % 3], 10 * i, f"text {i}") for i in range(75)]
    rows += [(i, None, "one" if i == 200 else "", None, "é" * i) for i in range(200, 209)]
    rows += [(None, None, None, None, None), (None, "s", None, 3, ""), (7, "other", "en", 1, None),
             (9, "s0", "ünï", 4, "x y" * 200_000), rows[3], rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("stride", [1, 2, 10])
def test_manifest_equals_brute_force(spark, stride):
    from vigil.llm.merkle import manifest
    rows = _rows()
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, "
                                 "hash string, Tree string, pos string").repartition(5)
    got = manifest(docs, stride)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_lone_leaf_and_empty_table(spark):
    from vigil.llm.merkle import manifest
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(1, "s", "en", 2, "ab")]
    assert [tuple(r) for r in manifest(spark.createDataFrame(one, schema)).collect()] == brute(one)
    assert manifest(spark.createDataFrame([], schema)).collect() == []


def test_chunked_node_copies(spark, monkeypatch):
    """High nodes are stored once for every chunk of leaves; no leaf meets two of them."""
    from vigil.llm import merkle
    monkeypatch.setattr(merkle, "CHUNK", 8)
    rows = [(i, "s", "en" if i % 9 else "de", i, "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted((tuple(r) for r in merkle.manifest(docs, 3).collect()), key=str) == brute(rows)


def test_oracle_agrees(spark, tmp_path):
    import duckdb

    from vigil.llm import queries
    rows = [r for r in _rows() if r[0] != 9]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(queries.ORACLES["op13_merkle"])
    names = [d[0] for d in res.description]
    got = queries.op13_merkle(spark, str(tmp_path))
    assert names == got.columns
    assert sorted(res.fetchall(), key=str) == sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
