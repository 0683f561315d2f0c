"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

#: crc32 of the decimal ids: ``id_crc(doc_id, crc)``, from the polynomial alone
ID_CRC = """
crc_step(i, s, v) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256))::UBIGINT AS i)
  UNION ALL
  SELECT i, s + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM crc_step WHERE s < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_step WHERE s = 8),
crc_run(doc_id, k, c) AS (
  SELECT doc_id, 0, 4294967295::UBIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, k + 1, xor(c >> 8, t[((xor(c, ascii(substr(doc_id::VARCHAR, k + 1, 1))::UBIGINT) & 255) + 1)::BIGINT])
  FROM crc_run, crc_table WHERE k < length(doc_id::VARCHAR)),
id_crc AS (SELECT doc_id, xor(c, 4294967295::UBIGINT) AS crc FROM crc_run WHERE k = length(doc_id::VARCHAR))"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("d.doc_id", "source", "lang", chars, "text")) + ")"


_UP = ("list_transform(range(0, (len(hs) + 1) // 2), "
       "lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], '')))")

OP13 = f"""WITH RECURSIVE {ID_CRC},
lf AS (SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
       FROM (SELECT d.doc_id, lang, {_leaf('n_chars')} AS leaf,
                    {_leaf('n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END')} AS found
             FROM documents d LEFT JOIN id_crc c ON d.doc_id = c.doc_id)),
lv(lang, k, hs) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM lf GROUP BY lang
  UNION ALL SELECT lang, k + 1, {_UP} FROM lv WHERE len(hs) > 1),
sub AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM lv WHERE len(hs) = 1),
tp(k, hs) AS (
  SELECT 0, list(subroot ORDER BY rank) FROM sub
  UNION ALL SELECT k + 1, {_UP} FROM tp WHERE len(hs) > 1),
step AS (
  SELECT id, 0 AS phase, k, pos >> k AS place, hs FROM lf JOIN lv ON lf.lang IS NOT DISTINCT FROM lv.lang WHERE len(hs) > 1
  UNION ALL
  SELECT id, 1, k, rank >> k, hs FROM lf JOIN sub ON lf.lang IS NOT DISTINCT FROM sub.lang, tp WHERE len(hs) > 1),
proof AS (
  SELECT id, list({{'l': CASE WHEN place % 2 = 1 THEN hs[place] ELSE '' END,
                    'r': CASE WHEN place % 2 = 0 THEN coalesce(hs[place + 2], '') ELSE '' END}} ORDER BY phase, k) AS p
  FROM step GROUP BY id),
climb(id, i, h) AS (
  SELECT id, 0, found FROM lf
  UNION ALL
  SELECT c.id, i + 1, sha256(p[i + 1].l || h || p[i + 1].r) FROM climb c JOIN proof USING (id) WHERE i < len(p))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(p, lambda x: x.l || x.r), 'string_agg', ''), ''))
         AS proof_sha256, h AS folded_root, h = root AS verified
FROM lf JOIN sub ON lf.lang IS NOT DISTINCT FROM sub.lang LEFT JOIN proof USING (id)
JOIN climb ON climb.id = lf.id AND i = coalesce(len(p), 0), (SELECT hs[1] AS root FROM tp WHERE len(hs) = 1)"""

#: products of whole numbers; their sums are exact in double up to 2 ** 53
OP8 = """WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.rid AS qrid, a.vec_id AS query_id, b.vec_id, b.rid, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qrid ORDER BY score DESC, vec_id, rid) AS rank FROM s) WHERE rank <= 5"""
