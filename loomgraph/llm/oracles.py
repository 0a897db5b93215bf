"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from loomgraph.llm.hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES
from loomgraph.llm.quality_rules import BASE_LIMIT, LINE_LIMIT, MIN_WORDS, NGRAMS
from loomgraph.llm.sharding import OVERHEAD, SHARDS, WHOLE

_WORDS = r"list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '')"

_GRAM = """
  g{n} AS (
    SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {n} - 1), ' ') AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM w)),
  c{n} AS (
    SELECT doc_id, count(*) AS n, sum(length(ws[p]))::BIGINT AS chars FROM (
      SELECT DISTINCT doc_id, i + k AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g{n}),
        range({n}) r(k)
      WHERE times > 1) JOIN w USING (doc_id) GROUP BY doc_id)"""

_OP1 = f"""
WITH w AS (SELECT doc_id, text, {_WORDS} AS ws FROM documents),
  l AS (
    SELECT doc_id, line, list_sum(list_transform({_WORDS.replace("coalesce(text, '')", "line")}, lambda x: length(x)))::BIGINT AS chars
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
  d AS (
    SELECT doc_id, sum(times - 1)::BIGINT AS n, sum(CASE WHEN times > 1 THEN chars ELSE 0 END)::BIGINT AS chars
    FROM (SELECT doc_id, line, count(*) AS times, sum(chars) AS chars FROM l GROUP BY doc_id, line) GROUP BY doc_id),
  {",".join(_GRAM.format(n=n) for n in NGRAMS)},
  a AS (
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(d.chars, 0)::BIGINT AS dup_line_chars,
      coalesce(c8.n, 0)::BIGINT AS n_repeat_words,
      {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in NGRAMS)}
    FROM w LEFT JOIN d USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in NGRAMS)})
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_LIMIT} * n_words)
    AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars
    AND {" AND ".join(f"100 * dup_chars_{n} <= {limit} * word_chars" for n, limit in NGRAMS.items())} AS kept
FROM a"""

# CRC-32 from its definition: the table of the reflected polynomial, then a step a byte.
_CRC = """
  t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b::BIGINT)) AS crc),
  b AS (SELECT doc_id, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
      lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1]), 4294967295))::BIGINT AS text_crc32, row_number() OVER () AS r FROM documents, t)"""

_OP11 = f"""
WITH {_CRC.strip()},
  d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
  k AS (SELECT doc_id, r, strlen(text)::BIGINT + {OVERHEAD} AS size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h FROM d),
  s AS (SELECT *, row_number() OVER o - 1 AS row, sum(size) OVER o - size AS byte, sum(size) OVER () AS total FROM k
    WINDOW o AS (ORDER BY h, doc_id NULLS FIRST, r ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, min(byte) OVER (PARTITION BY h) AS group_byte, sum(size) OVER (PARTITION BY h) AS group_size FROM s),
  p AS (SELECT *, ({SHARDS} * (CASE WHEN group_size * {SHARDS * WHOLE} <= total THEN 2 * group_byte + group_size ELSE 2 * byte + size END) // (2 * total))::INT AS shard FROM g)
SELECT p.doc_id, size, text_crc32, 'bytes' AS law, shard, row - min(row) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard
FROM p JOIN b USING (r)"""

_OP13 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
  s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, v.r, list_dot_product(a.v, v.v)::BIGINT AS score
    FROM (SELECT * FROM v WHERE vec_id % 100 = 0) a, v WHERE a.r <> v.r),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST)::INT AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}"""

ORACLES = {"op1_quality_rules": _OP1, "op13_hard_negatives": _OP13, "op11_sharding": _OP11}
