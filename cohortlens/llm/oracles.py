"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_WORDS = r"[^\x20\x09-\x0D]+"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body,
             octet_length(encode(coalesce(html, ''))) AS size FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last_id FROM p),
r AS (SELECT *, size >= 1000 AND page_id < last_id AS again FROM q)
SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN last_id END AS refers_to
FROM r"""

OP5 = f"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{_WORDS}') AS ws
  FROM documents),
words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM listed),
grams AS (SELECT doc_id, n, pos, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM words),
shingles AS (SELECT DISTINCT doc_id, gram FROM grams WHERE pos <= greatest(n - 4, 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes su ON su.doc_id = u JOIN sizes sv ON sv.doc_id = v
  WHERE 100 * c >= 75 * (su.n + sv.n - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
# kind, pattern, group to measure, least length
_SECRETS = (
    ("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", 0, 1),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)


def _secret_matches(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {order} AS ord, '{kind}' AS kind, stop - length(hit) AS start, stop FROM (
  SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS hits,
            string_split_regex(text, '{quoted}') AS gaps
          FROM documents WHERE text IS NOT NULL)))
WHERE length(regexp_extract(hit, '{quoted}', {group})) >= {least}"""


_SPAN = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord)"

OP8 = f"""
WITH spans AS ({' UNION ALL '.join(_secret_matches(i, *r) for i, r in enumerate(_SECRETS))}),
per_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    {_SPAN} FILTER (ord < 3) AS base_spans, {_SPAN} AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(base_spans, '') AS base_spans
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id"""

OP10 = f"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM listed),
runs AS (SELECT *, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run FROM words),
starts AS (SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k
    FROM runs WHERE pos <= n - 19) WHERE k > 1),
marked AS (SELECT w.doc_id, w.word, w.pos, coalesce(max(s.pos) OVER (
    PARTITION BY w.doc_id ORDER BY w.pos ROWS UNBOUNDED PRECEDING) >= w.pos - 19, false) AS gone
  FROM words w LEFT JOIN starts s ON s.doc_id = w.doc_id AND s.pos = w.pos),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS body FROM marked GROUP BY doc_id)
SELECT l.doc_id, len(l.ws) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON k.doc_id = l.doc_id"""

# --- vector codes: three assignments, two moves, unrolled -----------------------

_FINITE = "list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))"


def _assign(k: int) -> str:
    """Nearest entry of every part for codebook ``k``: least distance, then least index."""
    return f"""pairs{k} AS (SELECT p.vec_row, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d
    FROM cells p JOIN book{k} b ON b.part = p.part AND b.pos = p.pos GROUP BY ALL),
near{k} AS (SELECT vec_row, part, entry, d FROM (SELECT *, row_number() OVER (
    PARTITION BY vec_row, part ORDER BY d, entry) AS o FROM pairs{k}) WHERE o = 1)"""


def _move(k: int) -> str:
    """Codebook ``k + 1``: floors of the means; the remainder is taken off before the division."""
    return f"""sums{k} AS (SELECT n.part, n.entry, c.pos, sum(c.x) AS s, count(*) AS n
    FROM near{k} n JOIN cells c ON c.vec_row = n.vec_row AND c.part = n.part GROUP BY ALL),
book{k + 1} AS (SELECT b.part, b.entry, b.pos,
    CAST(coalesce((s - (s % n + n) % n) // n, b.x) AS BIGINT) AS x
  FROM book{k} b LEFT JOIN sums{k} s ON s.part = b.part AND s.entry = b.entry AND s.pos = b.pos)"""


OP11 = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS vec_row, vec_id, label, embedding,
    len(embedding) // 16 AS width
  FROM embeddings WHERE embedding IS NOT NULL AND len({_FINITE}) = 0),
flat AS (SELECT vec_row, width, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS spot FROM kept),
cells AS MATERIALIZED (SELECT vec_row, spot // width AS part, spot % width AS pos,
    CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM flat),
book0 AS (SELECT part, vec_row - 1 AS entry, pos, x FROM cells WHERE vec_row <= 64),
{_assign(0)}, {_move(0)}, {_assign(1)}, {_move(1)}, {_assign(2)},
named AS (SELECT vec_row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
    CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_row),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS digest FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  digest AS codebooks_sha256
FROM kept JOIN named USING (vec_row) CROSS JOIN books"""

_TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def _group(k: int) -> str:
    return f"CAST(CAST('0x' || substr(h, {8 * k + 1}, 8) AS UBIGINT) AS BIGINT)"


OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
t AS (SELECT *, regexp_extract_all(body, '{_TOKENS}') AS ws, {_group(0)} AS h1, {_group(1)} AS h2,
    {_group(2)} AS h3, {_group(3)} AS h4 FROM d),
c AS (SELECT *, len(ws) AS n, least(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) AS lo,
    greatest(h1 % (len(ws) + 1), h2 % (len(ws) + 1)) AS hi,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
      OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(ws[1:lo], '') AS a, array_to_string(ws[lo + 1:hi], '') AS m,
    array_to_string(ws[hi + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(a) END AS prefix_chars,
  CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
    WHEN 'spm' THEN '<S>' || s || '<P>' || a || '<M>' || m ELSE body END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM p"""

ORACLE = {"op1_warc": OP1, "op5_bbit_minhash": OP5, "op8_secrets": OP8, "op10_substring_dedup": OP10,
          "op11_hadamard_codes": OP11, "op12_fill_in_middle": OP12}
