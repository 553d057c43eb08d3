"""DuckDB SQL for the queries that SQL can state over whole tables."""

from __future__ import annotations

from loomtext.llm import chat, secrets

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = vec_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = vec_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    kinds = ((0, secrets.ASSIGN, 2), (1, secrets.ACCESS, 0), (2, secrets.HEX, 0), (3, secrets.CANDIDATE, 0))
    parts = " UNION ALL ".join(
        f"SELECT doc_id, source, {k} AS kind, string_split_regex(text, {_quoted(p)}) AS p, regexp_extract_all(text, {_quoted(p)}) AS m, regexp_extract_all(text, {_quoted(p)}, {g}) AS v FROM d" for k, p, g in kinds
    )
    names = "['" + "', '".join(secrets.KINDS) + "']"
    written = f"{names}[kind + 1] || ':' || st::VARCHAR || ':' || en::VARCHAR"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents), k AS ({parts}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
s AS MATERIALIZED (SELECT doc_id, source, kind, st, st + len(m[i]) AS en, sha256(v[i]) AS hash, v[i] AS val FROM (
  SELECT *, (list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::BIGINT AS st FROM u) WHERE kind <> 0 OR len(v[i]) >= {secrets.ASSIGN_LEAST}),
found AS MATERIALIZED (SELECT doc_id, source, kind, st, en, hash FROM s WHERE kind < 3 UNION ALL
  SELECT doc_id, source, kind, st, en, hash FROM s WHERE kind = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]')
  AND NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = s.doc_id AND b.kind < 3 AND b.st < s.en AND s.st < b.en)),
owners AS (SELECT hash, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT doc_id) AS repositories FROM found GROUP BY hash),
judged AS (SELECT found.*, owners < {secrets.COPIED_OWNERS} AND repositories < {secrets.COPIED_REPOSITORIES} AS live FROM found JOIN owners USING (hash)),
per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  coalesce(string_agg({written}, ',' ORDER BY st, kind) FILTER (WHERE kind < 3), '') AS base, coalesce(string_agg({written}, ',' ORDER BY st, kind) FILTER (WHERE kind < 3 OR live), '') AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_copied FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN per USING (doc_id)
"""


def chat_format() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for c in chat.CONTROL:
            out = f"replace({out}, {_quoted(c)}, {_quoted(c[0] + chr(92) + c[1:])})"
        return out

    frame = len(chat.OPEN) + len(chat.SEPARATOR) + len(chat.CLOSE)
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length({escaped('role')}) + length({escaped('text')}) + {frame})::BIGINT AS formatted_chars FROM t GROUP BY conv_id
"""


NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(l) >= 3 THEN list_distinct(list_transform(range(1, len(l) - 1), lambda i: md5_number(l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])))
    WHEN len(l) > 0 THEN [md5_number(array_to_string(l, ' ') || ' .')] ELSE [] END AS s FROM w
), n AS MATERIALIZED (SELECT doc_id, s, len(s) AS n FROM s),
p AS MATERIALIZED (SELECT doc_id, n, unnest(list_sort(s)[1:(n - ceil(0.85 * n)::BIGINT + 1)]) AS x FROM n WHERE n > 0),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n m ON m.doc_id = c.a JOIN n k ON k.doc_id = c.b
  WHERE 185 * len(list_intersect(m.s, k.s)) >= 85 * (m.n + k.n)),
e AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = n.doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS l FROM documents), b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS l FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(l[i:i + n - 1], ' ') AS key FROM (SELECT item, l, least(len(l), 10) AS n, unnest(range(1, greatest(len(l) - 10, 0) + 2)) AS i FROM b WHERE len(l) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(l[i:i + n - 1], ' ') AS key FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(l) >= n)),
hits AS MATERIALIZED (SELECT doc_id, i, n, item FROM dw JOIN iw USING (n, key)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

REPEATS = r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
starts AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS opens FROM w SEMI JOIN again USING (k)),
runs AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, z FROM runs),
pw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
pk AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(l[i + 1:i + 51], ' ')) AS k FROM (SELECT doc_id, l, unnest(range(len(l) - 50)) AS i FROM pw WHERE len(l) > 50)),
shared AS (SELECT k FROM pk GROUP BY k HAVING count(DISTINCT doc_id) > 1),
opened AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 51 THEN 0 ELSE 1 END AS opens FROM pk SEMI JOIN shared USING (k)),
passages AS (SELECT doc_id, min(i) AS a, max(i) + 51 AS z FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM opened) GROUP BY doc_id, run),
counted AS (SELECT doc_id, count(*) AS n_passages, sum(z - a)::BIGINT AS n_shared_words FROM passages GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS part FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(n_shared_words, 0) AS n_shared_words, coalesce(n_passages, 0) AS n_passages,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE part || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

ORACLE_SQL = {
    "op1_embedding_dedup": EMBEDDINGS,
    "op2_secret_scan": secret_scan(),
    "op4_minhash_dedup": NEAR_DUPLICATES,
    "op5_repeated_passages": REPEATS,
    "op7_chat_format": chat_format(),
    "op8_decontaminate": CONTAMINATION,
}
