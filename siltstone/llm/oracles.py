"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

CHAT_FORMATTING = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS t,
 regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS o FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(t) + length(o) + 8) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

DEBRUIJN_DEDUP = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(v) - 11)) AS i, v FROM w WHERE len(v) >= 13),
k AS (SELECT doc_id, i, md5(array_to_string(v[i:i + 12], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first_doc FROM k GROUP BY h),
g AS (SELECT DISTINCT k.doc_id, i + o AS i FROM k JOIN f ON f.h = k.h AND f.first_doc < k.doc_id, range(13) r(o)),
d AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(v) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(array_to_string(CASE WHEN gone IS NULL THEN v ELSE list_filter(v, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN d ON d.doc_id = w.doc_id"""

SUFFIX_ARRAY_DEDUP = r"""WITH w AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(CAST(length(x) // 2 - 49 AS BIGINT), 0))) AS i, x FROM w),
k AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 100)) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first_doc FROM k GROUP BY h),
s AS (SELECT k.doc_id, i, lag(i) OVER (PARTITION BY k.doc_id ORDER BY i) AS before FROM k JOIN f ON f.h = k.h AND f.first_doc < k.doc_id),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
g AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM u),
c AS (SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)) || CASE WHEN back = 1 THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM g JOIN w ON w.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT w.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM w LEFT JOIN c ON c.doc_id = w.doc_id"""
