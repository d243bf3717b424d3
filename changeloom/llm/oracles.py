"""DuckDB SQL for the results that SQL can express."""

from __future__ import annotations

#: The six blanks of `[\x20\x09-\x0D]`, for trim().
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND s.first <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS ps FROM documents),
p AS (SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS pos FROM d),
k AS (SELECT *, trim(regexp_replace(translate(piece, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key FROM p),
w AS (SELECT doc_id, pos, key, len(string_split(key, ' ')) AS n FROM k WHERE key <> ''),
c AS (SELECT doc_id, pos, n, row_number() OVER v AS place, sum(n) OVER v AS words, count(*) OVER (PARTITION BY doc_id) AS total FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT a.doc_id, a.place, a.pos, least(greatest(a.words - a.n + 20, coalesce(b.words, a.words + 40)), a.words - a.n + 40) AS goal FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id AND b.place = a.place + least(2, a.total) - 1),
e AS (SELECT t.doc_id, t.place, t.pos, min(c.place) AS final FROM t JOIN c ON c.doc_id = t.doc_id AND c.words >= t.goal GROUP BY ALL),
l AS (SELECT doc_id, list(key ORDER BY pos) AS ks, list(pos ORDER BY pos) AS places FROM w GROUP BY doc_id),
f AS (SELECT doc_id, pos, places[final] AS stop, row_number() OVER (PARTITION BY array_to_string(ks[place:final], chr(10)) ORDER BY doc_id, pos) AS turn FROM e JOIN l USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, stop + 1)) AS pos FROM f WHERE turn > 1),
m AS (SELECT k.doc_id, count(*)::BIGINT AS n_sentences, count(g.pos)::BIGINT AS n_removed, string_agg(piece, '' ORDER BY k.pos) FILTER (WHERE g.pos IS NULL) AS kept
  FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.pos = k.pos GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id)
"""

ORACLES = {"op2_line_dedup": OP2, "op10_sentence_spans": OP10}
