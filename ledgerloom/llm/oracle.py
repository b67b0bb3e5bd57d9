"""SQL counterparts of the registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _hits(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT row_id, {rank} AS rank, '{kind}' AS kind, unnest(generate_series(1, len(hits))) AS i, hits, vals, gaps, {least} AS least
    FROM (SELECT row_id, regexp_extract_all(body, '{pattern}', 0) AS hits, regexp_extract_all(body, '{pattern}', {group}) AS vals,
                 regexp_split_to_array(body, '{pattern}') AS gaps FROM texts) WHERE len(hits) > 0"""


OP1 = f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents),
hits AS ({" UNION ALL ".join(_hits(*x) for x in (
    (0, "assign", _ASSIGN, 2, 6), (1, "access", "AKIA[A-Z0-9]+", 0, 20), (2, "hex", "[0-9a-f]+", 0, 24),
    (3, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    (4, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1)))}),
kept AS (SELECT * FROM hits WHERE length(vals[i]) >= least),
spans AS (
    SELECT row_id, rank, kind,
           coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
           length(hits[i]) AS n
    FROM kept),
told AS (SELECT row_id, rank, kind, start, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS span FROM spans)
SELECT t.doc_id,
       count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM texts t LEFT JOIN told USING (row_id) GROUP BY t.row_id, t.doc_id
"""

_MARKED = "[#*$%&|<>!]{2,}"
_BARS = "(?:^|[\\x20\\x09])[|>»•·]"


def _op2() -> str:
    from .quality import BARS, MARKS, PHRASES

    marks = MARKS.replace("'", "''")
    phrases = " OR ".join(f"contains(lower(line), '{p}')" for p in PHRASES)
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents),
words AS (SELECT row_id, regexp_extract_all(body, '{_WORD}') AS w FROM texts),
wins AS (SELECT row_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT row_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM words)),
again AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, win) AS c FROM wins) WHERE c > 1),
cover AS (SELECT row_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) r(k) GROUP BY row_id),
lines AS (SELECT row_id, unnest(string_split(body, chr(10))) AS line FROM texts),
marks AS (SELECT row_id, line, len(regexp_extract_all(line, '{_WORD}')) AS nw, len(regexp_extract_all(line, '{_MARKED}')) AS nm,
                 len(list_filter(string_split_regex(line, '[\\x20\\x09]'), lambda x: x IN ('|', '>', '»', '•', '·'))) AS nb,
                 length(line) - length(translate(line, '{marks}', '')) AS na, length(line) - length(translate(line, '{BARS}', '')) AS nbar,
                 len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D{BARS}]+')) AS items,
                 length(translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) AS nc FROM lines),
judged AS (SELECT row_id, line, nw,
       (nw >= 4 AND nm > 0.3 * nw) OR (nb >= 3 AND nw - nb <= 3 * nb) OR (length(line) <= 480 AND nw <= 12 AND ({phrases}))
           OR (na >= 5 AND na > 0.6 * nc) OR (nbar >= 3 AND items <= 2 * nbar) AS bad, nc FROM marks),
per AS (SELECT row_id, coalesce(count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0), 0) AS n_dup_lines,
       count(*) FILTER (bad) AS n_bad_lines, coalesce(sum(nc) FILTER (bad), 0)::BIGINT AS lost_chars, sum(nc)::BIGINT AS word_chars FROM judged GROUP BY row_id),
res AS (SELECT doc_id, len(w) AS n_words, word_chars, length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols, n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words, n_bad_lines, lost_chars
       FROM texts JOIN words USING (row_id) JOIN per USING (row_id) LEFT JOIN cover USING (row_id)),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM res)
SELECT *, NOT base_failed AND lost_chars <= 0.3 * word_chars AS kept FROM based
"""


_ESC = "replace(replace(replace(replace({0}, '\\', '\\\\'), '### ', '##\\# '), '</turn>', '<\\/turn>'), '</part>', '<\\/part>')"
OP4 = f"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
before AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, body) AS prev FROM rows),
sized AS (SELECT *, length({_ESC.format('body')}) + CASE WHEN prev = role THEN 7
       ELSE 6 + length(replace({_ESC.format('role')}, ':', '<\\c>')) + CASE WHEN prev IS NULL THEN 0 ELSE 8 END END AS n FROM before)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       coalesce(sum(length(body)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(n) + 8)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP8 = """
WITH vecs AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asking AS (SELECT vec_id, min(v) AS v FROM vecs WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM asking q JOIN vecs c ON c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

OP7 = """
WITH RECURSIVE every AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL),
lines AS (SELECT * FROM (SELECT {'nil': doc_id IS NULL, 'doc': doc_id, 'no': no} AS place, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM every) WHERE line <> ''),
cls AS (SELECT line, min(place) AS first FROM lines GROUP BY line),
long AS (SELECT * FROM cls WHERE length(line) >= 20),
gone AS (SELECT line, first, i, left(line, i - 1) || substr(line, i + 1) AS v
    FROM (SELECT line, first, unnest(generate_series(1, length(line))) AS i FROM long)),
pairs AS (
    SELECT a.line, b.line AS other, b.first FROM gone a JOIN gone b ON a.i = b.i AND a.v = b.v AND a.line <> b.line
    UNION ALL SELECT a.line, b.line, b.first FROM gone a JOIN long b ON a.v = b.line
    UNION ALL SELECT b.line, a.line, a.first FROM gone a JOIN long b ON a.v = b.line),
near AS (SELECT p.line, min({'first': p.first, 'line': p.other}) AS o FROM pairs p JOIN cls c ON c.line = p.line WHERE p.first < c.first GROUP BY p.line),
chain AS (SELECT line, o FROM near UNION ALL SELECT c.line, n.o FROM chain c JOIN near n ON n.line = c.o.line),
ends AS (SELECT c.line, c.o.first AS kept FROM chain c ANTI JOIN near n ON n.line = c.o.line)
SELECT l.place.doc AS doc_id, l.place.no::BIGINT AS line_no, coalesce(n.kept, c.first).doc AS kept_doc_id, coalesce(n.kept, c.first).no::BIGINT AS kept_line_no, n.kept IS NOT NULL AS near
FROM lines l JOIN cls c USING (line) LEFT JOIN ends n USING (line)
WHERE n.kept IS NOT NULL OR l.place <> c.first
"""

OP11 = """
WITH vecs AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asking AS (SELECT vec_id, min({'label': label, 'v': v}) AS q FROM vecs WHERE vec_id % 100 = 0 GROUP BY vec_id),
scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.q.label = c.label AS same, list_inner_product(a.q.v, c.v)::BIGINT AS score
    FROM asking a JOIN vecs c ON c.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same QUALIFY place <= 5),
ranked AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

# Costs, edits and turns so far of every state after every row, spelt out; the checksum bit by bit.
OP12 = """
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS body,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
summed AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda ch: ord(ch)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM raw),
fated AS (SELECT *, xor(crc, 4294967295) % 20 AS fate FROM summed),
spoilt AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(body, '.!?', '') ELSE body END AS body
    FROM fated, range(2) AS t(copy) WHERE copy < CASE WHEN fate = 0 THEN 0 WHEN fate = 3 THEN 2 ELSE 1 END),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS i FROM spoilt),
told AS (
    SELECT conv_id, i, turn, role, body, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
        NOT regexp_matches(body, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, body ORDER BY i) > 1 AS again,
        right(rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut FROM placed),
rows AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS extra FROM told),
everyone AS (SELECT DISTINCT conv_id FROM conversations),
filled(a, b, edits, cost, made) AS (VALUES
    ('0', '0', '', 0, []::VARCHAR[]), ('0', 'u', 'I', 3, ['user:']), ('0', 'a', 'II', 6, ['user:', 'assistant:']), ('s', 's', '', 0, []), ('s', 'u', 'I', 3, ['user:']),
    ('s', 'a', 'II', 6, ['user:', 'assistant:']), ('u', 'u', '', 0, []), ('u', 'a', 'I', 3, ['assistant:']), ('a', 'a', '', 0, []), ('a', 'u', 'I', 3, ['user:'])),
after(b, following) AS (VALUES ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
dp AS (
    SELECT conv_id, 0::BIGINT AS i, '0' AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS made FROM everyone
    UNION ALL
    SELECT * FROM (
        SELECT d.conv_id, r.i, CASE WHEN e.edit = 'D' THEN f.b WHEN e.edit = 'K' THEN r.initial ELSE n.following END AS state,
            d.cost + f.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 + r.extra ELSE r.extra END AS cost, d.audit || f.edits || e.edit AS audit,
            d.made || f.made || CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.body]
                ELSE [CASE n.following WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || r.body] END AS made
        FROM dp d JOIN rows r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1 JOIN filled f ON f.a = d.state JOIN after n ON n.b = f.b
            JOIN (VALUES ('D'), ('K'), ('R')) AS e(edit) ON e.edit = 'D' OR NOT r.gone AND (e.edit = 'R' OR r.initial = n.following OR r.initial = 's' AND f.b = '0'))
    QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
ends AS (SELECT * FROM (
    SELECT d.conv_id, d.cost + CASE d.state WHEN 's' THEN 6 WHEN 'u' THEN 3 ELSE 0 END AS cost, d.audit || CASE d.state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
        d.made || CASE d.state WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE []::VARCHAR[] END AS made
    FROM dp d JOIN (SELECT e.conv_id, count(r.i) AS n FROM everyone e LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id GROUP BY e.conv_id) c
        ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.n = d.i)
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
faults AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
        count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT e.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
    coalesce(f.illegal, 0) AS illegal, e.cost::BIGINT AS cost, e.audit, sha256(array_to_string(e.made, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLE: dict[str, str] = {
    "op1_secret_scan": OP1, "op2_line_quality": _op2(), "op4_chat_format": OP4, "op7_line_dedup": OP7, "op8_pivot_topk": OP8,
    "op11_hard_negatives": OP11, "op12_conversation_repair": OP12,
}
