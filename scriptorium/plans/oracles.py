"""DuckDB SQL for the engine's own queries, written apart from their plans."""

from __future__ import annotations

from scriptorium.functions.text import NAME_BYTES
from scriptorium.operators.manifest import PROMPT

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_DOCS = rf"""
docs AS (
    SELECT CAST(doc_id AS VARCHAR) AS source,
           trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t\x{{3000}}]+$', '', 'g'), '[ \t\x{{3000}}]+', ' ', 'g'), {_WS}) AS text
    FROM documents WHERE trim(text, {_WS}) <> ''
)"""

_SPANS = rf"""{_DOCS},
pieces AS (SELECT source, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT source, regexp_extract_all(text, '[^.\n]*[.\n]|[^.\n]+') AS l FROM docs)),
placed AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY source ORDER BY i) - length(piece) AS BIGINT) AS place FROM pieces),
spans AS (
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY i) AS k, place + length(piece) - length(ltrim(piece, {_WS})) AS s, place + length(rtrim(piece, {_WS})) AS e
    FROM placed WHERE trim(piece, {_WS}) <> ''
)"""

_LAST = "CASE WHEN strpos(reverse(w), {0}) > 0 THEN length(w) - strpos(reverse(w), {0}) ELSE -1 END"
_CUT = " ".join(f"WHEN {_LAST.format(sep)} > 0 THEN {_LAST.format(sep)} + 1" for sep in ("'、'", "chr(10)", "','", "' '"))

_CHUNKS = f"""{_SPANS},
fold AS (
    SELECT DISTINCT source, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS bs, CAST(NULL AS BIGINT) AS be, CAST(0 AS BIGINT) AS held,
           CAST(NULL AS BIGINT) AS s1, CAST(NULL AS BIGINT) AS e1, CAST(NULL AS BIGINT) AS s2, CAST(NULL AS BIGINT) AS e2 FROM spans
    UNION ALL
    SELECT source, k, CASE WHEN big OR whole THEN NULL ELSE first END, CASE WHEN big OR whole THEN NULL ELSE e END, CASE WHEN big OR whole THEN 0 ELSE total END,
           CASE WHEN big THEN bs WHEN whole THEN first END, CASE WHEN big THEN be WHEN whole THEN e END, CASE WHEN big THEN s END, CASE WHEN big THEN e END
    FROM (SELECT f.source, s.k, f.bs, f.be, s.s, s.e, s.e - s.s > 500 AS big, coalesce(f.bs, s.s) AS first, f.held + s.e - s.s AS total, f.held + s.e - s.s >= 500 AS whole
          FROM fold f JOIN spans s ON s.source = f.source AND s.k = f.k + 1)
),
soft AS (
    SELECT source, k, CAST(0 AS BIGINT) AS p, s2 AS place, e2 AS e, CAST(CASE WHEN e2 - s2 <= 1500 THEN e2 - s2 ELSE CASE {_CUT} ELSE 1500 END END AS BIGINT) AS size
    FROM (SELECT f.*, substr(d.text, s2 + 1, 1500) AS w FROM fold f JOIN docs d USING (source) WHERE s2 IS NOT NULL)
    UNION ALL
    SELECT source, k, p + 1, place, e, CAST(CASE WHEN e - place <= 1500 THEN e - place ELSE CASE {_CUT} ELSE 1500 END END AS BIGINT)
    FROM (SELECT o.source, o.k, o.p, o.place + o.size AS place, o.e, substr(d.text, o.place + o.size + 1, 1500) AS w FROM soft o JOIN docs d USING (source) WHERE o.place + o.size < o.e)
),
raw AS (
    SELECT source, k, 1 AS j, CAST(0 AS BIGINT) AS p, s1 AS s, e1 AS e FROM fold WHERE s1 IS NOT NULL
    UNION ALL SELECT source, k, 2, p, place, place + size FROM soft
    UNION ALL SELECT source, k, 3, 0, bs, be FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC) AS back FROM fold) WHERE back = 1 AND bs IS NOT NULL
),
numbered AS (SELECT source, row_number() OVER w - 1 AS ord, s, e, lag(e) OVER w AS before FROM raw WINDOW w AS (PARTITION BY source ORDER BY k, j, p)),
bounds AS (SELECT source, s AS b FROM spans UNION SELECT source, e FROM spans),
snapped AS (SELECT n.source, n.ord, max(b) AS b FROM numbered n JOIN bounds USING (source) WHERE b BETWEEN before - 200 AND before - 100 GROUP BY ALL),
laid AS (SELECT n.source, n.ord, n.s AS raw_start, CASE WHEN x.b < n.s THEN x.b ELSE n.s END AS char_start, n.e AS char_end FROM numbered n LEFT JOIN snapped x USING (source, ord)),
texts AS (SELECT l.*, substr(d.text, char_start + 1, char_end - char_start) AS text FROM laid l JOIN docs d USING (source)),
chunks AS MATERIALIZED (SELECT *, substr(sha256(source || '|' || char_start || '|' || char_end || '|' || sha256(text)), 1, 12) AS chunk_id FROM texts)"""

_TFIDF = rf"""{_CHUNKS},
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '\p{{L}}{{3,}}')) AS term FROM chunks) GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM chunks)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term),
raw_weights AS (SELECT chunk_id, term, tf, (1 + ln(tf)) * idf AS r FROM tf JOIN vocab USING (term)),
weights AS MATERIALIZED (SELECT chunk_id, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY chunk_id)) AS weight FROM raw_weights)"""


def _label(n: str) -> str:
    return f"CASE WHEN {n} >= 14 THEN 'OTHER' WHEN {n} >= 10 THEN 'PRODUCT' WHEN {n} >= 8 THEN 'LOC' WHEN {n} >= 6 THEN 'ORG' ELSE 'PERSON' END"


_MENTIONS = rf"""{_CHUNKS},
all_mentions AS (SELECT chunk_id, unnest(l) AS name, generate_subscripts(l, 1) AS i FROM (SELECT chunk_id, regexp_extract_all(text, '\p{{Lu}}\p{{Ll}}{{3,}}') AS l FROM chunks)),
mentions AS MATERIALIZED (SELECT chunk_id, i, name, {_label('length(name) - 1')} AS ner_label FROM all_mentions WHERE length(name) < 15),
counted AS (SELECT chunk_id, name, ner_label, count(*) AS times FROM mentions GROUP BY ALL),
totals AS (SELECT name, ner_label, CAST(sum(times) AS BIGINT) AS mention_count, count(*) AS chunk_count FROM counted GROUP BY ALL),
entities AS MATERIALIZED (SELECT * FROM totals WHERE mention_count >= 5 AND chunk_count >= 3),
ordered AS (SELECT chunk_id, text, source, row_number() OVER (ORDER BY source, ord) - 1 AS row_index FROM chunks)"""

_HASHES = f"""{_MENTIONS},
hashes AS MATERIALIZED (
    SELECT name, ner_label, any_value(mention_count) AS mention_count, any_value(chunk_count) AS chunk_count,
           sha256(name || chr(0) || ner_label || chr(0) || string_agg(text, chr(10) || '---' || chr(10) ORDER BY chunk_id) || chr(0) || 'rules' || chr(0) || 'rules@1' || chr(0) || 'first-lines@1' || chr(0) || 'v1') AS source_hash
    FROM entities JOIN counted USING (name, ner_label) JOIN ordered USING (chunk_id) GROUP BY name, ner_label
),
known AS (
    SELECT *, source_hash AS now, CASE length(name) % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'budget_skipped' END AS status, CASE WHEN length(name) % 3 = 0 THEN '' ELSE source_hash END AS old
    FROM hashes WHERE length(name) % 5 <> 0
),
decided AS (SELECT h.*, k.status, coalesce(k.old = h.source_hash, false) AS same FROM hashes h LEFT JOIN known k USING (name, ner_label))"""


_PAIRS = """
shared AS (SELECT term FROM vocab WHERE df BETWEEN 2 AND 60), near AS (
            SELECT DISTINCT x.chunk_id AS a, y.chunk_id AS b FROM (SELECT w.chunk_id, w.term FROM weights w JOIN shared USING (term)) x JOIN (SELECT w.chunk_id, w.term FROM weights w JOIN shared USING (term)) y ON x.term = y.term AND x.chunk_id < y.chunk_id
            UNION SELECT a.chunk_id, b.chunk_id FROM (SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM weights JOIN shared USING (term))) a, (SELECT chunk_id FROM chunks) b WHERE a.chunk_id < b.chunk_id
            UNION SELECT b.chunk_id, a.chunk_id FROM (SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM weights JOIN shared USING (term))) a, (SELECT chunk_id FROM chunks) b WHERE b.chunk_id < a.chunk_id
            UNION SELECT x.chunk_id, y.chunk_id FROM weights x JOIN weights y ON x.term = y.term AND x.chunk_id < y.chunk_id AND x.weight > 0.2 AND y.weight > 0.1),
near_pairs AS (SELECT a, b, round(sum(x.weight * y.weight), 4) AS cosine FROM near JOIN weights x ON x.chunk_id = a JOIN weights y ON y.chunk_id = b AND y.term = x.term GROUP BY a, b HAVING sum(x.weight * y.weight) > 0.95)"""

_SUCCEEDED = "(SELECT * FROM known WHERE status = 'success')"
_NAMES = """
listed AS (SELECT ner_label || '__' || name AS key, name, string_split(name, '') AS signs FROM {which} x),
named AS (SELECT x.key AS a, y.key AS b, x.signs AS p, y.signs AS q FROM listed x JOIN listed y ON x.key < y.key AND 2.0 * least(len(x.signs), len(y.signs)) > {least} * (len(x.signs) + len(y.signs))),
table_of AS (
    SELECT a, b, p, q, 0 AS i, list_transform(range(len(q) + 1), lambda x: 0) AS best FROM named
    UNION ALL
    SELECT a, b, p, q, i + 1, list_reduce(range(1, len(q) + 1), lambda new, j: list_append(new, CASE WHEN p[i + 1] = q[j] THEN best[j] + 1 ELSE greatest(new[-1], best[j + 1]) END), [0]) FROM table_of WHERE i < len(p)
),
alike AS (SELECT a, b, 2.0 * best[-1] / (len(p) + len(q)) AS ratio FROM table_of WHERE i = len(p) AND 2.0 * best[-1] / (len(p) + len(q)) > {least})"""


def _with(ctes: str, query: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{query}"


_FAIL = "CASE WHEN same THEN 'cached' ELSE 'call' END"
_HEAD, _MID, _TAIL, _END = (PROMPT.split(x)[i] for x, i in (("{ner_label}", 0), ("{ner_label}", 1), ("{entity_name}", 1), ("{chunks_text}", 1)))
_MID, _TAIL = _MID.split("{entity_name}")[0], _TAIL.split("{chunks_text}")[0]

ORACLES = {
    "normalize_docs": _with(_DOCS, "SELECT source, text FROM docs"),
    "sentence_spans": _with(_SPANS, 'SELECT source, CAST(k - 1 AS INTEGER) AS ord, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM spans'),
    "chunk_documents": _with(_CHUNKS, "SELECT source, CAST(ord AS INTEGER) AS ord, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, text, chunk_id FROM chunks"),
    "chunk_warnings": _with(_CHUNKS, """
        SELECT source, CASE WHEN e - s > 1500 THEN 'sentence_soft_split' ELSE 'sentence_over_target' END AS kind, CAST(s AS INTEGER) AS char_offset FROM spans WHERE e - s > 500
        UNION ALL SELECT source, 'overlap_skipped', CAST(raw_start AS INTEGER) FROM laid WHERE ord > 0 AND char_start = raw_start"""),
    "chunk_row_index": _with(_CHUNKS, "SELECT CAST(row_number() OVER (ORDER BY source, ord) - 1 AS BIGINT) AS row_index, chunk_id FROM chunks"),
    "chunk_length_stats": _with(_CHUNKS, "SELECT count(*) AS chunks, count(DISTINCT source) AS documents, min(length(text)) AS least, max(length(text)) AS most, CAST(sum(length(text)) AS BIGINT) AS total FROM chunks"),
    "doc_freq_idf": _with(_TFIDF, "SELECT term, df, round(idf, 6) AS idf FROM vocab WHERE df >= 2"),
    "vocabulary_ids": _with(_TFIDF, "SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS term_id FROM vocab WHERE df >= 2"),
    "npz_weights": _with(_TFIDF, "SELECT chunk_id, term, round(weight, 6) AS weight FROM weights"),
    "tfidf_weights": _with(_TFIDF, "SELECT chunk_id, term, tf, round(weight, 6) AS weight FROM weights"),
    "top_keywords": _with(_TFIDF, """
        SELECT chunk_id, CAST(rank AS INTEGER) AS rank, term, tfidf
        FROM (SELECT chunk_id, term, tfidf, row_number() OVER (PARTITION BY chunk_id ORDER BY tfidf DESC, term) AS rank FROM (SELECT chunk_id, term, round(weight, 6) AS tfidf FROM weights)) WHERE rank <= 10"""),
    "query_topk": _with(_TFIDF, r"""
        , q AS (SELECT term, idf / sqrt(sum(idf * idf) OVER ()) AS x FROM vocab WHERE term IN ('the', 'and', 'thing', 'other', 'that', 'with', 'stat')),
        scored AS (SELECT chunk_id, round(sum(weight * x), 6) AS score FROM weights JOIN q USING (term) GROUP BY chunk_id),
        best AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0)
        SELECT CAST(rank AS INTEGER) AS rank, chunk_id, score, source FROM best JOIN chunks USING (chunk_id) WHERE rank <= 10"""),
    "token_slice": _with(_CHUNKS, r"SELECT chunk_id, count(*) AS n_tokens FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '\p{L}{3,}')) AS t FROM chunks) GROUP BY chunk_id"),
    "entity_slice": _with(_CHUNKS, rf"""
        , found AS (SELECT source, regexp_extract_all(text, '\p{{Lu}}\p{{Ll}}{{3,}}') AS l, string_split_regex(text, '\p{{Lu}}\p{{Ll}}{{3,}}') AS gaps FROM docs),
        each AS (SELECT source, unnest(l) AS name, unnest(gaps[1:len(l)]) AS gap, generate_subscripts(l, 1) AS i FROM found),
        placed_names AS (SELECT source, name, CAST(sum(length(gap) + length(name)) OVER (PARTITION BY source ORDER BY i) AS BIGINT) AS e FROM each)
        SELECT chunk_id, name, {_label('length(name) - 1')} AS ner_label, CAST(e - length(name) - char_start AS INTEGER) AS char_start, CAST(e - char_start AS INTEGER) AS char_end
        FROM placed_names JOIN chunks USING (source) WHERE e - length(name) >= char_start AND e <= char_end AND length(name) < 15"""),
    "bio_spans": _with(_DOCS, r"""
        , words AS (SELECT source, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS i FROM (SELECT source, list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '') AS l FROM docs)),
        tags AS (SELECT *, CASE WHEN regexp_matches(token, '^\p{Lu}') THEN 'B' WHEN length(token) <= 4 THEN 'I' ELSE 'O' END AS iob, CASE WHEN length(token) % 2 = 0 THEN 'PERSON' ELSE 'LOC' END AS label FROM words),
        heads AS (SELECT *, sum(CASE WHEN iob = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY i) AS head FROM tags),
        opened AS (SELECT *, first_value(label) OVER (PARTITION BY source, head ORDER BY i) AS open FROM heads WHERE head > 0),
        going AS (SELECT *, sum(CASE WHEN iob = 'B' OR (iob = 'I' AND label = open) THEN 0 ELSE 1 END) OVER (PARTITION BY source, head ORDER BY i) AS broken FROM opened)
        SELECT source, any_value(open) AS ner_label, CAST(min(i) * 10 AS INTEGER) AS char_start, CAST(max(i * 10 + length(token)) AS INTEGER) AS char_end, string_agg(token, '' ORDER BY i) AS name
        FROM going WHERE broken = 0 GROUP BY source, head"""),
    "entity_attach": _with(_MENTIONS, "SELECT chunk_id, coalesce(string_agg(ner_label || ':' || name, ' ' ORDER BY i), '') AS entities FROM chunks LEFT JOIN mentions USING (chunk_id) GROUP BY chunk_id"),
    "entity_aggregate": _with(_MENTIONS, """
        , ids AS (SELECT name, ner_label, string_agg(chunk_id, ' ' ORDER BY row_index) AS chunk_ids FROM entities JOIN counted USING (name, ner_label) JOIN ordered USING (chunk_id) GROUP BY ALL),
        pairs AS (SELECT DISTINCT e.name, e.ner_label, o.ner_label AS l, o.name AS n FROM entities e JOIN counted c USING (name, ner_label) JOIN counted o ON o.chunk_id = c.chunk_id AND (o.name <> c.name OR o.ner_label <> c.ner_label)),
        together AS (SELECT name, ner_label, string_agg(l || '__' || n, ' ' ORDER BY l, n) AS cooccurring FROM pairs GROUP BY ALL)
        SELECT name, ner_label, mention_count, chunk_count, chunk_ids, coalesce(cooccurring, '') AS cooccurring FROM entities JOIN ids USING (name, ner_label) LEFT JOIN together USING (name, ner_label)"""),
    "entity_stats": _with(_MENTIONS, "SELECT count(*) AS total_detected, count(*) FILTER (mention_count >= 5 AND chunk_count >= 3) AS accepted, count(*) FILTER (NOT (mention_count >= 5 AND chunk_count >= 3)) AS skipped FROM totals"),
    "entity_filenames": _with(_MENTIONS, "SELECT name, ner_label, ner_label || '__' || name || '_' || substr(sha256(ner_label || chr(0) || name), 1, 6) || '.md' AS file_name FROM entities"),
    "source_hash": _with(_HASHES, "SELECT name, ner_label, source_hash FROM hashes"),
    "cache_decision": _with(_HASHES, f"SELECT name, ner_label, {_FAIL} AS action, CASE WHEN same AND status = 'success' THEN 'cached' ELSE 'call' END AS retried, 'call' AS forced FROM decided"),
    "budget_plan": _with(_HASHES, """
        , calls AS (SELECT name, ner_label, row_number() OVER (ORDER BY mention_count DESC, chunk_count DESC, name, ner_label) AS r FROM decided WHERE NOT same)
        SELECT name, ner_label, CASE WHEN same THEN 'cached' WHEN r <= 25 THEN 'call' ELSE 'budget_skipped' END AS action FROM decided LEFT JOIN calls USING (name, ner_label)"""),
    "manifest_merge": _with(_HASHES, """
        SELECT name AS entity_name, ner_label, source_hash, CASE WHEN length(name) % 2 = 0 THEN 'success' ELSE 'failed' END AS status, '2026-02-02T00:00:00+00:00' AS last_attempt_at FROM decided WHERE NOT same
        UNION ALL SELECT k.name, k.ner_label, k.old, k.status, '2026-01-01T00:00:00+00:00' FROM known k JOIN decided d USING (name, ner_label) WHERE d.same"""),
    "systemic_abort": """
        SELECT n, attempted, failures FROM (
            SELECT doc_id AS n, count(*) OVER w AS attempted, CAST(sum(CASE WHEN n_chars % 2 = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failures
            FROM documents WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
        WHERE attempted >= 5 AND failures > 0.5 * attempted ORDER BY n LIMIT 1""",
    "prompt_build": _with(_MENTIONS, f"""
        , placed_ids AS (SELECT name, ner_label, source, text, row_number() OVER (PARTITION BY name, ner_label ORDER BY row_index) AS r FROM entities JOIN counted USING (name, ner_label) JOIN ordered USING (chunk_id)),
        told AS (SELECT name, ner_label, count(*) AS n, string_agg('- [' || source || '] ' || text, chr(10) ORDER BY r) FILTER (r <= 20) AS lines FROM placed_ids GROUP BY ALL)
        SELECT name, ner_label, '{_HEAD}' || ner_label || '{_MID}' || name || '{_TAIL}' || lines || CASE WHEN n > 20 THEN chr(10) || '... (残り ' || (n - 20) || ' 件のチャンクは省略) ...' ELSE '' END || '{_END}' AS prompt FROM told"""),
    "page_snippets": _with(_MENTIONS, """
        SELECT name, ner_label, CAST(row_number() OVER (PARTITION BY name, ner_label ORDER BY row_index) - 1 AS INTEGER) AS pos, chunk_id, source, replace(substr(text, 1, 80), chr(10), ' ') AS excerpt
        FROM entities JOIN counted USING (name, ner_label) JOIN ordered USING (chunk_id)"""),
    "entity_index": _with(_HASHES, "SELECT ner_label, string_agg('- [' || name || '](entities/' || ner_label || '__' || name || '_' || substr(sha256(ner_label || chr(0) || name), 1, 6) || '.md) (mentions: ' || mention_count || ', chunks: ' || chunk_count || ')', chr(10) ORDER BY name) AS lines FROM known WHERE status = 'success' GROUP BY ner_label"),
    "lint_length": _with(_CHUNKS, """
        SELECT 'warning' AS severity, CASE WHEN length(text) = 0 THEN 'empty_chunk' WHEN length(text) > 1500 THEN 'over_max_chunk' ELSE 'over_2x_target' END AS category,
               chunk_id || CASE WHEN length(text) = 0 THEN ' is empty' WHEN length(text) > 1500 THEN ' is over the limit' ELSE ' is over twice the target' END AS message, CASE WHEN length(text) = 0 THEN '' ELSE length(text) || ' chars' END AS detail
        FROM chunks WHERE length(text) = 0 OR length(text) > 1000
        UNION ALL SELECT 'info', 'single_sentence', chunk_id || ' has one sentence', '' FROM chunks WHERE length(text) > 0 AND length(text) - length(replace(text, '.', '')) <= 1"""),
    "lint_degenerate": _with(_TFIDF, """
        SELECT 'warning' AS severity, 'degenerate_vector' AS category, chunk_id || ' has a degenerate vector' AS message, n || ' terms' AS detail
        FROM (SELECT chunk_id, count(term) AS n, coalesce(sqrt(sum(weight * weight)), 0) AS norm FROM chunks LEFT JOIN weights USING (chunk_id) GROUP BY chunk_id) WHERE n < 3 OR norm < 1e-6"""),
    "lint_duplicates": _with(f"{_TFIDF},\n{_PAIRS}", "SELECT a, b, cosine FROM near_pairs"),
    "lint_orphans": _with(_HASHES, """
        SELECT 'warning' AS severity, 'orphan_wiki' AS category, ner_label || '__Lost ' || name || ' has no chunk in the corpus' AS message, '' AS detail FROM known WHERE status = 'success'"""),
    "lint_similar_names": _with(f"{_MENTIONS},\n{_NAMES.format(which='entities', least=0.7)}", "SELECT a, b, round(ratio, 4) AS ratio FROM alike"),
    "lint_summary": _with(f"{_TFIDF},\n{_HASHES.split(_CHUNKS + ',', 1)[1].lstrip()},\n{_NAMES.format(which=_SUCCEEDED, least=0.85)},\n{_PAIRS}", """
        , found AS (
            SELECT 'warning' AS severity, CASE WHEN length(text) = 0 THEN 'empty_chunk' WHEN length(text) > 1500 THEN 'over_max_chunk' ELSE 'over_2x_target' END AS category FROM chunks WHERE length(text) = 0 OR length(text) > 1000
            UNION ALL SELECT 'info', 'single_sentence' FROM chunks WHERE length(text) > 0 AND length(text) - length(replace(text, '.', '')) <= 1
            UNION ALL SELECT 'warning', 'degenerate_vector' FROM (SELECT chunk_id, count(term) AS n FROM chunks LEFT JOIN weights USING (chunk_id) GROUP BY chunk_id) WHERE n < 3
            UNION ALL SELECT 'warning', 'duplicate' FROM near_pairs
            UNION ALL SELECT 'warning', 'wiki_disabled' WHERE (SELECT count(*) FROM known WHERE status = 'success') < 3 AND (SELECT count(*) FROM chunks) < 20
            UNION ALL SELECT 'info', 'similar_entity' FROM alike)
        SELECT severity, category, count(*) AS n, CASE WHEN (SELECT count(*) FROM found WHERE severity = 'warning') > 0 THEN 1 ELSE 0 END AS exit_code FROM found GROUP BY severity, category"""),
    "lint_switches": _with(_CHUNKS, """
        SELECT 'info' AS severity, 'pairwise_skipped' AS category, 'pairwise checks are skipped' AS message, count(*) || ' chunks > 100' AS detail FROM chunks
        UNION ALL SELECT 'warning', 'wiki_disabled', 'too few entities and chunks for summaries', '0 entities, ' || count(*) || ' chunks' FROM chunks"""),
    "text_functions": r"""
        SELECT doc_id, source || '/' || doc_id || '.txt' AS source, (doc_id % 7) || '.' || (doc_id % 11) AS short, ['stop', 'stop', 'max_tokens', 'end_turn', 'refusal'][CAST(doc_id % 5 + 1 AS INTEGER)] AS finish,
               sha256(regexp_replace(replace(t, '.', chr(10) || '---' || chr(10)), '(?m)^---$', '\\---', 'g')) AS fenced, replace(substr(t, 1, 80), chr(10), ' ') AS excerpt, length(t) - length(replace(t, '.', '')) <= 1 AS single
        FROM (SELECT *, coalesce(text, '') AS t FROM documents)""",
    "file_names": rf"""
        WITH r AS (SELECT ['CON', 'PRN', 'AUX', 'NUL'] || list_transform(range(1, 10), lambda i: 'COM' || i) || list_transform(range(1, 10), lambda i: 'LPT' || i) AS l),
        n AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(text, '') AS name, l[CAST(doc_id % 22 + 1 AS INTEGER)] AS held FROM documents, r),
        s AS (SELECT *, 'PRODUCT__' || regexp_replace(name, '[/\\:*?"<>|\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '_', 'g') || '_' || substr(sha256('PRODUCT' || chr(0) || name), 1, 6) AS base FROM n),
        c AS (SELECT *, CASE WHEN strlen(base) <= {NAME_BYTES} THEN base ELSE substr(base, 1, CAST(list_max(list_filter(range({(NAME_BYTES - 7) // 4}, {NAME_BYTES - 6}), lambda k: strlen(substr(base, 1, k)) <= {NAME_BYTES - 7})) AS BIGINT)) || '_' || substr(sha256(base), 1, 6) END AS fit FROM s)
        SELECT doc_id, fit || '.md' AS file_name, 'ORG__' || held || '__' || substr(sha256('ORG' || chr(0) || held), 1, 6) || '.md' AS reserved FROM c""",
    "stub_tokens": _with(_DOCS, r"""
        , words AS (SELECT source, list_filter(list_transform(string_split_regex(text, '[。\n ]'), lambda w: translate(w, '、.,', '')), lambda w: length(w) >= 2) AS l FROM docs),
        kept AS (SELECT source, len(l) AS n, list_filter(list_transform(list_filter(l, lambda w: length(w) % 3 <> 2), lambda w: trim(lower(w))), lambda w: w NOT IN ('', 'the', 'and')) AS k FROM words)
        SELECT source, n AS n_tokens, len(k) AS n_kept, sha256(array_to_string(k, ' ')) AS sha FROM kept"""),
    "skipped_files": f"""
        SELECT CAST(doc_id AS VARCHAR) AS source, CASE WHEN doc_id % 7 = 0 OR text IS NULL AND doc_id % 5 <> 0 THEN 'not UTF-8' ELSE 'empty' END AS reason
        FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR text IS NULL OR trim(text, {_WS}) = ''""",
    "segment_bytes": _with(_DOCS, """
        , cuts AS (
            SELECT source, CAST(0 AS BIGINT) AS char_offset, CAST('' AS VARCHAR) AS segment, text AS rest FROM docs
            UNION ALL
            SELECT source, char_offset + length(segment), substr(rest, 1, size), substr(rest, size + 1) FROM (
                SELECT source, char_offset, segment, rest, CASE
                    WHEN strlen(rest) <= 4000 THEN length(rest)
                    WHEN position(chr(10) || chr(10) IN w) > 0 THEN length(w) - position(chr(10) || chr(10) IN reverse(w)) + 1
                    WHEN position('.' IN w) > 0 THEN length(w) - position('.' IN reverse(w)) + 1
                    WHEN position(chr(10) IN w) > 0 THEN length(w) - position(chr(10) IN reverse(w)) + 1 ELSE length(w) END AS size
                FROM (SELECT *, substr(rest, 1, CAST(list_max(list_filter(range(4000 - (strlen(substr(rest, 1, 4000)) - length(substr(rest, 1, 4000))) - 1, 4001), lambda k: strlen(substr(rest, 1, k)) <= 4000)) AS BIGINT)) AS w FROM cuts WHERE rest <> ''))
        )
        SELECT source, CAST(char_offset AS INTEGER) AS char_offset, CAST(strlen(segment) AS INTEGER) AS n_bytes, sha256(segment) AS sha FROM cuts WHERE segment <> ''"""),
}

#: The index gives what the weights themselves give.
ORACLES["indexed_topk"] = ORACLES["query_topk"]
