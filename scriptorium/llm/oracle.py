"""DuckDB SQL for the corpus queries that SQL can express."""

ORACLES = {
    "op3_exact_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op4_chat_format": """
        WITH b AS (SELECT conv_id, turn, role AS speaker, role = 'system' AS context, text AS said, turn // 64 AS part FROM conversations),
        p AS (SELECT DISTINCT conv_id, speaker AS assistant FROM b WHERE NOT context),
        s AS (SELECT b.*, p.assistant, NOT context AND speaker = assistant AS own,
                     '<|im_start|>' || CASE WHEN context THEN speaker WHEN speaker = assistant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
              FROM b JOIN p USING (conv_id)),
        t AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS whole FROM s),
        u AS (SELECT *, coalesce(sum(length(whole)) OVER (PARTITION BY conv_id, assistant, part ORDER BY turn, speaker, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM t),
        g AS (SELECT conv_id, assistant, part, count(*) AS n_turns, string_agg(whole, '' ORDER BY turn, speaker, said) AS text,
                     coalesce(string_agg(CASE WHEN own THEN CAST(CAST(begins + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + length(head) + length(said) + 10 AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn, speaker, said), '') AS mask_spans,
                     coalesce(sum(CASE WHEN own THEN length(said) + 10 END), 0) AS masked_chars
              FROM u GROUP BY ALL)
        SELECT conv_id, assistant, CAST(part AS BIGINT) AS part,
               CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, assistant ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
               CAST(n_turns AS BIGINT) AS n_turns, text, mask_spans, CAST(masked_chars AS BIGINT) AS masked_chars FROM g
    """,
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
        m AS (SELECT doc_id, part,
                     CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                     + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
        s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0) AS before FROM o, range(1, 6) r(k)),
        x AS (SELECT part, filter_order, step, mask, n, good, toxic, own, (mask & own) <> 0 AS fails, (mask & CAST(before AS INTEGER)) <> 0 AS earlier FROM c, s)
        SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT fails AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN fails AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
               CAST(sum(CASE WHEN fails AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
               CAST(sum(CASE WHEN fails AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fails AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
               CAST(sum(CASE WHEN fails THEN n * 120 // bit_count(mask) ELSE 0 END) AS BIGINT) AS shapley
        FROM x GROUP BY part, filter_order, step
    """,
    "op13_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
    """,
}
