"""DuckDB SQL for the registered queries of the subpackage that SQL can express."""

OP11 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), words AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), totals AS (
    SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang
), counts AS (
    SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM words, (VALUES (1), (2), (3), (4), (5)) AS s(k), unnest(generate_series(1, len(ws) - k + 1)) AS g(i)
    GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
    SELECT c.* FROM counts c WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM counts b WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.f >= 100 * c.f AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, cut, t.n, l.f AS l, r.f AS r,
        (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM candidates c
    CROSS JOIN unnest(generate_series(1, c.k - 1)) AS g(cut)
    JOIN totals t ON t.lang = c.lang
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:cut], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

OP12 = r"""
WITH split AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), failed AS (
    SELECT part, doc_id,
        (len(w) < 200)::INT
        + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS f
    FROM split
), docs AS (
    SELECT part, f, coalesce(quality, false) AS good, coalesce(toxic, false) AS toxic
    FROM failed LEFT JOIN (SELECT doc_id, max(quality = 1) AS quality, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
        coalesce(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE WHEN x = '' THEN 0 ELSE 1 << (ascii(x) - 65) END)), 0)::INT AS before
    FROM orders, unnest(generate_series(1, 5)) AS g(step)
), audit AS (
    SELECT part, filter_order, step, own,
        count(*) FILTER (f & before = 0 AND f & own = 0) AS kept,
        count(*) FILTER (f & before = 0 AND f & own <> 0) AS removed,
        count(*) FILTER (f & before <> 0 AND f & own <> 0) AS redundant,
        count(*) FILTER (f = own) AS unique_fails,
        count(*) FILTER (f & before = 0 AND f & own <> 0 AND good) AS good_lost,
        count(*) FILTER (f & before = 0 AND f & own <> 0 AND toxic) AS toxic_lost
    FROM docs, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM audit
"""

ORACLE_SQL: dict[str, str] = {"op11_collocations": OP11, "op12_filter_audit": OP12}
