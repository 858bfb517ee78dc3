"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

from tickweir.llm._text import WORD_RE


def windows(size: int) -> str:
    """CTEs: w (doc_id, i, gram) of every window of `size` words, and r, those that occur more than once."""
    return f"""
    t AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE}') AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + {size}], ' ') AS gram
          FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {size} + 1)) AS i FROM t WHERE len(ws) >= {size})),
    r AS (SELECT doc_id, i, n, f FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY gram) AS n, min(doc_id) OVER (PARTITION BY gram) AS f FROM w) WHERE n > 1),
    e AS (SELECT *, max(i + {size}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
    g AS (SELECT *, sum(CASE WHEN i <= before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM e),
    s AS (SELECT doc_id, island, min(i) AS a, max(i) + {size} AS z, count(*) AS windows, max(n) AS copies, min(f) AS f FROM g GROUP BY doc_id, island)"""


SUFFIX = f"WITH {windows(50)} SELECT doc_id, a AS start_word, z - a AS n_words, f AS first_doc_id FROM s"
SUPERKMER = f"""WITH {windows(50)} SELECT doc_id, CAST(sum(windows) AS BIGINT) AS windows, max(copies) AS max_copies,
    string_agg(a || '-' || z, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id"""

LINES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
        FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, pos, trim(line) = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, pos) = 1 AS keep FROM l),
    r AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM k WHERE keep),
    b AS (SELECT doc_id, g, min(pos) AS a, max(pos) AS z, count(*) AS c FROM r GROUP BY doc_id, g),
    s AS (SELECT doc_id, sum(c) AS n_kept, string_agg(a || '-' || z, ',' ORDER BY a) AS bitmap FROM b GROUP BY doc_id)
    SELECT n.doc_id, n.n_lines, CAST(coalesce(n_kept, 0) AS INT) AS n_kept, coalesce(bitmap, '') AS bitmap
    FROM (SELECT doc_id, CAST(count(*) AS INT) AS n_lines FROM l GROUP BY doc_id) n LEFT JOIN s USING (doc_id)"""

DECONTAM = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_RE}') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD_RE}') AS ws FROM benchmark),
    n AS (SELECT unnest(range(5, 9)) AS n),
    bg AS (SELECT DISTINCT item_id, n, array_to_string(ws[i + 1 : i + n], ' ') AS gram
           FROM (SELECT item_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM b, n WHERE len(ws) >= n AND (n = 8 OR len(ws) = n))),
    dg AS (SELECT doc_id, i, n, array_to_string(ws[i + 1 : i + n], ' ') AS gram
           FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM t, n WHERE len(ws) >= n)),
    l AS (SELECT doc_id, regexp_extract_all(lower(line), '{WORD_RE}') AS ws, pos FROM
          (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
    ls AS (SELECT doc_id, array_to_string(ws, ' ') AS gram, len(ws) AS n, CAST(sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) - len(ws) AS i FROM l),
    h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dg JOIN bg USING (gram, n)
          UNION SELECT doc_id, i, n, item_id FROM ls JOIN (SELECT item_id, array_to_string(ws, ' ') AS gram, len(ws) AS n FROM b WHERE len(ws) BETWEEN 1 AND 4) USING (gram, n)),
    c AS (SELECT doc_id, count(DISTINCT w) AS hit_words FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM h) GROUP BY doc_id),
    a AS (SELECT doc_id, count(*) AS windows, list_sort(list(DISTINCT item_id)) AS items FROM h GROUP BY doc_id)
    SELECT a.doc_id, array_to_string(items, ',') AS item_ids, CAST(windows AS INT) AS windows, CAST(hit_words AS INT) AS hit_words, CAST(len(ws) AS INT) AS n_words,
        CASE WHEN hit_words * 2 >= len(ws) THEN 'document' ELSE 'span' END AS action
    FROM a JOIN c USING (doc_id) JOIN t USING (doc_id)"""

MIXTURE = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
        CASE WHEN contains(text, 'icense') THEN 'legal' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, ' | ') THEN 'table'
             WHEN length(text) < 600 THEN 'note' WHEN length(text) < 4000 THEN 'article' WHEN text IS NULL THEN 'book' ELSE 'book' END AS topic,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS tokens FROM documents),
    c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
    ts AS (SELECT source, x / sum(x) OVER () AS x FROM (SELECT source, least(power(sum(tokens)::DOUBLE, 0.7) / sum(power(sum(tokens)::DOUBLE, 0.7)) OVER (), 4.0::DOUBLE * sum(tokens) / sum(sum(tokens)::DOUBLE) OVER ()) AS x FROM c GROUP BY source)),
    tl AS (SELECT lang, y / sum(y) OVER () AS y FROM (SELECT lang, least(power(sum(tokens)::DOUBLE, 0.7) / sum(power(sum(tokens)::DOUBLE, 0.7)) OVER (), 4.0::DOUBLE * sum(tokens) / sum(sum(tokens)::DOUBLE) OVER ()) AS y FROM c GROUP BY lang)),
    tt AS (SELECT topic, z / sum(z) OVER () AS z FROM (SELECT topic, least(power(sum(tokens)::DOUBLE, 0.7) / sum(power(sum(tokens)::DOUBLE, 0.7)) OVER (), 4.0::DOUBLE * sum(tokens) / sum(sum(tokens)::DOUBLE) OVER ()) AS z FROM c GROUP BY topic)),
    g AS (SELECT k, 0.5 * k / 50 * t AS goal, 0.5 * k / 50 AS b FROM (SELECT unnest(range(1, 51)) AS k), (SELECT sum(tokens)::DOUBLE AS t FROM c)),
    r AS (SELECT 0 AS i, k, goal, source, lang, topic, tokens::DOUBLE AS tokens, x, y, z, tokens * b AS q
          FROM c JOIN ts USING (source) JOIN tl USING (lang) JOIN tt USING (topic), g
        UNION ALL
        SELECT i + 1, k, goal, source, lang, topic, tokens, x, y, z, q * z * goal / sum(least(q, tokens)) OVER (PARTITION BY k, topic) FROM (
            SELECT * REPLACE (q * y * goal / sum(least(q, tokens)) OVER (PARTITION BY k, lang) AS q) FROM (
                SELECT * REPLACE (q * x * goal / sum(least(q, tokens)) OVER (PARTITION BY k, source) AS q) FROM r WHERE i < 100))),
    o AS (SELECT *, least(q, tokens) AS part, sum(least(q, tokens)) OVER (PARTITION BY k) AS whole FROM r WHERE i = 100),
    m AS (SELECT k, max(greatest(abs(sx / whole - x) / x, abs(sy / whole - y) / y, abs(sz / whole - z) / z)) AS miss FROM (
        SELECT k, whole, x, y, z, sum(part) OVER (PARTITION BY k, source) AS sx, sum(part) OVER (PARTITION BY k, lang) AS sy, sum(part) OVER (PARTITION BY k, topic) AS sz FROM o) GROUP BY k),
    p AS (SELECT source, lang, topic, part / tokens AS p FROM o WHERE k = (SELECT k FROM m ORDER BY greatest(round(miss, 6), 0.001), k DESC LIMIT 1))
    SELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, round(p, 6) AS p FROM d JOIN p USING (source, lang, topic)
    WHERE ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 8))::UBIGINT / 4294967296.0 < p"""
