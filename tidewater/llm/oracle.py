"""DuckDB SQL for the queries that SQL can express on whole tables."""

ORACLE_SQL = {
    "op9_url_filters": r"""
        WITH parts AS (
            SELECT page_id, row_number() OVER () AS n,
                   CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
            FROM pages),
        p AS (
            SELECT page_id, n,
                   coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM parts),
        rules(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT n, h || q AS rule, v,
                   row_number() OVER (PARTITION BY n ORDER BY length(h || q) DESC) AS k
            FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
        FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (n)
    """,
    "op1_minhash_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS ws
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
            FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id
            WHERE 100 * k >= 80 * (p.n + q.n - k)),
        sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, e.b FROM reach r JOIN sides e ON r.b = e.a),
        low AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
               coalesce(component_id, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id
    """,
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
        later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM later, range(0, 20) r(j)),
        kept AS (
            SELECT w.doc_id, p AS pos, ws[p] AS word
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) w
            ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = p),
        joined AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM kept GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN joined USING (doc_id)
    """,
    "op8_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
            FROM documents),
        g AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
        twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 5) r(j) GROUP BY doc_id),
        lines AS (
            SELECT doc_id, source, text, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w,
                   regexp_replace(translate(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' '),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '00+', '0', 'g') AS line
            FROM (SELECT doc_id, source, text, unnest(ls) AS l FROM d)),
        host AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
        freq AS (SELECT source, line, count(DISTINCT text) AS n FROM lines GROUP BY source, line),
        hot AS (SELECT f.source, line FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE n >= 20 AND n > docs * 0.05),
        cut AS (
            SELECT doc_id, sum(w) AS n FROM lines JOIN hot ON lines.source IS NOT DISTINCT FROM hot.source AND lines.line = hot.line
            GROUP BY doc_id),
        counted AS (
            SELECT d.doc_id, len(ws) AS n_words, length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
                   coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_cut_words
            FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
               AND n_words - n_cut_words >= 10 AND n_words - n_cut_words >= n_words * 0.3 AS kept
        FROM counted
    """,
}
