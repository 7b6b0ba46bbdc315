"""The SQL (DuckDB) that must agree with the queries of operators which SQL can express."""

from __future__ import annotations

# Lines by template: leaves, runs, all more frequent lines of each run, the best of these.
OP1_LINES = r"""
lines AS (
    SELECT doc_id, line_no, m, n, array_to_string(k[1:3], ' ') AS lead, k
    FROM (
        SELECT *, string_split(m, ' ') AS k, len(string_split(m, ' ')) AS n
        FROM (
            SELECT doc_id, i - 1 AS line_no, array_to_string(list_transform(
                string_split(trim(translate(l, chr(9) || chr(13), '  '), ' '), ' '),
                lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS m
            FROM (
                SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
                    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
                FROM documents))) WHERE n >= 5 OR length(m) >= 16),
kinds AS (
    SELECT lead, n, m, any_value(k) AS k, count(*) AS c,
        CAST(floor(0.2 * n + 1e-9) AS BIGINT) AS spare FROM lines WHERE n >= 5 GROUP BY lead, n, m),
crowded AS (
    SELECT *, count(*) OVER (PARTITION BY lead, n) AS in_leaf,
        greatest(1, CAST(floor((n - 3) / (spare + 1)) AS BIGINT)) AS width FROM kinds),
cut AS (
    SELECT lead, n, m, k, c, spare, width, unnest(range(0, spare + 1)) AS run
    FROM crowded WHERE in_leaf > 1),
runs AS (
    SELECT lead, n, m, k, c, run, array_to_string(
        k[4 + run * width : CASE WHEN run = spare THEN n ELSE 3 + (run + 1) * width END], ' ') AS piece
    FROM cut),
alike AS (
    SELECT DISTINCT a.m, b.m AS head, b.c AS head_c, n,
        len(list_filter(list_zip(a.k, b.k), lambda z: z[1] = z[2])) AS same
    FROM runs a JOIN runs b USING (lead, n, run, piece)
    WHERE b.c > a.c OR (b.c = a.c AND b.m < a.m)),
best AS (
    SELECT m, head FROM alike WHERE same + 1e-9 >= 0.8 * n
    QUALIFY row_number() OVER (PARTITION BY m ORDER BY same DESC, head_c DESC, head) = 1),
edges AS (SELECT m AS a, head AS b FROM best UNION SELECT head, m FROM best),
reach AS (
    SELECT a AS node, a AS far FROM edges
    UNION
    SELECT r.node, e.b FROM reach r JOIN edges e ON r.far = e.a),
roots AS (SELECT node, min(far) AS root FROM reach GROUP BY node),
known AS (
    SELECT l.doc_id, l.line_no, coalesce(r.root, l.m) AS template
    FROM lines l LEFT JOIN roots r ON l.m = r.node),
recurring AS (
    SELECT template, min(struct_pack(d := doc_id, l := line_no)) AS first
    FROM known GROUP BY template HAVING count(DISTINCT doc_id) >= 2),
gone AS (
    SELECT k.doc_id, list(k.line_no) AS drops FROM known k JOIN recurring r USING (template)
    WHERE k.doc_id <> r.first.d OR k.line_no <> r.first.l GROUP BY k.doc_id)
"""

OP1 = "WITH RECURSIVE " + OP1_LINES + r"""
SELECT d.doc_id,
    CASE WHEN g.drops IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(
        list_filter(range(1, len(string_split(d.text, chr(10))) + 1),
            lambda i: NOT list_contains(g.drops, i - 1)),
        lambda i: string_split(d.text, chr(10))[i]), chr(10)), '') END AS text,
    CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
    CAST(coalesce(len(g.drops), 0) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN gone g USING (doc_id)
"""


# An item's shingles have five words, or all of its fewer; a document offers every such length.
OP3 = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
item_words AS (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
widths AS (SELECT DISTINCT least(len(w), 5) AS n FROM item_words WHERE len(w) > 0),
docs AS (
    SELECT DISTINCT doc_id, unnest(list_transform(
        range(1, greatest(1, len(w) - n + 2)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
    FROM doc_words, widths),
items AS (
    SELECT DISTINCT item_id, unnest(list_transform(
        range(1, greatest(1, len(w) - n + 2)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
    FROM (SELECT *, least(len(w), 5) AS n FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS size FROM items GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS matched, size, count(*) / size AS containment
FROM docs JOIN items USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, size HAVING count(*) + 1e-9 >= 0.8 * size
"""

OP8 = r"""
WITH RECURSIVE located AS (
    SELECT page_id, url, html,
        coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages),
rules(verdict, rule, rule_host, rule_path) AS (VALUES
    ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
tags AS (
    SELECT url AS base, unnest([
        regexp_extract(regexp_extract(html,
            '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
        regexp_extract(regexp_extract(html,
            '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
        ]) AS target
    FROM located WHERE host <> ''),
pointed AS (
    SELECT base, CASE WHEN contains(target, '://') THEN target
        WHEN starts_with(target, '//') THEN regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*:') || target
        WHEN starts_with(target, '/') THEN regexp_extract(base, '^.*?://[^/?#]*', 0, 's') || target
        ELSE regexp_extract(base, '^.*?://[^/?#]*', 0, 's') || '/' || target END AS url
    FROM tags WHERE target <> ''),
addresses AS (
    SELECT url, regexp_replace(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\.', '')
        || regexp_replace(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'),
            '(/+|/index\.html?|\.html?)$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS address
    FROM (SELECT url, list_sort(list_filter(string_split(
            regexp_extract(url, '^[^#?]*\?([^#]*)', 1, 's'), '&'),
            lambda p: p <> '' AND NOT regexp_full_match(string_split(p, '=')[1], 'utm_[a-z]+|ref'))) AS kept
        FROM (SELECT url FROM located WHERE host <> '' UNION SELECT base FROM pointed
              UNION SELECT url FROM pointed))),
ruled AS (
    SELECT l.url, r.rule, r.verdict FROM (
        SELECT url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
        FROM addresses) l JOIN rules r
        ON (l.host = r.rule_host OR ends_with(l.host, '.' || r.rule_host))
        AND starts_with(l.path, r.rule_path)
    QUALIFY row_number() OVER (PARTITION BY l.url ORDER BY length(r.rule) DESC) = 1),
pairs AS (
    SELECT a.address AS a, b.address AS b FROM pointed p
    JOIN addresses a ON a.url = p.base JOIN addresses b ON b.url = p.url),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (
    SELECT DISTINCT address AS node, address AS far FROM addresses
    UNION
    SELECT r.node, e.b FROM reach r JOIN edges e ON r.far = e.a),
roots AS (SELECT node, min(far) AS root FROM reach GROUP BY node),
decided AS (
    SELECT root, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
    FROM ruled JOIN addresses USING (url) JOIN roots ON address = node GROUP BY root)
SELECT p.page_id, p.host, p.path, r.rule,
    coalesce(r.verdict, CASE WHEN d.blocked AND NOT coalesce(d.allowed, false) THEN 'block' END,
        'allow') AS verdict
FROM located p LEFT JOIN ruled r ON p.url = r.url LEFT JOIN addresses a ON p.url = a.url
LEFT JOIN roots o ON a.address = o.node LEFT JOIN decided d ON o.root = d.root
"""

# Base counts, then histograms in long form (a row a document and bin) against their means.
OP11 = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        coalesce('=' || lang, '?') AS language,
        CASE WHEN 1000 * count(*) OVER (PARTITION BY coalesce(text, '')) > count(*) OVER ()
            THEN greatest(1, 1000000 // count(*) OVER (PARTITION BY coalesce(text, ''))) ELSE 1000000 END AS wt
    FROM documents),
split AS (
    SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM docs),
windows AS (
    SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3))) AS i FROM split)),
starts AS (
    SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS later
    FROM (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1)),
repeated AS (SELECT r, sum(least(5, coalesce(later - i, 5))) AS n FROM starts GROUP BY r),
base AS (
    SELECT s.*, CAST(len(w) AS BIGINT) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM split s LEFT JOIN repeated USING (r)),
bare AS (
    SELECT DISTINCT r, language, wt, unnest(list_transform(w, lambda x: regexp_replace(lower(x), '[.,;:!?]+$', ''))) AS word
    FROM base),
every AS (
    SELECT r, language, unnest(list_transform(w, lambda x: regexp_replace(lower(x), '[.,;:!?]+$', ''))) AS word
    FROM base),
common AS (
    SELECT language, word, row_number() OVER (PARTITION BY language ORDER BY d DESC, word) AS pos
    FROM (SELECT language, word, sum(wt) AS d FROM bare WHERE word <> '' GROUP BY ALL)
    QUALIFY pos <= 16),
counted AS (
    SELECT r, pos, count(*) AS n FROM every JOIN common USING (language, word) GROUP BY ALL),
other AS (
    SELECT r, 0 AS pos, n_words - coalesce(sum(n), 0) AS n FROM base LEFT JOIN counted USING (r)
    WHERE n_words > 0 GROUP BY r, n_words),
word_bins AS (
    SELECT r, language, wt, pos, coalesce(o.n, c.n, 0) / n_words AS share
    FROM (SELECT r, language, wt, n_words, pos FROM base JOIN (
            SELECT language, pos FROM common UNION SELECT DISTINCT language, 0 FROM base) USING (language)
          WHERE n_words > 0)
    LEFT JOIN counted c USING (r, pos) LEFT JOIN other o USING (r, pos)),
left_over AS (
    SELECT r, language, wt, n_words, a0, a1, a2, a3, a4, a5,
        length(regexp_replace(t5, '[\p{L}\p{M}]+', '', 'g')) AS a6
    FROM (SELECT *, regexp_replace(t4, '[.,;:!?\x27"()\-]+', '', 'g') AS t5, length(t5) AS a5
    FROM (SELECT *, regexp_replace(t3, '\p{N}+', '', 'g') AS t4, length(t4) AS a4
    FROM (SELECT *, regexp_replace(t2, '\p{Lu}+', '', 'g') AS t3, length(t3) AS a3
    FROM (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2, length(t2) AS a2
    FROM (SELECT *, length(text) AS a0, regexp_replace(text, '\p{Ll}+', '', 'g') AS t1, length(t1) AS a1
    FROM base)))))),
class_bins AS (
    SELECT r, language, wt, unnest(range(7)) AS pos,
        unnest([a0 - a1, a1 - a2, a2 - a3, a3 - a4, a4 - a5, a5 - a6, a6]) / a0 AS share
    FROM left_over WHERE n_words > 0),
material AS (SELECT r FROM base WHERE n_words >= 40 AND length(text) >= 200),
word_steps AS (
    SELECT language, pos, CAST(floor(share * 4096) AS INTEGER) AS step, sum(wt) AS wt
    FROM word_bins JOIN material USING (r) GROUP BY ALL),
class_steps AS (
    SELECT language, pos, CAST(floor(share * 4096) AS INTEGER) AS step, sum(wt) AS wt
    FROM class_bins JOIN material USING (r) GROUP BY ALL),
word_medians AS (
    SELECT language, pos, min(step) AS step FROM (
        SELECT *, sum(wt) OVER (PARTITION BY language, pos ORDER BY step) AS so_far,
            sum(wt) OVER (PARTITION BY language, pos) AS total FROM word_steps)
    WHERE 2 * so_far >= total AND total >= 20000000 GROUP BY ALL),
class_medians AS (
    SELECT language, pos, min(step) AS step FROM (
        SELECT *, sum(wt) OVER (PARTITION BY language, pos ORDER BY step) AS so_far,
            sum(wt) OVER (PARTITION BY language, pos) AS total FROM class_steps)
    WHERE 2 * so_far >= total AND total >= 20000000 GROUP BY ALL),
word_means AS (
    SELECT language, pos, step / sum(step) OVER (PARTITION BY language) AS q FROM word_medians),
class_means AS (
    SELECT language, pos, step / sum(step) OVER (PARTITION BY language) AS q FROM class_medians),
words AS (
    SELECT r, sqrt(greatest(0, sum(CASE WHEN share > 0 THEN share * log2(2 * share / (share + q)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(2 * q / (share + q)) ELSE 0 END) / 2)) AS d
    FROM word_bins JOIN word_means USING (language, pos) GROUP BY r),
classes AS (
    SELECT r, sqrt(greatest(0, sum(CASE WHEN share > 0 THEN share * log2(2 * share / (share + q)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(2 * q / (share + q)) ELSE 0 END) / 2)) AS d
    FROM class_bins JOIN class_means USING (language, pos) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
        AND (n_words < 40 OR words.d IS NULL OR words.d <= 0.11 + 1.75 / sqrt(n_words))
        AND (length(text) < 200 OR classes.d IS NULL OR classes.d <= 0.1 + 3.0 / sqrt(length(text))) AS kept
FROM base LEFT JOIN words USING (r) LEFT JOIN classes USING (r)
"""

# A checksum bit by bit, then a table of the states after each row, extended by a row a step.
OP13 = r"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations),
kinds AS (
    SELECT conv_id, turn, role, text, xor(list_reduce([4294967295] || flatten(list_transform(
        string_split(k, ''), lambda x: [ord(x), 0, 0, 0, 0, 0, 0, 0])),
        lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384)
            ELSE xor(c, b) >> 1 END), 4294967295) % 20 AS kind
    FROM named),
hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g')
            ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM kinds WHERE kind <> 0),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos,
        regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last
    FROM hurt),
seen AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
    FROM placed),
flagged AS (
    SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate'
        WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
goes(state, to_state, inserts) AS (VALUES
    (0, 0, []), (0, 2, ['user']), (0, 3, ['user', 'assistant']),
    (1, 1, []), (1, 2, ['user']), (1, 3, ['user', 'assistant']),
    (2, 2, []), (2, 3, ['assistant']), (3, 3, []), (3, 2, ['user'])),
edits(state, edit, initial, given, to_state, price) AS (VALUES
    (0, 'K', 's', NULL, 1, 0), (0, 'K', 'u', NULL, 2, 0), (1, 'K', 'u', NULL, 2, 0),
    (2, 'K', 'a', NULL, 3, 0), (3, 'K', 'u', NULL, 2, 0),
    (0, 'R', NULL, 'user', 2, 1), (1, 'R', NULL, 'user', 2, 1),
    (2, 'R', NULL, 'assistant', 3, 1), (3, 'R', NULL, 'user', 2, 1),
    (0, 'D', NULL, NULL, 0, 2), (1, 'D', NULL, NULL, 1, 2), (2, 'D', NULL, NULL, 2, 2),
    (3, 'D', NULL, NULL, 3, 2)),
ways AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS state, CAST(0 AS BIGINT) AS cost,
        '' AS audit, CAST([] AS VARCHAR[]) AS turns FROM flagged
    UNION ALL
    SELECT f.conv_id, f.pos, e.to_state,
        w.cost + 5 * len(g.inserts) + e.price
            + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
        w.audit || repeat('I', len(g.inserts)) || e.edit AS audit,
        w.turns || list_transform(g.inserts, lambda x: x || ':')
            || CASE WHEN e.edit = 'D' THEN [] ELSE [coalesce(e.given, f.role) || ':' || f.text] END
    FROM ways w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1
    JOIN goes g ON g.state = w.state
    JOIN edits e ON e.state = g.to_state AND (e.initial IS NULL OR e.initial = f.initial)
        AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
    QUALIFY row_number() OVER (PARTITION BY f.conv_id, e.to_state
        ORDER BY w.cost + 5 * len(g.inserts) + e.price
            + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
            w.audit || repeat('I', len(g.inserts)) || e.edit) = 1),
counts AS (
    SELECT conv_id, max(pos) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM flagged GROUP BY conv_id),
ended AS (
    SELECT w.conv_id, w.cost + 5 * CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS cost,
        w.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
        w.turns || CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END
            AS turns
    FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.rows = w.pos
    QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY
        w.cost + 5 * CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END,
        w.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
    coalesce(audit, '') AS audit,
    sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
