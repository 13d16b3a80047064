"""SQL of the queries that SQL can express, for the checking engine; the others are tested against plain versions."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
runs AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM runs) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w) w
      LEFT JOIN hit ON hit.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS bad FROM f GROUP BY source),
p AS (SELECT sum(bad) / sum(n) AS m, sum(bad * bad / n) / sum(n) - pow(sum(bad) / sum(n), 2)
        - (sum(bad) / sum(n)) * (1 - sum(bad) / sum(n)) * count(*) / sum(n) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM p),
r AS (SELECT source AS host, (bad + m * k) / (n + k) > 0.5 AS host_failed FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.host"""

OP2 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND owner <> page_id THEN owner END AS refers_to FROM f"""

_WORDS8 = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS8} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (
          SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (
         SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
found AS (SELECT doc_id, spots.m, i, item_id FROM spots JOIN win ON spots.win = win.win AND spots.m = win.m),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
place AS (SELECT item_id, i, m, k, w[i + k] AS term FROM (SELECT item_id, w, i, least(len(w), 10) AS m, unnest(range(least(len(w), 10))) AS k FROM (
            SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
term AS (SELECT doc_id, unnest(list_distinct(w)) AS term FROM d),
full_ AS (SELECT doc_id, item_id, i, any_value(m) AS m FROM place JOIN term USING (term) GROUP BY doc_id, item_id, i HAVING count(*) = any_value(m)),
spot AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d WHERE doc_id IN (SELECT doc_id FROM full_)),
offs AS (SELECT f.doc_id, f.item_id, f.i, f.m, k, pos - k AS o FROM full_ f JOIN place p ON p.item_id = f.item_id AND p.i = f.i
         JOIN spot ON spot.doc_id = f.doc_id AND spot.term = p.term),
met AS (SELECT a.doc_id, a.item_id FROM (SELECT DISTINCT doc_id, item_id, i, o FROM offs) a
        JOIN offs z ON z.doc_id = a.doc_id AND z.item_id = a.item_id AND z.i = a.i AND z.o BETWEEN a.o AND a.o + 3
        GROUP BY a.doc_id, a.item_id, a.i, a.o HAVING count(DISTINCT z.k) = any_value(z.m)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, CAST(coalesce(near.n, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size, md5('9:0:' || doc_id) AS seeded FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1] AS weight,
             row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
          - coalesce(CAST(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
        / CAST(sum(weight) OVER (ORDER BY 2 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
        row_number() OVER (ORDER BY 2 * source_size / weight, rank) AS place FROM r),
c AS (SELECT arg_min(level, place) AS level FROM l WHERE level * weight <= 2 * source_size),
t AS (SELECT source, source_size, coalesce(least(CAST(2 * source_size AS DOUBLE), c.level * weight), 2 * source_size) AS target,
             [[2.0, 1.0, 0.0], [1.0, 1.0, 1.0], [0.0, 1.0, 2.0]][(rank - 1) % 3 + 1]::DOUBLE[] AS y FROM l, c),
b AS (SELECT d.*, source_size, target, y, coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY seeded, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0)
        + size / 2 AS middle FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT doc_id, 1 AS copy, y, (y[1] + y[2]) / 4 AS half, (y[1] + y[2]) / 4 + (y[2] + y[3]) / 4 AS total, middle / target AS share FROM b WHERE middle < target
      UNION ALL SELECT doc_id, 2, y, (y[1] + y[2]) / 4, (y[1] + y[2]) / 4 + (y[2] + y[3]) / 4, (middle + source_size) / target FROM b WHERE middle + source_size < target),
q AS (SELECT doc_id, copy, y, CASE WHEN half <= share * total THEN 1 ELSE 0 END AS piece,
             share * total - CASE WHEN half <= share * total THEN half ELSE 0 END AS rest FROM u),
e AS (SELECT doc_id, copy, piece, rest, y[piece + 1] + sqrt(greatest(y[piece + 1] * y[piece + 1] + 2 * ((y[piece + 2] - y[piece + 1]) * 2) * rest, 0)) AS under FROM q),
f AS (SELECT doc_id, max(position) FILTER (WHERE copy = 1) AS first_position, max(position) FILTER (WHERE copy = 2) AS second_position FROM (
        SELECT doc_id, copy, least((piece + CASE WHEN under > 0 THEN 2 * rest / under * 2 ELSE 0 END) / 2, 1) AS position FROM e) GROUP BY doc_id)
SELECT b.doc_id, size, source_size, target,
       CAST(size * ((CASE WHEN middle < target THEN 1 ELSE 0 END) + (CASE WHEN middle + source_size < target THEN 1 ELSE 0 END)) AS BIGINT) AS taken,
       first_position, second_position FROM b LEFT JOIN f ON f.doc_id = b.doc_id"""
