"""DuckDB SQL for those operators of this subpackage that SQL can express."""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (greatest(n_symbols - 1, 0) * 1000) // greatest(n_words, 1) AS v1,
        (greatest(n_dup_lines - 1, 0) * 1000) // greatest(n_lines, 1) AS v2, (word_chars * 100) // greatest(n_words, 1) AS v3 FROM f),
v AS (SELECT lang, source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([v1, v2, v3, n_words, n_lines]) AS x FROM g WHERE NOT base_failed),
h AS (SELECT lang, source, rule, CASE WHEN x < 128 THEN x ELSE (x >> (length(bin(x)) - 7)) << (length(bin(x)) - 7) END AS b, count(*) AS n FROM v GROUP BY ALL),
k AS (SELECT lang, source, rule, b, n FROM h UNION ALL SELECT lang, NULL, rule, b, sum(n) FROM h GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rule ORDER BY b) AS up, sum(n) OVER (PARTITION BY lang, source, rule) AS total FROM k),
q AS (SELECT lang, source, rule, min(b) FILTER (4 * up >= total) AS lo, min(b) FILTER (4 * up >= 3 * total) AS hi, max(total) AS size FROM u GROUP BY lang, source, rule),
e AS (SELECT r.*, r.hi - r.lo AS iqr, (CASE r.rule WHEN 3 THEN r.hi ELSE 1000 END) // greatest(s.lo, 1) AS finest, CASE r.rule WHEN 1 THEN 10 WHEN 2 THEN 2 ELSE 12 END AS width
      FROM q r JOIN q s ON r.lang = s.lang AND r.source IS NOT DISTINCT FROM s.source AND s.rule = CASE r.rule WHEN 2 THEN 5 ELSE 4 END WHERE r.rule <= 3),
l AS (SELECT lang, rule, greatest(iqr, finest) AS spread, hi + width * greatest(iqr, finest) AS fence FROM e WHERE source IS NULL),
m AS (SELECT e.lang, e.source, e.rule, CASE WHEN size >= 50 THEN least(hi + width * greatest((iqr + spread) // 2, finest), 2 * fence) ELSE fence END AS most
      FROM e JOIN l ON e.lang = l.lang AND e.rule = l.rule WHERE e.source IS NOT NULL),
x AS (SELECT lang, source, max(most) FILTER (rule = 1) AS m1, max(most) FILTER (rule = 2) AS m2, max(most) FILTER (rule = 3) AS m3 FROM m GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(v1 <= m1 AND v2 <= m2 AND v3 <= m3, false) AS kept,
  CAST(m1 AS BIGINT) AS max_symbols, CAST(m2 AS BIGINT) AS max_dup_lines, CAST(m3 AS BIGINT) AS max_word_length
FROM g LEFT JOIN x USING (lang, source)
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, len(w) AS n, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(n, 10) AS k, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS g FROM bw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT DISTINCT k FROM win),
p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k),
m AS (SELECT doc_id, i, p.k, item FROM p JOIN win ON win.k = p.k AND win.g = array_to_string(w[i:i + p.k - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

URLS = r"""
WITH r AS (SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM r),
u AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*') AS path,
        regexp_extract(regexp_extract(rest, '^[^#]*'), '^[^?]*[?](.*)$', 1, 's') AS query FROM h),
v AS (SELECT *, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches('.' || host, '[-._/&=:](casino|poker|bets|betting|lottery|slots|jackpot|adult|porn|xxx|sex|escort|webcams|ads|adserver|adservice|banners|track|tracker|tracking|clicks|popunder|spam|cheap|pills|viagra|cialis|pharma|replica|payday|warez|torrent|torrents|crack|cracked|keygen)[-._/&=:]') THEN 'block'
    WHEN regexp_matches(path, '^/.*[.]([jJ][pP][gG]|[jJ][pP][eE][gG]|[pP][nN][gG]|[gG][iI][fF]|[sS][vV][gG]|[iI][cC][oO]|[wW][eE][bB][pP]|[cC][sS][sS]|[jJ][sS]|[wW][oO][fF][fF]|[mM][pP][34]|[aA][vV][iI]|[mM][oO][vV]|[zZ][iI][pP]|[gG][zZ]|[rR][aA][rR]|7[zZ]|[eE][xX][eE]|[dD][mM][gG]|[iI][sS][oO]|[aA][pP][kK])$', 's') THEN 'block'
    WHEN path LIKE '/%' AND regexp_matches(query, '(^|&)([sS][eE][sS][sS][iI][oO][nN][iI][dD]|[pP][hH][pP][sS][eE][sS][sS][iI][dD]|[jJ][sS][eE][sS][sS][iI][oO][nN][iI][dD]|[sS][iI][dD])=') THEN 'block'
    ELSE 'allow' END AS verdict
FROM v
"""
