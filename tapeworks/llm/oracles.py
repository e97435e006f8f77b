"""DuckDB statements that give the rows of the queries SQL can express."""

from __future__ import annotations

from .quality_rules import FENCE, GAMMA, MIN_ROWS, RATIOS, ZERO_BIN
from .url_filter import ALPHABET, BIN, CALIBRATION, LOWER, ORDER, RULES, UPPER
from .warc import BASE32, EPOCH

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_RATIO_ROWS = " UNION ALL ".join(
    f"SELECT lang, source, '{name}' AS ratio, {num} / CAST({den} AS DOUBLE) AS x FROM stats WHERE {den} > 0" for name, (num, den, _, _) in RATIOS.items())
_LEAST = " ".join(f"WHEN '{name}' THEN {spec[2]}" for name, spec in RATIOS.items())
_OUTSIDE = ", ".join(
    f"CASE WHEN {den} > 0 AND ({num} / CAST({den} AS DOUBLE) > {name}_high" + (f" OR {num} / CAST({den} AS DOUBLE) < {name}_low" if low else "")
    + f") THEN '{name}' END" for name, (num, den, _, low) in RATIOS.items())


def _quantiles(keys: str) -> str:
    return f"""SELECT {keys}, max(total) AS total, min(CASE WHEN upto >= total * 0.25 THEN v END) AS q25,
      min(CASE WHEN upto >= total * 0.75 THEN v END) AS q75
    FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}) AS total, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS upto,
        CASE WHEN bin = {ZERO_BIN} THEN 0.0 ELSE pow({GAMMA!r}, bin) * {2 / (GAMMA + 1)!r} END AS v
      FROM (SELECT {keys}, bin, sum(n) AS n FROM sketch GROUP BY {keys}, bin))
    GROUP BY {keys}"""


QUALITY_RULES = rf"""
WITH split_docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS words, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
counted AS (SELECT *, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams FROM split_docs),
windows AS (SELECT doc_id, unnest(grams) AS g, unnest(range(1, len(grams) + 1)) AS p FROM counted),
covered AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows), (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
line_rows AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(lines) AS l FROM counted) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line_rows GROUP BY doc_id),
stats AS (SELECT doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM counted LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id)),
sketch AS (SELECT lang, source, ratio, CASE WHEN x <= 0 THEN {ZERO_BIN} ELSE CAST(ceil(ln(x) / ln({GAMMA!r})) AS BIGINT) END AS bin, count(*) AS n
  FROM ({_RATIO_ROWS}) GROUP BY ALL),
own AS ({_quantiles("lang, source, ratio")}),
by_lang AS ({_quantiles("lang, ratio")}),
every AS ({_quantiles("ratio")}),
picked AS (SELECT o.lang, o.source, o.ratio,
    CASE WHEN o.total >= {MIN_ROWS} THEN o.q25 WHEN l.total >= {MIN_ROWS} THEN l.q25 ELSE a.q25 END AS q25,
    CASE WHEN o.total >= {MIN_ROWS} THEN o.q75 WHEN l.total >= {MIN_ROWS} THEN l.q75 ELSE a.q75 END AS q75
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.ratio = l.ratio JOIN every a ON o.ratio = a.ratio),
fenced AS (SELECT *, {FENCE} * greatest(q75 - q25, CASE ratio {_LEAST} END) AS spread FROM picked),
limits AS (SELECT lang, source, {", ".join(f"max(CASE WHEN ratio = '{r}' THEN q25 - spread END) AS {r}_low, max(CASE WHEN ratio = '{r}' THEN q75 + spread END) AS {r}_high" for r in RATIOS)}
  FROM fenced GROUP BY lang, source),
judged AS (SELECT s.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(list_aggregate([x FOR x IN [{_OUTSIDE}] IF x IS NOT NULL], 'string_agg', ','), '') AS failed
  FROM stats s LEFT JOIN limits t ON s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM judged"""

LINE_DEDUP = r"""
WITH line_rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
content AS (SELECT doc_id, l, i, row_number() OVER w - 1 AS k, lead(l, 1) OVER w AS l1, lead(l, 2) OVER w AS l2
  FROM line_rows WHERE regexp_matches(l, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, k, row_number() OVER (PARTITION BY l, l1, l2 ORDER BY doc_id, k) AS occurrence FROM content WHERE l2 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, k + d AS k FROM windows, (SELECT unnest([0, 1, 2]) AS d) WHERE occurrence > 1),
removed AS (SELECT c.doc_id, c.i FROM content c JOIN gone g ON c.doc_id = g.doc_id AND c.k = g.k)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, count(r.i) AS n_removed,
  coalesce(string_agg(CASE WHEN r.i IS NULL THEN l.l END, chr(10) ORDER BY l.i), '') AS text
FROM documents d JOIN line_rows l ON d.doc_id = l.doc_id LEFT JOIN removed r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY d.doc_id, d.text"""

_HEX = ["CAST('0x' || substr(s, %d, 5) AS INTEGER)" % (5 * i + 1) for i in range(8)]
_B32 = " || ".join(f"substr('{BASE32}', (({v} >> {shift}) & 31) + 1, 1)" for v in _HEX for shift in (15, 10, 5, 0))
WARC_PAGES = f"""
WITH hashed AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS s FROM pages),
sized AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, {_B32} AS payload_digest FROM hashed),
held AS (SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS holder FROM sized),
parsed AS (SELECT *, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE url END, '') AS rest FROM held),
cut AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS host FROM parsed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to,
  CASE WHEN coalesce(url, '') = '' THEN '' ELSE lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
    || CASE WHEN rest = host THEN '/' ELSE substr(rest, length(host) + 1) END) END AS url_key,
  strftime(make_timestamp(({EPOCH} + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM cut"""



def _url_filter() -> str:
    k = ORDER
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1] + r[2]))))
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = fits.format(*(f"'{h}{p}'" for _, h, p in ordered))
    ruled = fits.format(*(f"'{v}'" for v, _, _ in ordered))
    steps, table = [], f"SELECT gram, {1 / ALPHABET!r} AS p_a, {1 / ALPHABET!r} AS p_r FROM counts"
    for o in range(k + 1):
        steps.append(f"""own{o} AS (SELECT substr(gram, {k + 1 - o}, {o + 1}) AS piece, sum(a) AS n_a, sum(r) AS n_r FROM counts GROUP BY 1),
seen{o} AS (SELECT substr(piece, 1, {o}) AS context, sum(n_a) AS all_a, sum(n_r) AS all_r, count(*) FILTER (n_a > 0) AS kinds_a,
  count(*) FILTER (n_r > 0) AS kinds_r FROM own{o} GROUP BY 1),
p{o} AS (SELECT gram, CASE WHEN all_a > 0 THEN (n_a + kinds_a * p_a) / (all_a + kinds_a) ELSE p_a END AS p_a,
  CASE WHEN all_r > 0 THEN (n_r + kinds_r * p_r) / (all_r + kinds_r) ELSE p_r END AS p_r
  FROM ({table}) t JOIN own{o} ON piece = substr(gram, {k + 1 - o}, {o + 1}) JOIN seen{o} ON context = substr(gram, {k + 1 - o}, {o}))""")
        table = f"SELECT * FROM p{o}"
    return f"""
WITH parsed AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
ruled AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS by_rule, coalesce(substr(md5(url), 1, 1) IN ({", ".join(f"'{c}'" for c in CALIBRATION)}), false) AS out FROM parsed),
grams AS (SELECT page_id, by_rule, out, unnest(list_transform(range(1, length(padded) - {k} + 1), lambda i: substr(padded, i, {k + 1}))) AS gram
  FROM (SELECT *, repeat(chr(2), {k}) || coalesce(url, '') || chr(3) AS padded FROM ruled)),
counts AS (SELECT gram, count(*) FILTER (by_rule = 'allow' AND NOT out) AS a, count(*) FILTER (by_rule = 'block' AND NOT out) AS r FROM grams GROUP BY gram),
{", ".join(steps)},
scored AS (SELECT page_id, by_rule, out, round(avg(ln(p_a) - ln(p_r)), 9) AS score FROM grams JOIN p{k} USING (gram) GROUP BY ALL),
held AS (SELECT DISTINCT page_id, by_rule, CAST(floor(score / {BIN}) AS INTEGER) AS bin FROM scored WHERE out AND by_rule IS NOT NULL),
bins AS (SELECT bin, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad FROM held GROUP BY bin),
edges AS (SELECT bin, (bin + coalesce(lag(bin) OVER (ORDER BY bin), bin - 1) + 1) / 2.0 AS border, (sum(good) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / (SELECT sum(good) FROM bins)
  + coalesce(sum(bad) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(bad) FROM bins) AS accuracy FROM bins),
threshold AS (SELECT CASE WHEN (SELECT min(least(g, b)) FROM (SELECT sum(good) AS g, sum(bad) AS b FROM bins)) > 0
  THEN (SELECT border * {BIN}::DOUBLE FROM edges ORDER BY accuracy DESC, bin LIMIT 1) ELSE 0.0 END AS t)
SELECT page_id, host, path, rule, coalesce(r.by_rule, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict, score
FROM ruled r JOIN scored USING (page_id), threshold"""


ORACLES = {"op5_url_filter": _url_filter(), "op6_line_dedup": LINE_DEDUP, "op8_warc": WARC_PAGES, "op2_quality_rules": QUALITY_RULES}
