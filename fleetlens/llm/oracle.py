"""DuckDB SQL for the queries that SQL can express."""

from fleetlens.llm import licences


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    t = f"translate(coalesce({column}, ''), '{licences.UPPER}', '{licences.LOWER}')"
    t = f"regexp_replace({t}, '{licences.COPYRIGHT_LINE}', '', 'g')"
    t = f"trim(regexp_replace({t}, '{licences.NOT_ALNUM}', ' ', 'g'))"
    for a, b in licences.SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return f"sha256({t})"


LICENCES = f"""
WITH known(licence, text) AS (VALUES {", ".join(f"({_quoted(k[0])}, {_quoted(k[2])})" for k in licences.KNOWN)}),
digests AS (SELECT min(licence) AS licence, {_canonical("text")} AS digest FROM known GROUP BY 2),
whole AS (SELECT doc_id, text, {_canonical("text")} AS canonical_sha256 FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL),
found AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences, count(*) AS n
  FROM lines JOIN digests ON digest = {_canonical("unit")} GROUP BY doc_id)
SELECT w.doc_id, canonical_sha256, licence, coalesce(line_licences, '') AS line_licences, coalesce(n, 0) AS n_licence_lines
FROM whole w LEFT JOIN digests ON digest = canonical_sha256 LEFT JOIN found f ON f.doc_id = w.doc_id
"""

URLS = r"""
WITH RECURSIVE
links AS (
  SELECT url AS src, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)]) AS link
  FROM pages),
resolved AS (
  SELECT src, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(src, '^([^:]*):', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(src, '^([^:]*://[^/?#]*)', 1) || link
    WHEN starts_with(link, '?') OR starts_with(link, '#') THEN regexp_extract(src, '^([^:]*://[^?#]*)', 1) || link
    ELSE regexp_extract(src, '^([^:]*://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(src, '^[^:]*://[^/?#]*([^?#]*/)', 1), ''), '/') || link END AS dst
  FROM links WHERE link <> ''),
urls AS (
  SELECT url, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT url FROM pages UNION SELECT dst FROM resolved)),
nodes AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '^[^#]*?(\?[^#]*)', 1) END AS node FROM urls),
rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
fits AS (
  SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM urls, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, position('/' IN rule))) GROUP BY url),
judged AS (SELECT n.*, rule, verdict FROM nodes n LEFT JOIN fits USING (url)),
edges AS (
  SELECT a.node AS u, b.node AS v FROM resolved r JOIN nodes a ON a.url = r.src JOIN nodes b ON b.url = r.dst WHERE a.node <> b.node
  UNION SELECT b.node, a.node FROM resolved r JOIN nodes a ON a.url = r.src JOIN nodes b ON b.url = r.dst WHERE a.node <> b.node),
reach(node, other) AS (SELECT u, u FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON e.u = r.other),
aliases AS (
  SELECT r.node FROM reach r JOIN judged j ON j.node = r.other GROUP BY r.node
  HAVING bool_or(j.verdict = 'block') AND NOT coalesce(bool_or(j.verdict = 'allow'), false))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(verdict, CASE WHEN a.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN judged j ON j.url = p.url LEFT JOIN aliases a ON a.node = j.node
"""

SUBSTRINGS = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM worded WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
repeated AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM windows),
gone AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM repeated WHERE again) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM worded d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""

NEAR = r"""
WITH RECURSIVE
worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
edges AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach(node, other) AS (SELECT u, u FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON e.u = r.other),
least_ AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_ l ON l.node = d.doc_id
"""

FILL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
keyed AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM hashed),
cut AS (
  SELECT doc_id, text, n, CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
                               WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix FROM keyed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


def _round(entries: str, name: str) -> str:
    """Common tables of one round: the nearest entry of every part, and (but for the last round) the next entries."""
    return f"""
{name}_gap AS (
  SELECT x.vec_id, x.part, e.entry, CAST(sum((x.v - e.v) * (x.v - e.v)) AS BIGINT) AS gap
  FROM components x JOIN {entries} e ON e.part = x.part AND e.position = x.position GROUP BY ALL),
{name}_near AS (SELECT vec_id, part, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap FROM {name}_gap GROUP BY ALL),
{name}_mean AS (
  SELECT part, entry, position, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
  FROM components JOIN {name}_near USING (vec_id, part) GROUP BY ALL),
{name}_next AS (
  SELECT part, entry, position, CASE WHEN n IS NULL THEN v ELSE (s - ((s % n) + n) % n) // n END AS v
  FROM {entries} LEFT JOIN {name}_mean USING (part, entry, position)),"""


CODES = f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
components AS (
  SELECT vec_id, (i - 1) // (len(embedding) // 16) AS part, (i - 1) % (len(embedding) // 16) AS position,
         CAST(floor(CAST(embedding[i] AS DOUBLE) * 256) AS BIGINT) AS v
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
start AS (
  SELECT part, entry, position, v FROM components
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 64),
{_round("start", "one")}{_round("one_next", "two")}{_round("two_next", "three")}
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error
  FROM three_near GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, position)) AS codebooks_sha256 FROM two_next)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""

ORACLES: dict[str, str] = {
    "op12_vector_codes": CODES,
    "op13_fill_middle": FILL,
    "op10_jaccard_join": NEAR,
    "op1_substring_dedup": SUBSTRINGS,
    "op3_url_filter": URLS,
    "op5_licences": LICENCES,
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS turn,
         source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM sources),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
best AS (SELECT arg_min(level, (cap / weight, turn)) AS uncapped FROM levels WHERE level * weight <= cap),
targets AS (SELECT source, source_size, least(cap, coalesce(uncapped * weight, cap)) AS target FROM levels CROSS JOIN best),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT doc_id, size, s.source, source_size, target, epochs, floor(target) - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM running
""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""",
}
