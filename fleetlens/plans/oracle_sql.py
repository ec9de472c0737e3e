"""DuckDB oracles: the expected answer of each registered query, computed from the raw
driver tables without rendering or parsing any text (so they check the parsers too)."""

from __future__ import annotations

# ------------------------------------------------------------------ shared CTEs

EV = """ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""

ACCESS = EV + """,
acc AS (
  SELECT ev.*,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN event_id % 97 = 0 THEN '/cron.php'
         WHEN k % 10 = 0 THEN '/list?page=' || CAST(k // 10 AS VARCHAR)
         WHEN k % 10 = 1 THEN '/files/' || repeat('long-segment-', 5) || CAST(k AS VARCHAR)
         ELSE '/node/' || CAST(user_id % 40 AS VARCHAR) END AS path,
    CASE WHEN event_type = 'error' THEN
           CASE WHEN k = 99 THEN 511 WHEN k % 4 = 0 THEN 404 WHEN k % 4 = 1 THEN 403 ELSE 500 + k % 4 END
         WHEN k % 7 = 0 THEN 304 ELSE 200 END AS status_code,
    CAST(round(value * 20000) AS BIGINT) AS us,
    'site' || CAST(user_id % 3 AS VARCHAR) AS site,
    CASE user_id % 4 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'curl/8.0'
         WHEN 2 THEN 'Drupal (+http://example.org/)' ELSE 'bot/1.0' END AS ua,
    CASE WHEN event_id % 10 = 9 THEN 'x-' ELSE 'v-' END || CAST(event_id AS VARCHAR) AS rid,
    CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts_s
  FROM ev),
acc2 AS (
  SELECT *, CAST(status_code AS VARCHAR) AS status,
    '10.0.0.' || user_id || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "' || method || ' ' || path
      || ' HTTP/1.1" ' || status_code || ' 100 "-" "' || ua || '" hosting_site=' || site || ' request_time=' || us
      || ' request_id="' || rid || '"' AS line
  FROM acc)"""

SHORT_PATH = "(substr(path, 1, 50) || CASE WHEN length(path) > 50 THEN '...' ELSE '' END)"


def _q(body: str, ctes: str = ACCESS) -> str:
    return "WITH " + ctes + "\n" + body


ORACLES: dict[str, str] = {}

ORACLES["hourly_traffic"] = _q("""
SELECT date_trunc('hour', ts_s) AS hour, count(*) AS n_requests,
  sum(us) / count(*) / 1000000.0 AS avg_s, max(us) / 1000000.0 AS max_s,
  count(*) FILTER (WHERE us > 3000000) AS n_slow,
  count(*) FILTER (WHERE status LIKE '2%') AS n_2xx, count(*) FILTER (WHERE status LIKE '3%') AS n_3xx,
  count(*) FILTER (WHERE status LIKE '4%') AS n_4xx, count(*) FILTER (WHERE status LIKE '5%') AS n_5xx,
  count(*) FILTER (WHERE us > 3000000) / count(*) > 0.05 AS flag_slow,
  count(*) FILTER (WHERE status LIKE '4%') / count(*) > 0.05 AS flag_4xx,
  count(*) FILTER (WHERE status LIKE '5%') > 0 AS flag_5xx
FROM acc2 WHERE site = 'site1' GROUP BY 1""")

WATCHDOG = ACCESS + """,
wd AS (
  SELECT acc2.*,
    CASE event_type WHEN 'view' THEN 'page not found' WHEN 'click' THEN 'php' WHEN 'signup' THEN 'user'
         WHEN 'purchase' THEN 'cron' WHEN 'error' THEN 'search' END AS wtype,
    CASE WHEN event_type = 'signup' AND k % 10 = 0 THEN 'dblog module enabled.'
         WHEN event_type = 'signup' AND k % 10 = 5 THEN 'statistics module disabled.'
         ELSE 'msg ' || CAST(k % 8 AS VARCHAR) || CASE WHEN k % 8 = 3 THEN ' exception' ELSE '' END END AS wmsg,
    strftime(ts, '%b %d %H:%M:%S') || ' host' || CAST(user_id % 5 AS VARCHAR) || ' ' || site
      || ': http://' || site || '.example.com' AS whead,
    epoch_us(ts) // 1000000 AS wepoch
  FROM acc2)"""

HOSTLOG = EV + """,
hl AS (
  SELECT ev.*, 'web-' || CAST(user_id % 5 AS VARCHAR) AS host,
    strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' ' || strftime(ts, '%H:%M:%S') AS stamp,
    CASE WHEN k % 5 = 0 THEN 'kernel: Out of memory: Kill process ' || event_id || ' (php) score 900'
         WHEN k % 5 = 1 THEN 'kernel: Killed process ' || event_id || ' (php-fpm) total-vm:2048kB'
         WHEN k % 5 = 2 THEN 'puppet-agent: Restarting php-fpm service'
         WHEN k % 5 = 3 AND k % 2 = 0 THEN 'hostwatch: AH_SPLIT_BRAIN: Split brain detected: db=main'
         WHEN k % 5 = 3 THEN 'hostwatch: AH_SERIOUS_ load above limit'
         ELSE 'cron: session idle' END AS text
  FROM ev),
hosts7 AS (SELECT DISTINCT 'web-' || CAST(s_suppkey % 7 AS VARCHAR) AS host FROM supplier)"""

SUPPLIER_HOSTS = """fo AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS folders FROM lineitem GROUP BY 1),
sh AS (
  SELECT 'web-' || CAST(s_suppkey AS VARCHAR) AS host, ['web', 'db', 'bal', 'ded'][s_suppkey % 4 + 1] AS role,
    s_acctbal AS metric, coalesce(folders, 0) AS folders, s_suppkey AS seq
  FROM supplier LEFT JOIN fo ON l_suppkey = s_suppkey)"""

STATS = """st AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, 'site' || CAST(user_id % 3 AS VARCHAR) AS site, 'hits' AS c3,
    count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS uncached
  FROM events GROUP BY 1, 2)"""

URL_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
URL_PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"

STORAGE = """tb AS (
  SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'mysql' ELSE 'site' END AS table_schema,
    't_' || l_returnflag || '_' || CAST(l_suppkey AS VARCHAR) AS table_name,
    CASE l_returnflag WHEN 'A' THEN 'InnoDB' WHEN 'N' THEN 'MyISAM' END AS engine,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS data,
    CAST(sum(CAST(round(l_quantity) AS BIGINT) * 1024) AS BIGINT) AS "index",
    count(*) AS row_count
  FROM lineitem GROUP BY l_returnflag, l_suppkey)"""

REVIEW = EV + """,
iss AS (
  SELECT 'repo-' || CAST(o_orderkey % 7 AS VARCHAR) AS repo, o_orderkey AS number,
    'Order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS title, o_orderdate AS updated_at,
    o_custkey % 50 AS author_id, 'user' || CAST(o_custkey % 50 AS VARCHAR) AS author,
    o_orderstatus AS l1, lpad(lower(hex((o_custkey * 99991) % 16777216)), 6, '0') AS c1,
    o_orderpriority AS l2, lpad(lower(hex((o_orderkey * 7919) % 16777216)), 6, '0') AS c2,
    o_orderkey % 5 <> 0 AS is_pr,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'https://example.org/repo-' || CAST(o_orderkey % 7 AS VARCHAR) || '/pull/'
      || CAST(o_orderkey AS VARCHAR) END AS html_url
  FROM orders),
req AS (
  SELECT 'repo-' || CAST(o_orderkey % 7 AS VARCHAR) AS repo, o_orderkey AS number, (o_orderkey * 3) % 50 AS user_id,
    'user' || CAST((o_orderkey * 3) % 50 AS VARCHAR) AS login
  FROM orders WHERE o_orderkey % 5 <> 0),
rev AS (
  SELECT event_id AS seq, 'repo-' || CAST((k * 4 + user_id % 4) % 7 AS VARCHAR) AS repo,
    CAST(k * 4 + user_id % 4 AS BIGINT) AS number, user_id % 50 AS user_id,
    'user' || CAST(user_id % 50 AS VARCHAR) AS login,
    CASE event_type WHEN 'click' THEN 'COMMENTED' WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'CHANGES_REQUESTED'
      WHEN 'view' THEN 'PENDING' WHEN 'signup' THEN 'DISMISSED' END AS state,
    CASE WHEN k % 31 = 7 THEN NULL WHEN k % 9 = 4 THEN ts - INTERVAL 12 DAY ELSE ts END AS submitted_at
  FROM ev),
allr AS (
  SELECT repo, number, user_id, login, 'REQUESTED' AS state, CAST(NULL AS TIMESTAMP) AS submitted_at,
    CAST(-1 AS BIGINT) AS seq FROM req
  UNION ALL SELECT repo, number, user_id, login, state, submitted_at, seq FROM rev),
ranked AS (
  SELECT *, CASE state WHEN 'COMMENTED' THEN 1 WHEN 'APPROVED' THEN 2 WHEN 'CHANGES_REQUESTED' THEN 2
                       WHEN 'DISMISSED' THEN 2 ELSE 0 END AS rank FROM allr),
folded AS (
  SELECT repo, number, user_id, list_reduce(
    list({'rank': rank, 't': submitted_at, 'state': state, 'login': login} ORDER BY seq),
    lambda a, x: CASE WHEN x.t IS NULL OR (a.t IS NOT NULL AND x.t <= a.t) OR x.rank < a.rank THEN a ELSE x END) AS f
  FROM ranked GROUP BY 1, 2, 3),
states AS (SELECT repo, number, user_id, f.login AS login, f.state AS state, f.t AS submitted_at FROM folded),
prs AS (SELECT * FROM iss WHERE is_pr),
summ AS (
  SELECT s.repo, s.number, string_agg(s.login || ':' || s.state, ' ' ORDER BY s.login, s.state) AS reviewers
  FROM states s JOIN prs p ON s.repo = p.repo AND s.number = p.number
  WHERE s.user_id <> p.author_id GROUP BY 1, 2),
appr AS (SELECT repo, number, count(*) AS n FROM states WHERE state = 'APPROVED' GROUP BY 1, 2),
mine AS (SELECT repo, number FROM states WHERE login = 'user7' AND state = 'APPROVED')"""

FLUSH_NOW = "TIMESTAMP '2024-01-30 23:30:00'"

REVIEW_IN_ORDER = REVIEW.replace("CASE WHEN k % 31 = 7 THEN NULL WHEN k % 9 = 4 THEN ts - INTERVAL 12 DAY ELSE ts END", "ts")


ORACLES.update({
    # ---------------------------------------------------------------- sources
    "read_lines": _q("SELECT site, line AS value FROM acc2"),
    "last_n_lines": _q("""
SELECT 'access-' || site || '.log' AS file, event_id AS seq, line AS value
FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY event_id DESC) AS rn FROM acc2) WHERE rn <= 3000"""),
    "file_sizes": _q("""
SELECT site, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, round(sum(strlen(line) + 1) / 1048576.0, 1) AS size_mb,
  sum(strlen(line) + 1) > 540000 AS flag_large
FROM acc2 GROUP BY site"""),
    "read_stats_csv": "WITH " + STATS + " SELECT * FROM st",
    "uncached_ratio": "WITH " + STATS + """
SELECT *, uncached / total AS ratio, CASE WHEN uncached / total > 0.2 THEN 'high' ELSE 'ok' END AS status
FROM st WHERE total > 0""",
    "flatten_inventory": """
SELECT r_name AS realm, n_name AS env, 'zone-' || CAST(s_suppkey % 3 AS VARCHAR) AS zone, s_name AS host,
  ['web', 'db', 'bal', 'ded'][s_suppkey % 4 + 1] AS role
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "hosts_by_role": """
SELECT role, host FROM (SELECT s_name AS host, ['web', 'db', 'bal', 'ded'][s_suppkey % 4 + 1] AS role FROM supplier)
WHERE role IN ('bal', 'web', 'db')""",
    "read_records": """
SELECT 'repo-' || CAST(o_orderkey % 7 AS VARCHAR) AS repo, o_orderkey AS number,
  'Order ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority AS title, o_orderdate AS updated_at,
  'user' || CAST(o_custkey % 50 AS VARCHAR) AS login, 2 AS n_labels,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'https://example.org/repo-' || CAST(o_orderkey % 7 AS VARCHAR) || '/pull/'
    || CAST(o_orderkey AS VARCHAR) END AS html_url
FROM orders""",
    "write_report": ORACLES["hourly_traffic"],
    "parse_access": _q("""
SELECT event_id AS seq, ts_s AS ts, method, path, 'HTTP/1.1' AS protocol, status, status_code, ua AS user_agent,
  site, us AS request_us, rid AS request_id FROM acc2"""),
    "parse_watchdog": _q("""
SELECT event_id AS seq, whead AS head, wepoch AS epoch, wtype AS type, '10.0.0.' || CAST(user_id AS VARCHAR) AS ip,
  path AS uri, user_id AS uid, wmsg || ' request_id="' || rid || '"' AS message FROM wd""", WATCHDOG),
    "normalize_error": _q("""
SELECT event_id AS seq, ' ' || CASE k % 3
  WHEN 0 THEN 'PHP Fatal error:  Allowed memory size of 134217728 bytes exhausted (tried to allocate [number] bytes) in /app/f'
    || CAST(k % 5 AS VARCHAR) || '.php'
  WHEN 1 THEN 'PHP Warning:  Division by zero in /app/f' || CAST(k % 5 AS VARCHAR) || '.php'
  ELSE 'PHP Notice:  Undefined index' END AS message
FROM ev WHERE event_type = 'error'""", EV),
    # ---------------------------------------------------------------- access / errors
    "top_slow": _q("""
SELECT method, path, count(*) AS n, sum(us) / count(*) / 1000000.0 AS avg_s, arg_min(ts_s, event_id) AS first_ts,
  arg_max(ts_s, event_id) AS last_ts, max(us) / 1000000.0 AS max_s
FROM acc2 WHERE site = 'site1' AND us > 3000000 GROUP BY method, path
ORDER BY n DESC, max(us) DESC, method DESC, path DESC LIMIT 10"""),
    "top_error_paths": _q(f"""
SELECT {SHORT_PATH} AS path, count(*) AS n FROM acc2 WHERE status LIKE '50%' GROUP BY 1 ORDER BY n DESC, path DESC LIMIT 5"""),
    "top_error_paths_hourly": _q(f"""
SELECT date_trunc('hour', ts_s) AS hour, {SHORT_PATH} AS path, count(*) AS n FROM acc2 WHERE status LIKE '50%'
GROUP BY 1, 2 ORDER BY n DESC, hour DESC, path DESC LIMIT 5"""),
    "paged_hits_by_agent": _q("""
SELECT ua AS user_agent, count(*) AS n, contains(ua, 'Drupal') AS flag_marker FROM acc2
WHERE regexp_matches(path, 'page=[1-9]') GROUP BY ua ORDER BY n DESC, user_agent DESC LIMIT 5"""),
    "latest_matching": _q("""
SELECT event_id AS seq, line AS value FROM acc2 WHERE method = 'GET' AND path = '/cron.php'
ORDER BY event_id DESC LIMIT 5"""),
    "top_errors": _q("""
SELECT message, count(*) AS n, contains(message, 'PHP Fatal error') AS flag_fatal FROM (
  SELECT ' ' || CASE k % 3
    WHEN 0 THEN 'PHP Fatal error:  Allowed memory size of 134217728 bytes exhausted (tried to allocate [number] bytes) in /app/f'
      || CAST(k % 5 AS VARCHAR) || '.php'
    WHEN 1 THEN 'PHP Warning:  Division by zero in /app/f' || CAST(k % 5 AS VARCHAR) || '.php'
    ELSE 'PHP Notice:  Undefined index' END AS message
  FROM ev WHERE event_type = 'error')
GROUP BY message ORDER BY n DESC, message DESC LIMIT 5""", EV),
    "oom_paths": _q("""
SELECT method, path, 'HTTP/1.1' AS protocol, status, count(*) AS n FROM acc2
WHERE event_type = 'error' AND k % 3 = 0 AND event_id % 10 <> 9
GROUP BY method, path, status ORDER BY n DESC, method DESC, path DESC, protocol DESC, status DESC LIMIT 10"""),
    "top_counts": _q("SELECT status, count(*) AS n FROM acc2 GROUP BY status ORDER BY n DESC, status DESC LIMIT 5"),
    "ten_minute_times": """
SELECT date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 10 * 10 AS BIGINT)) AS bucket, count(*) AS n,
  sum(us // 10) / count(*) / 1000000.0 AS avg_queue_s, max(us // 10) / 1000000.0 AS max_queue_s,
  sum(us) / count(*) / 1000000.0 AS avg_exec_s, max(us) / 1000000.0 AS max_exec_s
FROM (SELECT ts, CAST(round(value * 20000) AS BIGINT) AS us FROM events) GROUP BY 1""",
    # ---------------------------------------------------------------- watchdog
    "top_types": _q("""
SELECT wtype AS type, count(*) AS n, count(*) >= 2010 AS flag_large FROM wd GROUP BY 1
ORDER BY n DESC, type DESC LIMIT 5""", WATCHDOG),
    "top_messages_per_type": _q("""
, t AS (SELECT wtype, count(*) AS n FROM wd GROUP BY 1 ORDER BY n DESC, wtype DESC LIMIT 2),
m AS (SELECT wtype AS type, wmsg AS message, count(*) AS n FROM wd WHERE wtype IN (SELECT wtype FROM t) GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY type ORDER BY n DESC, message DESC) AS INTEGER) AS rank FROM m)
SELECT type, message, r.n AS n, rank, t.n AS type_n, r.n >= 240 AS flag_large,
  regexp_matches(message, '(?i)exception|error') AS flag_error
FROM r JOIN t ON r.type = t.wtype WHERE rank <= 5""".lstrip("\n"), WATCHDOG),
    "top_not_found": _q("""
SELECT path AS uri, count(*) AS n, count(*) >= 51 AS flag_large FROM wd WHERE wtype = 'page not found'
GROUP BY 1 ORDER BY n DESC, uri DESC LIMIT 5""", WATCHDOG),
    "recent_cron": _q("""
SELECT event_id AS seq, whead AS head, wmsg AS message, regexp_matches(wmsg, '(?i)exception') AS flag_exception
FROM wd WHERE wtype = 'cron' ORDER BY event_id DESC LIMIT 40""", WATCHDOG),
    "module_changes": _q("""
SELECT event_id AS seq, whead AS head, wmsg AS message, strftime(ts, '%m-%d') = '01-15' AS flag_today,
  wmsg = 'dblog module enabled.' AS flag_costly
FROM wd WHERE event_type = 'signup' AND k % 10 IN (0, 5)""", WATCHDOG),
    # ---------------------------------------------------------------- fleet logs
    "mail_per_day": """
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1""",
    "syslog_events": _q("""
SELECT host, event_id AS seq, stamp || ' ' || host || ' ' || text AS value,
  CAST(ts AS DATE) = DATE '2024-01-30' AS flag_today,
  date_trunc('hour', ts) = TIMESTAMP '2024-01-30 23:00:00' AS flag_hour,
  k % 5 IN (0, 1) AS flag_severe
FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY event_id DESC) AS rn FROM hl
      WHERE k % 5 IN (0, 1, 2) OR (k % 5 = 3 AND k % 2 = 1))
WHERE rn <= 100""", HOSTLOG),
    "literal_events": _q("""
SELECT host, event_id AS seq, stamp || ' ' || host || ' ' || text AS value,
  CAST(ts AS DATE) = DATE '2024-01-30' AS flag_today,
  date_trunc('hour', ts) = TIMESTAMP '2024-01-30 23:00:00' AS flag_hour
FROM hl WHERE k % 5 = 3 AND k % 2 = 1""", HOSTLOG),
    "skip_spawns": _q("""
SELECT host, '[' || strftime(ts, '%d-%b-%Y %H') || ':XX:XX' AS hour_key, count(*) AS n
FROM hl WHERE k % 4 IN (0, 1) GROUP BY 1, 2""", HOSTLOG),
    "skip_spawns_webserver": _q("""
SELECT host, strftime(ts, '%a %b %d %H') || ':XX' AS hour_key, count(*) AS n FROM hl WHERE k % 3 = 0 GROUP BY 1, 2""",
                                HOSTLOG),
    "count_literal_by_host": _q("""
SELECT h.host, coalesce(c.n, 0) AS n FROM hosts7 h
LEFT JOIN (SELECT host, count(*) AS n FROM hl WHERE k % 4 = 2 GROUP BY 1) c USING (host)""", HOSTLOG),
    "downtime_events": """
WITH p AS (SELECT page_id, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || ' web-' || (page_id % 5) || ' down' AS a,
  '2024-01-15 web-' || (page_id % 3) || ' up' AS b FROM pages)
SELECT page_id, CAST(3 AS BIGINT) AS pos, a AS piece, contains(a, '2024-01-15') AS flag_today FROM p
UNION ALL SELECT page_id, 5, b, true FROM p""",
    "flag_tasks": _q("""
SELECT host, event_id AS seq,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || host || ' ' ||
  ['code-push to Prod', 'db-migrate site', 'reboot web', 'cache clear', 'commit deployed', 'file copy'][k % 6 + 1] AS value,
  k % 6 IN (0, 1, 2, 4) AS flag_keyword, CAST(ts AS DATE) = DATE '2024-01-30' AS flag_today
FROM hl""", HOSTLOG),
    "audit_errors": _q("""
SELECT host, event_id AS seq, ' Module ' || CAST(k AS VARCHAR) || ' check failed' AS message FROM hl
WHERE event_type = 'error'""", HOSTLOG),
    "external_connections": _q("""
, c AS (
  SELECT host, CASE WHEN k % 3 = 0 THEN 'nginx' ELSE 'php-fpm' END AS process,
    CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol, [3306, 11211, 443, 80, 8080][k % 5 + 1] AS port
  FROM hl)
SELECT h.host, c.process, c.protocol, c.port, CASE WHEN c.process IS NULL THEN 'none' ELSE 'open' END AS status
FROM hosts7 h LEFT JOIN (SELECT * FROM c WHERE process LIKE 'php%' AND protocol = 'TCP' AND port NOT IN (3306, 11211)) c
USING (host)""".lstrip("\n"), HOSTLOG),
    "session_status": f"""
SELECT {URL_HOST} AS domain, page_id AS seq,
  CASE WHEN page_id % 13 = 0 THEN 'timeout' WHEN page_id % 5 = 0 THEN 'anonymous session'
       WHEN page_id % 3 = 0 AND page_id % 6 <> 0 THEN 'redirect' ELSE 'ok' END AS status
FROM pages""",
    "expand_urls": f"""
WITH d AS (SELECT DISTINCT {URL_HOST} AS domain FROM pages WHERE page_id % 3 = 0)
SELECT domain, 'http://' || domain AS url FROM d UNION ALL SELECT domain, 'https://' || domain AS url FROM d""",
    # ---------------------------------------------------------------- fleet tables
    "threshold_flag": "WITH " + SUPPLIER_HOSTS + " SELECT * FROM sh WHERE metric < 1000",
    "drift": "WITH " + SUPPLIER_HOSTS + """
SELECT host, folders, (SELECT max(folders) FROM sh) AS max_n, folders < (SELECT max(folders) FROM sh) AS flag_below_max,
  (SELECT max(folders) <> min(folders) FROM sh) AS problem FROM sh""",
    "process_capacity": _q("""
SELECT 'procs.txt' AS file, 'srv-' || CAST(event_id // 20 % 40 AS VARCHAR) AS server,
  CAST(max(CASE WHEN event_id % 20 = 16 THEN k + 20 END) AS BIGINT) AS max_overall,
  CAST(coalesce(max(CASE WHEN event_id % 20 = 15 AND event_id // 20 % 5 <> 0 THEN k END), 0) AS BIGINT) AS total_running,
  CAST(max(CASE WHEN event_id % 20 = 17 THEN k % 10 END) AS BIGINT) AS max_user,
  count(*) FILTER (WHERE event_id % 20 BETWEEN 1 AND 14 AND user_id % 3 = 1 AND (k % 3 > 0 OR k % 6 = 0)) AS user_running,
  CAST(max(CASE WHEN event_id % 20 = 18 THEN k * 10 + 4000 END) AS BIGINT) AS total_mem,
  CAST(max(CASE WHEN event_id % 20 = 18 THEN round(value * 10) END) AS BIGINT) AS free_mem,
  count(*) FILTER (WHERE event_id % 20 BETWEEN 1 AND 14 AND user_id % 3 = 1 AND (k % 3 > 0 OR k % 6 = 0))
    >= max(CASE WHEN event_id % 20 = 17 THEN k % 10 END) AS flag_user_at_max,
  max(CASE WHEN event_id % 20 = 18 THEN round(value * 10) END) / max(CASE WHEN event_id % 20 = 18 THEN k * 10 + 4000 END)
    < 0.2 AS flag_low_mem
FROM ev GROUP BY event_id // 20""", EV),
    "resolve_sections": _q("""
, s AS (
  SELECT ['Enterprise', 'Standard', 'Network', 'Gardens', 'Legacy'][(event_id // 10) % 5 + 1] AS label,
    'realms-' || CAST(event_id // 1000 AS VARCHAR) AS file, event_id AS seq,
    'site' || CAST(user_id % 3 AS VARCHAR) || '.' || CASE WHEN k % 2 = 0 THEN 'prod' ELSE 'test' END AS site
  FROM ev WHERE event_id % 10 <> 0)
SELECT label, file, seq, site,
  CASE label WHEN 'Enterprise' THEN 'ent' WHEN 'Standard' THEN 'std' WHEN 'Network' THEN 'net' WHEN 'Gardens' THEN 'gdn' END
    AS code,
  seq = max(seq) OVER (PARTITION BY file) AS chosen
FROM s""".lstrip("\n"), EV),
    "passive_or_active": """
WITH h AS (
  SELECT 'nation-' || CAST(s_nationkey AS VARCHAR) AS file, s_suppkey AS seq, 'db-' || CAST(s_suppkey AS VARCHAR) AS host,
    CASE WHEN s_suppkey % 10 = 3 THEN 'active-db' ELSE 'db' END AS role
  FROM supplier WHERE s_suppkey % 9 <> 0),
p AS (SELECT *, lag(role) OVER (PARTITION BY file ORDER BY seq) AS prev FROM h),
a AS (SELECT file, arg_max(host, seq) FILTER (WHERE prev = 'active-db') AS passive,
        arg_max(host, seq) FILTER (WHERE role = 'active-db') AS active FROM p GROUP BY file)
SELECT file, passive, active, coalesce(passive, active) AS chosen FROM a""",
})

HOST_LISTING = """hls AS (
  SELECT 'servers-' || CAST(s_nationkey AS VARCHAR) AS file, s_suppkey AS seq, ['srv', 'web', 'ded', 'staging', 'managed', 'bal', 'db'][s_suppkey % 7 + 1] AS prefix,
    s_suppkey % 11 = 0 AS marked, s_suppkey % 3 AS n3 FROM supplier),
hlw AS (SELECT * FROM hls WHERE prefix IN ('srv', 'web', 'ded', 'staging', 'managed') {marked}),
hw AS (SELECT *, bool_or(prefix = 'web') OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM hlw),
hoff AS (SELECT *, bool_or(prefix = 'ded' AND seen) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS off
         FROM hw)"""


def _hosts_sql(raw: bool) -> str:
    return ("WITH " + HOST_LISTING.replace("{marked}", "" if raw else "AND NOT marked")
            + " SELECT file, seq, prefix || '-' || CAST(seq AS VARCHAR) AS host FROM hoff WHERE NOT off")


def _in_list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


def _modules_sql() -> str:
    from .fixtures import CAUTION_MODULES, INCOMPATIBLE_MODULES

    listed = INCOMPATIBLE_MODULES + CAUTION_MODULES
    lists = " UNION ALL ".join(
        [f"SELECT 'Incompatible' AS severity, unnest({_in_list(INCOMPATIBLE_MODULES)}) AS name",
         f"SELECT 'Use-with-caution' AS severity, unnest({_in_list(CAUTION_MODULES)}) AS name"])
    names = f"""SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN {_in_list(listed)}[(p_partkey // 3) % {len(listed)} + 1]
      ELSE split_part(p_name, ' ', 1) END AS name FROM part"""
    return f"lists AS ({lists}), names AS ({names})"


SYSTEM = f"""mp AS (SELECT DISTINCT 'sites/all/modules' || {URL_PATH} || '.info' AS path FROM pages),
sy AS (
  SELECT 'sites/all/modules' || {URL_PATH} || CASE page_id % 3 WHEN 0 THEN '.module' WHEN 1 THEN '.theme' ELSE '.info' END
    AS filename, ['module', 'theme', 'profile', 'theme_engine'][page_id % 4 + 1] AS type,
    CASE WHEN page_id % 2 = 0 THEN 'enabled' ELSE 'disabled' END AS status
  FROM pages)"""

CACHE_TEXTS = ["page_cache_maximum_age  0", "block  cache  0", "Enabled  none", "Enabled  yes", "DRUPAL_NO_CACHE  views",
               "Disabled  foo"]
UPDATE_TEXTS = ["SECURITY UPDATE available", "Update available", "Installed version not supported", "Up to date"]

ORACLES.update({
    "select_hosts": _hosts_sql(False),
    "select_hosts_raw": _hosts_sql(True),
    "active_balancers": """
SELECT s_suppkey AS seq, 'bal-' || CAST(s_suppkey AS VARCHAR) AS host FROM supplier WHERE s_suppkey % 7 = 5 AND s_suppkey % 3 > 0""",
    "preview": f"""
WITH d AS (SELECT DISTINCT {URL_HOST} AS domain FROM pages)
SELECT domain, (SELECT count(*) FROM d) AS total FROM d ORDER BY domain LIMIT 15""",
    "domain_status": f"""
SELECT {URL_HOST} AS domain, '10.1.0.' || CAST(page_id % 256 AS VARCHAR) AS ip,
  CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not pointing at provider' ELSE 'No DNS entry' END AS status,
  page_id % 3 <> 0 AS flag
FROM pages""",
    "match_lists": "WITH " + _modules_sql() + " SELECT severity, name FROM names JOIN lists USING (name)",
    "count_over": "WITH " + _modules_sql() + " SELECT count(*) AS n, count(*) > 200 AS flag FROM names",
    "update_status": f"""
SELECT split_part(p_name, ' ', 1) || '_' || CAST(p_partkey AS VARCHAR) AS name,
  '7.x-1.' || CAST(p_size % 10 AS VARCHAR) AS existing_version, '7.x-1.' || CAST(p_size % 10 + 1 AS VARCHAR) AS candidate_version,
  {_in_list(UPDATE_TEXTS)}[p_partkey % 4 + 1] AS status_msg, p_partkey % 4 = 0 AS flag_security,
  p_partkey % 4 = 2 AS flag_unsupported
FROM part""",
    "cache_audit": _q(f"""
, c AS (SELECT 'web-' || CAST(user_id % 5 AS VARCHAR) || '/cacheaudit' AS file, event_id AS seq,
          {_in_list(CACHE_TEXTS)}[k % 6 + 1] AS value, k % 6 AS t FROM ev),
b AS (SELECT *, coalesce(sum(CASE WHEN t IN (2, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM c),
bh AS (SELECT file, blk, bool_or(t IN (0, 1, 2, 4)) AS hl FROM b GROUP BY 1, 2)
SELECT file, seq, value, 'head' AS kind, false AS highlight
FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) AS rn FROM c) WHERE rn <= 10
UNION ALL
SELECT b.file, b.seq, b.value, 'enabled' AS kind, bh.hl AS highlight FROM b JOIN bh USING (file, blk) WHERE t IN (2, 3)
""".lstrip("\n"), EV),
    "flag_overrides": """
SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 = 0
  THEN 'session.gc_probability => ' || CAST(p_partkey % 3 AS VARCHAR) || ' => 0 (overrides)'
  ELSE 'session.gc_maxlifetime => ' || CAST(p_size * 100 AS VARCHAR) || ' => ' || CAST(p_size * 100 AS VARCHAR) END AS value,
  p_partkey % 5 = 0 AS flag
FROM part""",
    "block_cache": """
SELECT p_brand AS module, p_partkey AS delta, ['', '0', '1', '-1', '8', NULL][p_partkey % 6 + 1] AS cache, p_name AS info,
  CASE WHEN p_partkey % 6 IN (0, 1, 5) THEN 'undefined' ELSE ['', '0', '1', '-1', '8', NULL][p_partkey % 6 + 1] END AS cache_mode
FROM part""",
    "classify_version": """
SELECT p_partkey AS site_id, product || ' ' || major || '.' || CAST(p_size AS VARCHAR) AS version, product, major,
  CASE WHEN major = '6' AND product <> 'Pressflow' THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 'Pressflow' ELSE 'Drupal' END AS product,
        CASE WHEN p_partkey % 2 = 0 THEN '6' ELSE '7' END AS major FROM part)""",
    "storage_by_engine": "WITH " + STORAGE + """,
g AS (SELECT CASE WHEN grouping(engine) = 1 THEN 'Total' ELSE engine END AS engine,
        CAST(sum(data) AS BIGINT) AS data_bytes, CAST(sum("index") AS BIGINT) AS index_bytes,
        CAST(sum(data + "index") AS BIGINT) AS total_bytes
      FROM tb WHERE table_schema NOT IN ('mysql', 'information_schema', 'performance_schema') AND engine IS NOT NULL
      GROUP BY ROLLUP (engine))
SELECT *, round(data_bytes / 1073741824.0, 3) AS data_gb, round(index_bytes / 1073741824.0, 3) AS index_gb,
  round(total_bytes / 1073741824.0, 3) AS total_gb FROM g""",
    "largest_tables": "WITH " + STORAGE + """
SELECT *, data + "index" AS total, data + "index" >= 1248000000 AS flag_size, row_count >= 228 AS flag_rows
FROM tb ORDER BY total DESC, table_name DESC LIMIT 10""",
    "large_payloads": """
SELECT source || '-' || CAST(doc_id AS VARCHAR) AS cid, CAST(strlen(text) AS INTEGER) AS bytes,
  strlen(text) / 1048576.0 AS size_mb
FROM documents WHERE strlen(text) > 10000 ORDER BY bytes DESC, cid DESC LIMIT 5""",
    "variable_stats": """
SELECT count(*) AS n, CAST(max(strlen(text)) AS INTEGER) AS max_len, CAST(sum(strlen(text)) AS BIGINT) AS total_len,
  count(*) >= 1000 AS flag_n, max(strlen(text)) >= 10000 AS flag_max, sum(strlen(text)) >= 1000000 AS flag_total
FROM documents""",
    "anonymous_sessions": """
SELECT uid, hostname, timestamp, make_timestamp(timestamp * 1000000) AS ts, left(session, 80) AS session FROM (
  SELECT user_id % 3 AS uid, '10.0.0.' || CAST(user_id AS VARCHAR) AS hostname, epoch_us(ts) // 1000000 AS timestamp,
    'uid|' || CAST(event_id AS VARCHAR) || '|' || event_type || '|' || props || '|' || repeat('ab', 40) AS session
  FROM events)
WHERE uid = 0 ORDER BY timestamp DESC, session DESC LIMIT 10""",
    "flush_ages": f"""
SELECT name, epoch, make_timestamp(epoch * 1000000) AS ts, epoch_us({FLUSH_NOW}) // 1000000 - epoch AS age_s,
  CAST(make_timestamp(epoch * 1000000) AS DATE) = DATE '2024-01-30' AS flag_today,
  epoch_us({FLUSH_NOW}) // 1000000 - epoch BETWEEN 10 AND 9999 AS flag_recent
FROM (SELECT 'cache_flush_' || event_type || '_' || CAST(event_id AS VARCHAR) AS name, epoch_us(ts) // 1000000 AS epoch
      FROM events)""",
    "duplicate_modules": "WITH " + SYSTEM + """,
n AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM mp),
d AS (SELECT name FROM n GROUP BY name HAVING count(DISTINCT path) > 1
        AND NOT regexp_matches(name, 'drupal_system_listing_(in|)compatible_test')),
e AS (SELECT DISTINCT regexp_replace(regexp_replace(filename, '\\.module', '.info', 'g'), '\\.theme', '.info', 'g') AS path
      FROM sy WHERE type IN ('module', 'theme', 'profile') AND status = 'enabled'),
c AS (SELECT n.name, n.path, e.path IS NOT NULL AS is_enabled FROM n JOIN d USING (name) LEFT JOIN e USING (path))
SELECT name, path, is_enabled FROM c WHERE name IN (SELECT name FROM c WHERE is_enabled)""",
    # ---------------------------------------------------------------- review queue
    "pull_requests": _q("SELECT repo, number, title, html_url FROM prs", REVIEW),
    "open_issues": _q("SELECT repo, number, title FROM iss WHERE NOT is_pr", REVIEW),
    "recent": _q("SELECT repo, number, title, html_url FROM prs WHERE updated_at >= TIMESTAMP '2000-01-01'", REVIEW),
    "review_state": _q("SELECT * FROM states", REVIEW),
    "review_state_exact": _q("SELECT * FROM states", REVIEW),
    "review_state_fast": _q("SELECT * FROM states", REVIEW_IN_ORDER),
    "not_approved_by": _q("""
SELECT repo, number, title, html_url FROM prs WHERE (repo, number) NOT IN (SELECT (repo, number) FROM mine)""", REVIEW),
    "below_min_approvals": _q("""
SELECT p.repo, p.number, p.title, p.html_url FROM prs p LEFT JOIN appr a USING (repo, number) WHERE coalesce(a.n, 0) < 3""",
                              REVIEW),
    "reviewer_summary": _q("SELECT * FROM summ", REVIEW),
    "review_queue": _q("""
SELECT p.repo, p.number, p.title, p.author, p.l1 || ', ' || p.l2 AS labels, s.reviewers, p.html_url
FROM prs p LEFT JOIN appr a USING (repo, number) LEFT JOIN summ s USING (repo, number)
WHERE p.updated_at >= TIMESTAMP '2000-01-01' AND coalesce(a.n, 0) < 3
  AND NOT EXISTS (SELECT 1 FROM mine m WHERE m.repo = p.repo AND m.number = p.number)""", REVIEW),
    "nearest_color": _q("""
, lb AS (SELECT repo, number, l1 AS name, c1 AS color FROM iss UNION ALL SELECT repo, number, l2, c2 FROM iss),
rgb AS (SELECT *, CAST('0x' || substr(color, 1, 2) AS INTEGER) AS r, CAST('0x' || substr(color, 3, 2) AS INTEGER) AS g,
          CAST('0x' || substr(color, 5, 2) AS INTEGER) AS b FROM lb),
d AS (SELECT *, (r*r + g*g + b*b) AS d0, ((r-255)*(r-255) + g*g + b*b) AS d1, (r*r + (g-255)*(g-255) + b*b) AS d2,
        ((r-255)*(r-255) + (g-255)*(g-255) + b*b) AS d3, ((r-92)*(r-92) + (g-92)*(g-92) + (b-255)*(b-255)) AS d4,
        ((r-255)*(r-255) + g*g + (b-255)*(b-255)) AS d5, (r*r + (g-255)*(g-255) + (b-255)*(b-255)) AS d6,
        ((r-255)*(r-255) + (g-255)*(g-255) + (b-255)*(b-255)) AS d7 FROM rgb),
m AS (SELECT *, least(d0, d1, d2, d3, d4, d5, d6, d7) AS dm FROM d),
bg AS (SELECT repo, number, name, color, CASE WHEN d0 = dm THEN 'black' WHEN d1 = dm THEN 'red' WHEN d2 = dm THEN 'green'
         WHEN d3 = dm THEN 'yellow' WHEN d4 = dm THEN 'blue' WHEN d5 = dm THEN 'magenta' WHEN d6 = dm THEN 'cyan'
         ELSE 'white' END AS bg FROM m)
SELECT *, CASE WHEN bg IN ('yellow', 'green', 'white') THEN 'black' ELSE 'white' END AS fg FROM bg""".lstrip("\n"), REVIEW),
    "outdated": """
SELECT repo, last_commit, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(last_commit)) // 86400000000 AS days FROM (
  SELECT 'repo-' || CAST(o_orderkey % 7 AS VARCHAR) AS repo, max(o_orderdate) AS last_commit FROM orders GROUP BY 1)
WHERE (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(last_commit)) // 86400000000 > 30""",
})

ORACLES["hourly_traffic_stream"] = ORACLES["hourly_traffic"]

ORACLES["ten_minute_times_stream"] = ORACLES["ten_minute_times"]
ORACLES["top_errors_stream"] = ORACLES["top_errors"]
ORACLES["version_drift"] = "WITH " + SUPPLIER_HOSTS + """
SELECT host, '1.' || CAST(folders % 3 AS VARCHAR) AS version,
  (SELECT count(DISTINCT folders % 3) FROM sh) > 1 AS problem FROM sh"""
ORACLES["flat_capacity"] = """
WITH r AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
c AS (SELECT 'web-' || CAST(s_suppkey AS VARCHAR) AS server, s_suppkey % 20 + 1 AS max_procs,
        coalesce(n, 0) % 25 AS running, CAST(4096 AS BIGINT) AS total_mem,
        CAST(round(abs(s_acctbal) / 2.5) AS BIGINT) AS free_mem
      FROM supplier LEFT JOIN r ON l_suppkey = s_suppkey)
SELECT *, running >= max_procs AS flag_at_max, free_mem / total_mem < 0.2 AS flag_low_mem FROM c"""

ORACLES["newest_files"] = _q("""
SELECT whead AS head, wmsg AS message, strftime(ts, '%m-%d') = '01-15' AS flag_today,
  wmsg = 'dblog module enabled.' AS flag_costly
FROM wd WHERE event_type = 'signup' AND k % 10 IN (0, 5)
  AND CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - INTERVAL 5 DAY""", WATCHDOG)

ORACLES.update({
    "latest_matching_files": "SELECT value FROM (" + ORACLES["latest_matching"] + ")",
    "top_slow_files": ORACLES["top_slow"],
    "recent_cron_files": "SELECT * EXCLUDE (seq) FROM (" + ORACLES["recent_cron"] + ")",
    "low_disk_space": """
WITH d AS (SELECT 'web-' || s_suppkey AS host, CAST(round(abs(s_acctbal) * 2) AS BIGINT) AS free FROM supplier),
f AS (SELECT host, '/dev/sda1' AS filesystem, free AS available_kb, '/' AS mounted FROM d
      UNION ALL SELECT host, '/dev/sdb1', free * 3, '/mnt' FROM d)
SELECT *, round(available_kb / 1024, 2) AS available_mb FROM f WHERE available_kb < 10240""",
    "busy_cpu": _q("""
SELECT 'web-' || CAST(user_id % 5 AS VARCHAR) AS host, event_id AS seq, CAST(k AS DOUBLE) + 0.25 AS cpu, k BETWEEN 40 AND 99 AS flag
FROM ev""", EV),
    "connection_limits": """
SELECT p_partkey AS seq, CASE WHEN p_partkey % 10 <> 0 THEN p_size * 20 END AS max_conn,
  p_partkey % 10 <> 0 AND p_size * 20 BETWEEN 100 AND 599 AS flag FROM part""",
    "memory_limits": "SELECT p_partkey AS seq, p_size * 8 AS limit_mb, p_size * 8 >= 200 AS flag FROM part",
    "mixed_layouts": """SELECT file, seq, head, type, uri, message FROM (VALUES ('pipe'), ('semicolon')) f(file), ("""
                     + ORACLES["parse_watchdog"] + ")",
})

# ------------------------------------------------------------------ other forms of the same reports

for _form, _of in {
    "top_error_paths_heavy": "top_error_paths", "top_error_paths_hourly_heavy": "top_error_paths_hourly",
    "paged_hits_by_agent_heavy": "paged_hits_by_agent", "top_errors_heavy": "top_errors", "top_types_heavy": "top_types",
    "top_not_found_heavy": "top_not_found", "oom_paths_filtered": "oom_paths", "oom_paths_stream": "oom_paths",
    "read_records_drift": "read_records", "newest_files_pruned": "newest_files",
    "hourly_traffic_increments": "hourly_traffic", "ten_minute_increments": "ten_minute_times",
    "process_capacity_stream": "process_capacity", "resolve_sections_stream": "resolve_sections", "cache_audit_stream": "cache_audit",
}.items():
    ORACLES[_form] = ORACLES[_of]

ORACLES["heavy_hitters"] = _q("""
SELECT url, status_code, count(*) AS n
FROM (SELECT CASE WHEN event_id % 5 < 2 THEN path ELSE path || '?id=' || rid END AS url, status_code FROM acc2)
GROUP BY 1, 2 ORDER BY n DESC, url DESC, status_code DESC LIMIT 5""")

ORACLES["report_store"] = _q("""
SELECT CAST(ts_s AS DATE) AS day, site, date_trunc('hour', ts_s) AS hour, ts_s AS ts, rid AS request_id, method, path, status, us AS request_us
FROM acc2 WHERE site = 'site1' AND hour(ts_s) = 7""")

ORACLES["parse_quality"] = """
SELECT 'access' AS log, count(*) AS lines, count(*) FILTER (WHERE event_id % 50 = 0 OR event_id % 70 = 0) AS malformed,
  count(*) FILTER (WHERE event_id % 50 = 0) AS no_ts, count(*) FILTER (WHERE event_id % 50 = 0) AS no_method,
  count(*) FILTER (WHERE event_id % 50 = 0) AS no_path,
  count(*) FILTER (WHERE event_id % 50 = 0 OR event_id % 70 = 0) AS no_status_code,
  count(*) FILTER (WHERE event_id % 50 = 0 OR event_id % 70 = 0) / count(*) AS malformed_share
FROM events"""

ORACLES["new_files"] = _q("""
SELECT site, date_trunc('hour', ts_s) AS hour, count(*) AS n, CAST(sum(us) AS BIGINT) AS sum_us, max(us) AS max_us,
  CAST(count(*) FILTER (WHERE us > 3000000) AS BIGINT) AS n_slow,
  CAST(count(*) FILTER (WHERE status LIKE '2%') AS BIGINT) AS n_2xx, CAST(count(*) FILTER (WHERE status LIKE '3%') AS BIGINT) AS n_3xx,
  CAST(count(*) FILTER (WHERE status LIKE '4%') AS BIGINT) AS n_4xx, CAST(count(*) FILTER (WHERE status LIKE '5%') AS BIGINT) AS n_5xx
FROM acc2 GROUP BY 1, 2""")

ORACLES["phrase_matches"] = _q("""
, texts AS (
  SELECT event_id AS seq, 'web-' || CAST(user_id % 5 AS VARCHAR) AS host, k % 5 AS t, k,
    strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S') || ' web-' || CAST(user_id % 5 AS VARCHAR) || ' ' ||
    CASE WHEN k % 5 = 0 THEN 'kernel: Out of memory: Kill process ' || event_id || ' (php) score 900'
         WHEN k % 5 = 1 THEN 'kernel: Killed process ' || event_id || ' (php-fpm) total-vm:2048kB'
         WHEN k % 5 = 2 THEN 'puppet-agent: Restarting php-fpm service'
         WHEN k % 5 = 3 AND k % 2 = 0 THEN 'hostwatch: AH_SPLIT_BRAIN: Split brain detected: db=main'
         WHEN k % 5 = 3 THEN 'hostwatch: AH_SERIOUS_ load above limit'
         ELSE 'cron: session idle' END AS value FROM ev),
phrases AS (
  SELECT DISTINCT array_to_string(string_split(p_name, ' ')[1:2], ' ') AS phrase FROM part
  UNION SELECT unnest(['Out of memory', 'AH_SERIOUS_', 'oad abov', 'web-3', 'kern', 'no such phrase'])),
hits AS (
  SELECT phrase, seq FROM texts JOIN phrases ON contains(value, phrase)
  UNION ALL
  SELECT 'process ' || seq || ' (php', seq FROM texts WHERE seq % 5 = 0 AND t IN (0, 1))
SELECT phrase, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM hits GROUP BY phrase""".lstrip("\n"), EV)
