"""The registered queries as plain SQL over the ``events`` table."""

from __future__ import annotations

HOUR = 3_600_000_000
DAY = 24 * HOUR

# Log rows out of the events table.
LOGS = """
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS kind, value, user_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS us
  FROM events),
logs AS (
  SELECT event_id, us, k, value,
    CASE WHEN kind IN ('error','view','click') THEN 'api-gateway'
         WHEN kind = 'signup' THEN 'auth-service'
         WHEN k % 10 = 0 THEN 'deployment-service' ELSE 'db-monitor' END AS service_name,
    CASE WHEN kind IN ('error','view','click') THEN 'http.request'
         WHEN kind = 'signup' AND k % 5 < 3 THEN 'auth.login_failed'
         WHEN kind = 'signup' THEN 'auth.login_success'
         WHEN k % 10 = 0 THEN 'deployment.failed' ELSE 'db.query' END AS event_type,
    CASE WHEN kind = 'error' AND k % 2 = 0 THEN 'ERROR'
         WHEN kind = 'signup' AND k % 5 < 3 THEN 'WARN'
         WHEN kind = 'purchase' AND k % 10 = 0 THEN 'ERROR' ELSE 'INFO' END AS log_level,
    CASE WHEN kind = 'error' AND k % 2 = 0 THEN 500 WHEN kind = 'error' THEN 404
         WHEN kind IN ('view','click') THEN 200 END AS status,
    CASE WHEN kind IN ('error','view','click') OR (kind = 'purchase' AND k % 10 <> 0)
         THEN value * 20 END AS latency_ms,
    CASE WHEN kind <> 'purchase' THEN '10.0.0.' || (user_id % 255 + 1) END AS client_ip,
    CASE WHEN kind IN ('error','view','click') THEN '/api/v1/r' || (k % 3) END AS path,
    CASE WHEN kind = 'purchase' AND k % 10 = 0
         THEN 'v0.' || (k % 5 + 1) || '.' || k END AS version,
    CASE WHEN kind = 'purchase' AND k % 10 = 0 AND value > 50 THEN 'container_crash' END AS reason,
    'node-' || (k % 3 + 1) AS host
  FROM ev),
msg AS (SELECT *, event_type || ' k=' || k AS message FROM logs),
proc AS (
  SELECT *,
    CASE WHEN event_type = 'auth.login_failed' THEN 'AUTH_FAILURE'
         WHEN event_type = 'http.request' AND status >= 500 THEN 'HTTP_ERROR'
         WHEN event_type = 'http.request' AND status >= 400 THEN 'HTTP_CLIENT_ERROR'
         WHEN event_type = 'http.request' THEN 'HTTP_SUCCESS'
         ELSE event_type END AS normalized_type,
    CASE WHEN event_type = 'auth.login_failed' THEN 'HIGH'
         WHEN event_type = 'http.request' AND status >= 500 THEN 'HIGH'
         WHEN event_type = 'http.request' AND status >= 400 THEN 'MEDIUM'
         ELSE 'LOW' END AS severity,
    CASE WHEN latency_ms IS NULL OR latency_ms = 0 THEN NULL
         WHEN latency_ms > 1000 THEN 'HIGH' WHEN latency_ms > 200 THEN 'MEDIUM'
         ELSE 'LOW' END AS latency_bucket
  FROM logs)
"""

# Signals of the per-event rules.
EVENT_SIGNALS = """
evsig AS (
  SELECT md5('HIGH_LATENCY|' || event_id) AS signal_id, 'HIGH_LATENCY' AS signal_type,
         'MEDIUM' AS severity, service_name AS service, event_id, us, 2 AS rule_order,
         latency_ms, version, reason, client_ip
  FROM logs WHERE event_type = 'http.request' AND latency_ms > 2000
  UNION ALL
  SELECT md5('DEPLOYMENT_FAILURE|' || event_id), 'DEPLOYMENT_FAILURE', 'HIGH', service_name,
         event_id, us, 4, latency_ms, version, reason, client_ip
  FROM logs WHERE event_type = 'deployment.failed'
  UNION ALL
  SELECT md5('DB_SLOW_QUERY|' || event_id), 'DB_SLOW_QUERY', 'MEDIUM', service_name,
         event_id, us, 5, latency_ms, version, reason, client_ip
  FROM logs WHERE event_type = 'db.query' AND latency_ms > 3000)
"""


def fired(name: str, key: str, where: str, n: int, window_us: int) -> str:
    """Count, fire, reset: walk from one firing row to the next good one."""
    return f"""
{name}_rows AS (
  SELECT *, {key} AS run_key,
    row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS rn,
    us - lag(us, {n - 1}) OVER (PARTITION BY {key} ORDER BY us, event_id) AS span
  FROM logs WHERE {where}),
{name}_good AS (SELECT run_key, rn FROM {name}_rows WHERE span <= {window_us}),
{name}_walk(run_key, rn) AS (
  SELECT run_key, min(rn) FROM {name}_good GROUP BY run_key
  UNION ALL
  SELECT g.run_key, min(g.rn) FROM {name}_walk w
  JOIN {name}_good g ON g.run_key = w.run_key AND g.rn >= w.rn + {n} GROUP BY g.run_key),
{name} AS (
  SELECT r.* FROM {name}_rows r JOIN {name}_walk w ON r.run_key = w.run_key AND r.rn = w.rn)
"""


SPIKE = fired("spike", "''", "event_type = 'http.request' AND status >= 500", 5, 6 * HOUR)
BRUTE = fired("brute", "client_ip", "event_type = 'auth.login_failed'", 3, DAY)

SIGNALS = """
sig AS (
  SELECT * FROM evsig
  UNION ALL
  SELECT md5('HTTP_ERROR_SPIKE|' || event_id), 'HTTP_ERROR_SPIKE', 'HIGH', service_name,
         event_id, us, 1, NULL, NULL, NULL, NULL FROM spike
  UNION ALL
  SELECT md5('BRUTE_FORCE_LOGIN|' || event_id), 'BRUTE_FORCE_LOGIN', 'HIGH', service_name,
         event_id, us, 3, NULL, NULL, NULL, client_ip FROM brute)
"""

INCIDENTS = """
inc AS (
  SELECT md5('inc|' || signal_id) AS id, service, signal_type AS error,
    CASE WHEN lower(signal_type) LIKE '%database%' THEN 'critical'
         WHEN lower(signal_type) LIKE '%timeout%' THEN 'high'
         WHEN lower(signal_type) LIKE '%connection%' THEN 'high'
         WHEN lower(signal_type) LIKE '%error%' THEN 'medium' ELSE 'low' END AS severity,
    'open' AS status, us AS created_us, signal_id, severity AS signal_severity,
    latency_ms, reason
  FROM sig)
"""

UPDATES = """
upd AS (
  SELECT id, 'in_progress' AS status, created_us + 600000000 AS changed_us, 0 AS seq
  FROM inc WHERE signal_severity = 'HIGH'
  UNION ALL SELECT id, 'in_progress', created_us + 900000000, 1
  FROM inc WHERE signal_severity = 'HIGH'
  UNION ALL SELECT id, 'escalated', created_us + 1500000000, 2
  FROM inc WHERE error = 'DEPLOYMENT_FAILURE'
  UNION ALL SELECT id, 'resolved', created_us + 1800000000, 0 FROM inc
  WHERE latency_ms > 3000 AND error IN ('HIGH_LATENCY','DB_SLOW_QUERY')
  UNION ALL SELECT id, 'in_progress', created_us + 1800000000, 1 FROM inc
  WHERE latency_ms > 4000 AND error IN ('HIGH_LATENCY','DB_SLOW_QUERY')
  UNION ALL SELECT md5('ghost|' || id), 'resolved', created_us + 300000000, 0
  FROM inc WHERE error = 'HTTP_ERROR_SPIKE'),
lastupd AS (
  SELECT id, arg_max(status, changed_us * 10 + seq) AS status, max(changed_us) AS changed_us
  FROM upd GROUP BY id),
state AS (
  SELECT i.id, i.service, i.error, i.severity, coalesce(u.status, i.status) AS status,
         i.created_us, u.changed_us
  FROM inc i LEFT JOIN lastupd u ON i.id = u.id),
changes AS (
  SELECT id, status, created_us AS changed_us, -1 AS seq, 0 AS opens FROM inc
  UNION ALL SELECT id, status, changed_us, seq, 1 FROM upd WHERE id IN (SELECT id FROM inc)),
steps AS (
  SELECT *, lag(status) OVER (PARTITION BY id ORDER BY opens, changed_us, seq) AS previous
  FROM changes)
"""

# Updates in order, with deadlines of 20 and 12 minutes.
JUDGED = """
, nth AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY opens, changed_us, seq) AS rn FROM changes),
judge(id, rn, us, status, seq, state, since, due, was, notice) AS (
  SELECT id, rn, changed_us, status, seq, status, changed_us, NULL::BIGINT, NULL::VARCHAR, 'created'
  FROM nth WHERE rn = 1
  UNION ALL
  SELECT id, rn, us, status, seq, CASE WHEN may THEN status ELSE now END,
         CASE WHEN may THEN us WHEN over THEN ends ELSE since END,
         CASE WHEN over THEN ends END, CASE WHEN over THEN state END,
         CASE WHEN may AND status = 'in_progress' THEN 'updated' WHEN may THEN status END
  FROM (
    SELECT *, now || '>' || status IN (
      'open>in_progress','open>escalated','open>resolved','in_progress>escalated',
      'in_progress>resolved','escalated>resolved') AS may
    FROM (
      SELECT *, CASE WHEN over THEN 'escalated' ELSE state END AS now
      FROM (
        SELECT *, coalesce(ends < us, FALSE) AS over
        FROM (
          SELECT n.id, n.rn, n.changed_us AS us, n.status, n.seq, j.state, j.since,
                 j.since + CASE j.state WHEN 'open' THEN 1200000000 WHEN 'in_progress' THEN 720000000 END AS ends
          FROM judge j JOIN nth n ON n.id = j.id AND n.rn = j.rn + 1))))),
ended AS (
  SELECT id, arg_max(state, rn) AS was,
         arg_max(since, rn) + CASE arg_max(state, rn) WHEN 'open' THEN 1200000000 WHEN 'in_progress' THEN 720000000 END AS due
  FROM judge GROUP BY id),
judged AS (
  SELECT id, previous, status, us AS changed_us, seq::BIGINT AS seq,
         CASE WHEN previous IS NULL THEN 'opened' WHEN previous = status THEN 'unchanged'
              WHEN previous = 'resolved' THEN 'rejected'
              WHEN previous = 'escalated' AND status = 'in_progress' THEN 'rejected'
              ELSE 'valid' END AS verdict, state, notice
  FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY rn) AS previous FROM judge)
  UNION ALL
  SELECT id, was, 'escalated', due, NULL, 'overdue', 'escalated', 'escalated'
  FROM (SELECT id, was, due FROM judge UNION ALL SELECT id, was, due FROM ended) WHERE due IS NOT NULL)
"""

RESPONSES = """
books(error, action) AS (VALUES ('DB_SLOW_QUERY','restart_database'),
  ('HTTP_ERROR_SPIKE','restart_http_service'), ('BRUTE_FORCE_LOGIN','lock_accounts'),
  ('DEPLOYMENT_FAILURE','rollback_deployment')),
plan AS (
  SELECT i.id AS incident_id, b.action, i.service, i.error, i.signal_severity AS severity,
         i.created_us, i.latency_ms, i.reason
  FROM inc i JOIN books b ON i.error = b.error),
ran AS (
  SELECT *, CASE WHEN (latency_ms > 3500 AND error IN ('HIGH_LATENCY','DB_SLOW_QUERY'))
                   OR (error = 'DEPLOYMENT_FAILURE' AND reason IS NOT NULL)
                 THEN 'failed' ELSE 'success' END AS status
  FROM plan),
bad AS (
  SELECT error, service, action, count(*) AS failures,
         list_sort(list(created_us + 60000000))[5] AS failed_us
  FROM ran WHERE status = 'failed' GROUP BY ALL HAVING count(*) >= 5),
approvals AS (
  SELECT id AS incident_id, 'rollback' AS action, TRUE AS approved,
         created_us + 180000000 AS decided_us FROM inc WHERE error = 'DEPLOYMENT_FAILURE'
  UNION ALL SELECT id, 'rollback', FALSE, created_us + 240000000 FROM inc
  WHERE error = 'DEPLOYMENT_FAILURE' AND reason IS NOT NULL
  UNION ALL SELECT id, 'block', FALSE, created_us + 120000000 FROM inc
  WHERE error = 'BRUTE_FORCE_LOGIN'),
stepbook(playbook_id, error, requires_approval, step_order, action_type, target, command,
         retry_count) AS (VALUES
  ('pb-db','DB_SLOW_QUERY',FALSE,1,'RUN_SCRIPT',NULL,'kill_long_queries',2),
  ('pb-db','DB_SLOW_QUERY',FALSE,2,'RESTART_SERVICE','db-monitor','restart',1),
  ('pb-deploy','DEPLOYMENT_FAILURE',TRUE,1,'ROLLBACK_DEPLOYMENT',NULL,'rollback',1),
  ('pb-deploy','DEPLOYMENT_FAILURE',TRUE,2,'NOTIFY_ONLY',NULL,'notify',0),
  ('pb-login','BRUTE_FORCE_LOGIN',TRUE,1,'BLOCK_IP','api-gateway','block',3)),
actions AS (
  SELECT i.id AS incident_id, s.playbook_id, s.requires_approval, s.step_order, s.action_type,
         coalesce(s.target, i.service) AS target_service, s.command, s.retry_count
  FROM inc i JOIN stepbook s ON i.error = s.error)
"""

GROUPS = f"""
linked AS (
  SELECT *, us - us % {HOUR} AS window_start_us,
         md5('group|' || CAST(us - us % {HOUR} AS VARCHAR)) AS group_id FROM sig),
groups AS (
  SELECT group_id, window_start_us, count(*) AS n_signals,
    count(DISTINCT service) AS n_services, count(DISTINCT signal_type) AS n_types,
    array_to_string(list_sort(list(DISTINCT service)), ',') AS services,
    CASE max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
      WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS top_severity,
    round(least(1.0::DOUBLE, count(DISTINCT signal_type) / 5.0::DOUBLE)
          * least(1.0::DOUBLE, count(DISTINCT service) / 5.0::DOUBLE), 6) AS confidence,
    count(DISTINCT service) > 1 AS cross_service
  FROM linked GROUP BY group_id, window_start_us),
sess_flag AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= {HOUR} THEN 0 ELSE 1 END AS opens
  FROM sig WINDOW w AS (PARTITION BY service, signal_type ORDER BY us, signal_id)),
sess_no AS (
  SELECT *, sum(opens) OVER (PARTITION BY service, signal_type ORDER BY us, signal_id) AS sno
  FROM sess_flag),
sess_start AS (
  SELECT *, min(us) OVER (PARTITION BY service, signal_type, sno) AS start_us FROM sess_no),
sess AS (
  SELECT md5('session|' || service || '|' || signal_type || '|' || CAST(start_us AS VARCHAR))
           AS incident_id, *
  FROM sess_start),
sessions AS (
  SELECT incident_id, service, signal_type AS error, 'open' AS status,
    CASE max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
      WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
    count(*) AS occurrence_count, min(us) AS created_us, max(us) AS updated_us,
    arg_min(signal_id, us) AS first_signal, arg_max(signal_id, us) AS last_signal
  FROM sess GROUP BY incident_id, service, signal_type)
"""

# Text lines as the services write them, some of them damaged; what a parser
# should make of each follows from the latency that decides the damage.
LINES = """
lines AS (
  SELECT *,
    CASE WHEN latency_ms > 5000 THEN 'malformed' WHEN latency_ms < 10 THEN 'empty'
         WHEN latency_ms < 15 THEN 'not_object' WHEN latency_ms < 20 THEN 'missing_field'
         WHEN latency_ms < 25 THEN 'no_metadata' WHEN latency_ms < 30 THEN 'bad_type'
    END AS reason_out
  FROM proc)
"""

RATES = f"""
rates AS (
  SELECT service_name, us - us % {HOUR} AS window_start_us, count(*) AS events,
    count(*) FILTER (log_level IN ('ERROR','CRITICAL','ALERT')) AS errors,
    round(count(*) FILTER (log_level IN ('ERROR','CRITICAL','ALERT'))
          / count(*)::DOUBLE, 6) AS error_rate
  FROM logs GROUP BY 1, 2)
"""


def intervals(name: str, source: str, within_us: int, by: str) -> str:
    """Links by a range join, groups by the gaps between signals in time order."""
    same = f"a.{by} = b.{by} AND" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    key = f" || '|' || {by}" if by else ""
    return f"""
{name}_n AS (
  SELECT a.signal_id, count(*) - 1 AS n_links FROM {source} a JOIN {source} b
    ON {same} b.us BETWEEN a.us - {within_us} AND a.us + {within_us} GROUP BY a.signal_id),
{name}_flag AS (
  SELECT *, CASE WHEN us - lag(us) OVER ({part} ORDER BY us, signal_id) <= {within_us} THEN 0 ELSE 1 END AS opens
  FROM {source}),
{name}_no AS (SELECT *, sum(opens) OVER ({part} ORDER BY us, signal_id) AS no FROM {name}_flag),
{name}_start AS (SELECT *, min(us) OVER (PARTITION BY no{", " + by if by else ""}) AS group_start_us FROM {name}_no),
{name} AS (
  SELECT s.*, n_links, md5('interval|' || group_start_us{key}) AS group_id
  FROM {name}_start s JOIN {name}_n USING (signal_id))
"""


GROUP_ROW = """
    min(group_start_us) AS group_start_us, max(us) AS group_end_us, count(*) AS n_signals,
    CAST(sum(n_links) // 2 AS BIGINT) AS n_links,
    array_to_string(list_sort(list(DISTINCT service)), ',') AS services,
    round(least(1.0::DOUBLE, count(DISTINCT signal_type) / 5.0::DOUBLE)
          * least(1.0::DOUBLE, count(DISTINCT service) / 5.0::DOUBLE), 6) AS confidence"""
TRACED = "traced AS (SELECT s.*, 'trace-' || e.user_id AS trace_id FROM sig s JOIN ev e ON s.event_id = e.event_id)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


P_LOGS = _with(LOGS)
P_EVSIG = _with(LOGS, EVENT_SIGNALS)
P_SIG = _with(LOGS, EVENT_SIGNALS, SPIKE, BRUTE, SIGNALS)
P_INC = P_SIG + "," + INCIDENTS
P_UPD = P_INC + "," + UPDATES
P_RESP = P_UPD + "," + RESPONSES
P_GROUPS = P_SIG + "," + GROUPS

TIME_TEXT = "strftime(make_timestamp({us} - {us} % 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
INC_TIME = TIME_TEXT.format(us="created_us")
ALERT_TEXT = (
    "'Service: ' || service || chr(10) || 'Severity: ' || severity || chr(10) || "
    "'{label}: ' || error || chr(10) || 'Time: ' || {time} || chr(10)"
)

RULE_ROWS = f"""
logs_at AS (SELECT *, make_timestamp(us) AS t FROM logs),
versioned AS (
  SELECT md5('HIGH_LATENCY|' || event_id) AS signal_id, 'latency' AS rule_id,
    CASE WHEN t < TIMESTAMP '2024-01-11' THEN 1 WHEN t < TIMESTAMP '2024-01-21' THEN 2
         ELSE 3 END AS version,
    'HIGH_LATENCY' AS signal_type, event_id,
    CASE WHEN t < TIMESTAMP '2024-01-11' THEN 'MEDIUM' WHEN t < TIMESTAMP '2024-01-21'
         THEN 'HIGH' ELSE 'CRITICAL' END AS severity, us AS detected_at
  FROM logs_at WHERE event_type = 'http.request' AND
    CASE WHEN t < TIMESTAMP '2024-01-11' THEN latency_ms > 2000
         WHEN t < TIMESTAMP '2024-01-21' THEN latency_ms >= 3000 ELSE latency_ms > 4000 END
  UNION ALL
  SELECT md5('DEPLOYMENT_FAILURE|' || event_id), 'deploy', 1, 'DEPLOYMENT_FAILURE', event_id, 'HIGH', us
  FROM logs_at WHERE event_type = 'deployment.failed' AND t >= TIMESTAMP '2024-01-06'
  UNION ALL
  SELECT md5('HTTP_NOT_FOUND|' || event_id), 'missing', 1, 'HTTP_NOT_FOUND', event_id, 'LOW', us
  FROM logs_at WHERE event_type = 'http.request' AND status = 404
  UNION ALL
  SELECT md5('DEPLOYMENT_SEEN|' || event_id), 'deploys', 1, 'DEPLOYMENT_SEEN', event_id, 'LOW', us
  FROM logs_at WHERE event_type = 'deployment.failed' AND t < TIMESTAMP '2024-01-13'
  UNION ALL
  SELECT md5('CONTAINER_CRASH|' || event_id), 'crash', 1, 'CONTAINER_CRASH', event_id, 'HIGH', us
  FROM logs_at WHERE event_type = 'deployment.failed' AND reason = 'container_crash')
"""


def dense_scores(value: str) -> str:
    """Every hour of a service from its first to the last of all, silent or not."""
    return f"""
    spine AS (
      SELECT service_name, unnest(generate_series(min(window_start_us),
        (SELECT max(window_start_us) FROM rates), {HOUR})) AS window_start_us
      FROM rates GROUP BY service_name),
    dense AS (
      SELECT s.service_name, s.window_start_us, coalesce(events, 0) AS events, coalesce(errors, 0) AS errors
      FROM spine s LEFT JOIN rates r
        ON r.service_name = s.service_name AND r.window_start_us = s.window_start_us),
    dense_past AS (
      SELECT *, round(avg({value}::DOUBLE) OVER w, 6) AS moving_avg,
             round(stddev_pop({value}::DOUBLE) OVER w, 6) AS moving_std
      FROM dense WINDOW w AS (PARTITION BY service_name ORDER BY window_start_us
                              ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
    dense_scored AS (
      SELECT *, CASE WHEN moving_std > 0 THEN round(({value} - moving_avg) / moving_std, 6) END AS zscore
      FROM dense_past),
    dense_marked AS (
      SELECT *, coalesce(abs(zscore) > 2.0, FALSE) AS is_zscore,
        coalesce({value} > moving_avg * 3.0, FALSE) AS is_moving_avg, {value} > 3 AS is_threshold FROM dense_scored)"""


DENSE_FLAGGED = """
        SELECT service_name, window_start_us, errors, moving_avg, moving_std, zscore,
               is_zscore, is_moving_avg, is_threshold
        FROM dense_marked WHERE is_zscore OR is_moving_avg OR is_threshold"""
JAN_16 = "epoch_us(TIMESTAMP '2024-01-16')"
RULE_WINDOWS = (
    fired("w1", "''", "event_type = 'http.request' AND status >= 500 AND us < " + JAN_16, 5, 6 * HOUR),
    fired("w2", "''", "event_type = 'http.request' AND status >= 400 AND us >= " + JAN_16, 6, 3 * HOUR),
    fired("w3", "''", "event_type = 'deployment.failed' AND us >= epoch_us(TIMESTAMP '2024-01-13')", 2, 12 * HOUR),
    BRUTE,
    """windowed AS (
  SELECT 'spike' AS rule_id, 1 AS version, 'HTTP_ERROR_SPIKE' AS signal_type, event_id, us FROM w1
  UNION ALL SELECT 'spike', 2, 'HTTP_ERROR_SPIKE', event_id, us FROM w2
  UNION ALL SELECT 'deploys', 2, 'DEPLOYMENT_STORM', event_id, us FROM w3
  UNION ALL SELECT 'logins', 1, 'BRUTE_FORCE_LOGIN', event_id, us FROM brute)
""",
)

ORACLES: dict[str, str] = {
    "processed_logs": P_LOGS + """
        SELECT event_id, service_name, us, normalized_type, severity, latency_bucket,
               'us-east-1' AS region, 'prod-cluster' AS cluster FROM proc""",
    "severity_counts": P_LOGS + """
        SELECT normalized_type, severity, count(*) AS events FROM proc GROUP BY 1, 2""",
    "latency_buckets": P_LOGS + """
        SELECT service_name AS service, latency_bucket, count(*) AS events
        FROM proc GROUP BY 1, 2""",
    "parsed_json_lines": _with(LOGS, LINES) + """
        SELECT event_id, service_name, log_level, us, normalized_type, severity, status,
               latency_ms, client_ip FROM lines WHERE reason_out IS NULL""",
    "dead_letters": _with(LOGS, LINES) + """
        SELECT reason_out AS reason, count(*) AS lines FROM lines
        WHERE reason_out IS NOT NULL GROUP BY 1""",
    "processing_status": _with(LOGS, LINES) + """
        SELECT CASE WHEN reason_out IS NULL THEN 'processed' ELSE 'dropped' END AS status,
               count(*) AS lines FROM lines GROUP BY 1""",
    "regex_parsed_lines": _with(LOGS) + """
        SELECT CASE WHEN event_type = 'http.request' THEN 'access_line' ELSE 'service_line' END
                 AS pattern,
               service_name, event_type,
               CASE WHEN event_type = 'http.request' AND status >= 500 THEN 'ERROR'
                    WHEN event_type = 'http.request' THEN 'INFO' ELSE log_level END AS log_level,
               us, status, client_ip, path, version,
               CASE WHEN event_type = 'http.request' THEN round(latency_ms, 2) END AS latency_ms
        FROM logs WHERE event_type <> 'auth.login_success'""",
    "regex_unmatched_lines": P_LOGS + """
        SELECT message AS value, count(*) AS lines FROM msg
        WHERE event_type = 'auth.login_success' GROUP BY 1""",
    "lines_by_format_table": P_LOGS + """
        , named AS (
          SELECT *, CASE event_type WHEN 'auth.login_failed' THEN 'failed_login'
            WHEN 'deployment.failed' THEN 'deployment' WHEN 'db.query' THEN 'service_line'
            WHEN 'http.request' THEN CASE WHEN status >= 500 THEN 'server_error'
              WHEN path = '/api/v1/r0' THEN 'first_path' ELSE 'access_line' END END AS pattern
          FROM msg)
        SELECT pattern,
               CASE WHEN pattern IS NOT NULL THEN service_name END AS service_name,
               CASE WHEN pattern IS NOT NULL THEN event_type END AS event_type,
               CASE WHEN event_type = 'http.request' THEN if(status >= 500, 'ERROR', 'INFO')
                    WHEN pattern IS NOT NULL THEN log_level END AS log_level,
               CASE WHEN pattern IS NOT NULL THEN us END AS us,
               CASE pattern WHEN 'deployment' THEN message || ' version=' || version
                    WHEN 'failed_login' THEN message WHEN 'service_line' THEN message
                    ELSE 'GET ' || path END AS message,
               status, CASE WHEN pattern IS NOT NULL THEN client_ip END AS client_ip, path, version,
               CASE WHEN event_type = 'http.request' THEN round(latency_ms, 2) END AS latency_ms
        FROM named""",
    "search_logs": P_LOGS + """
        SELECT event_id, us, event_type, message FROM msg
        WHERE service_name = 'api-gateway' AND log_level = 'ERROR'
          AND us >= epoch_us(TIMESTAMP '2024-01-05') AND us < epoch_us(TIMESTAMP '2024-01-20')
          AND lower(message) LIKE '%k=2%'""",
    "search_by_index": P_LOGS + """
        SELECT event_id, us, service_name, message FROM msg
        WHERE log_level = 'ERROR' AND lower(message) LIKE '%deployment.failed k=5%'""",
    "replayed_signals": P_EVSIG + """
        SELECT signal_id, signal_type, us FROM evsig
        WHERE us >= epoch_us(TIMESTAMP '2024-01-10') AND us < epoch_us(TIMESTAMP '2024-01-12')""",
    "signals_high_latency": P_EVSIG + """
        SELECT signal_id, severity, service, us, latency_ms FROM evsig
        WHERE signal_type = 'HIGH_LATENCY'""",
    "signals_deployment_failure": P_EVSIG + """
        SELECT signal_id, severity, service, us, version, reason FROM evsig
        WHERE signal_type = 'DEPLOYMENT_FAILURE'""",
    "signals_db_slow_query": P_EVSIG + """
        SELECT signal_id, severity, service, us, latency_ms FROM evsig
        WHERE signal_type = 'DB_SLOW_QUERY'""",
    "signals_all": P_SIG + """
        SELECT signal_id, signal_type, severity, service, event_id, rule_order, us FROM sig""",
    "signal_counts": P_EVSIG + """
        SELECT signal_type, severity, count(*) AS signals FROM evsig GROUP BY 1, 2""",
    "signals_bruteforce": _with(LOGS, BRUTE) + """
        SELECT event_id, service_name AS service, us, client_ip AS ip FROM brute""",
    "signals_error_spike": _with(LOGS, SPIKE) + """
        SELECT event_id, service_name AS service, us, 5::BIGINT AS error_count FROM spike""",
    "signals_error_spike_by_host": _with(
        LOGS, fired("byhost", "host", "event_type = 'http.request' AND status >= 500", 3, 6 * HOUR)
    ) + """
        SELECT event_id, service_name AS service, us FROM byhost""",
    "signals_per_event": P_SIG + """
        SELECT l.event_id, count(s.signal_id) AS n_signals,
               coalesce(string_agg(s.signal_type, ',' ORDER BY s.rule_order), '') AS signal_types
        FROM logs l LEFT JOIN sig s ON l.event_id = s.event_id GROUP BY 1""",
    "sliding_failure_count": P_LOGS + f"""
        SELECT client_ip, event_id, us, count(*) OVER (
          PARTITION BY client_ip ORDER BY us
          RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS in_window
        FROM logs WHERE event_type = 'auth.login_failed'""",
    "rules_as_of": _with(LOGS, RULE_ROWS) + """
        SELECT signal_id, rule_id, version, signal_type, severity, detected_at AS us FROM versioned""",
    "rules_as_of_windows": _with(LOGS, *RULE_WINDOWS) + """
        SELECT rule_id, version, signal_type, event_id, us FROM windowed""",
    "ids_of_texts": _with(LOGS) + """
        , parts AS (
          SELECT replace(message, ' ', '|') AS a, replace(path, '/', '\\') AS b FROM (
            SELECT *, event_type || ' k=' || k AS message FROM logs)
          UNION ALL SELECT NULL, message FROM (SELECT event_type || ' k=' || k AS message FROM logs)
          UNION ALL SELECT message, NULL FROM (SELECT event_type || ' k=' || k AS message FROM logs)
          UNION ALL SELECT event_type || '|', 'k' || k FROM logs
          UNION ALL SELECT event_type, '|k' || k FROM logs
          UNION ALL SELECT event_type || '\\', 'k' || k FROM logs
          UNION ALL SELECT event_type, '\\k' || k FROM logs)
        SELECT count(*) AS n_rows, count(DISTINCT (a, b)) AS n_ids FROM parts""",
    "correlated_groups": P_GROUPS + """
        SELECT group_id, window_start_us, n_signals, n_services, n_types, services,
               top_severity, confidence, cross_service FROM groups""",
    "correlated_traces": P_SIG + f"""
        , traced AS (
          SELECT s.*, 'trace-' || e.user_id AS trace_id, s.us - s.us % {DAY} AS day_us
          FROM sig s JOIN ev e ON s.event_id = e.event_id)
        SELECT md5('group|' || day_us || '|' || trace_id) AS group_id,
          day_us AS window_start_us, trace_id, count(*) AS n_signals,
          array_to_string(list_sort(list(DISTINCT service)), ',') AS services,
          round(least(1.0::DOUBLE, count(DISTINCT signal_type) / 5.0::DOUBLE)
                * least(1.0::DOUBLE, count(DISTINCT service) / 5.0::DOUBLE), 6) AS confidence
        FROM traced GROUP BY day_us, trace_id""",
    "correlation_links": P_GROUPS + """
        SELECT group_id, signal_id FROM linked""",
    "interval_links": P_SIG + "," + intervals("iv", "sig", 20 * 60_000_000, "") + """
        SELECT group_id, signal_id, us, group_start_us, n_links FROM iv""",
    "interval_groups": P_SIG + "," + intervals("iv", "sig", 20 * 60_000_000, "") + f"""
        SELECT group_id, {GROUP_ROW},
          CASE max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
            WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS top_severity
        FROM iv GROUP BY group_id""",
    "interval_traces": P_SIG + "," + TRACED + "," + intervals("iv", "traced", 7 * DAY, "trace_id") + f"""
        SELECT group_id, trace_id, {GROUP_ROW} FROM iv GROUP BY group_id, trace_id""",
    "signals_after_deployments": P_SIG + f"""
        SELECT a.signal_id AS deployment_id, b.signal_id, b.signal_type, b.us - a.us AS after_us
        FROM sig a JOIN sig b ON b.us BETWEEN a.us AND a.us + {2 * HOUR}
        WHERE a.signal_type = 'DEPLOYMENT_FAILURE' AND b.signal_type <> 'DEPLOYMENT_FAILURE'""",
    "error_rate_by_window": _with(LOGS, RATES) + """
        SELECT service_name, window_start_us, events, errors, error_rate FROM rates""",
    "zscore_anomalies": _with(LOGS, RATES) + """
        , past AS (
          SELECT *, round(avg(errors::DOUBLE) OVER w, 6) AS moving_avg,
                 round(stddev_pop(errors::DOUBLE) OVER w, 6) AS moving_std
          FROM rates WINDOW w AS (PARTITION BY service_name ORDER BY window_start_us
                                  ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
        scored AS (
          SELECT *, CASE WHEN moving_std > 0 THEN round((errors - moving_avg) / moving_std, 6)
                    END AS zscore FROM past),
        marked AS (
          SELECT *, coalesce(abs(zscore) > 2.0, FALSE) AS is_zscore,
            coalesce(errors > moving_avg * 3.0, FALSE) AS is_moving_avg,
            errors > 3 AS is_threshold FROM scored)
        SELECT service_name, window_start_us, errors, moving_avg, moving_std, zscore,
               is_zscore, is_moving_avg, is_threshold
        FROM marked WHERE is_zscore OR is_moving_avg OR is_threshold""",
    "zscore_anomalies_dense": _with(LOGS, RATES, dense_scores("errors")) + DENSE_FLAGGED,
    "silence_anomalies": _with(LOGS, RATES, dense_scores("events")) + """
        SELECT service_name, window_start_us, events, moving_avg, zscore
        FROM dense_marked WHERE is_zscore OR is_moving_avg""",
    "incident_sessions": P_GROUPS + """
        SELECT * FROM sessions""",
    "session_links": P_GROUPS + """
        SELECT incident_id, signal_id FROM sess""",
    "incident_severity_scored": P_GROUPS + f"""
        , scored AS (
          SELECT s.*, round(least(1.0::DOUBLE, s.occurrence_count / 4.0::DOUBLE) * 0.4::DOUBLE
            + (g.n_services / 5.0::DOUBLE) * 0.3::DOUBLE + g.confidence * 0.3::DOUBLE, 6) AS score
          FROM sessions s JOIN groups g
            ON s.created_us - s.created_us % {HOUR} = g.window_start_us)
        SELECT incident_id, service, error, occurrence_count, score,
          CASE WHEN score >= 0.75 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH'
               WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS scored_severity
        FROM scored""",
    "incidents": P_INC + """
        SELECT id, service, error, severity, status, created_us, signal_id, signal_severity
        FROM inc""",
    "incidents_by_signal_severity": P_INC + """
        SELECT lower(signal_severity) AS severity, error, count(*) AS incidents
        FROM inc GROUP BY 1, 2""",
    "incidents_from_payload": P_INC + """
        , placed AS (
          SELECT i.error, i.service, i.severity, i.status, s.event_id AS payload_id,
                 row_number() OVER (PARTITION BY s.event_id ORDER BY s.rule_order) - 1 AS place
          FROM inc i JOIN sig s ON i.signal_id = s.signal_id)
        SELECT md5('inc|' || md5(payload_id || '|' || place)) AS id, service, error, severity,
               status, payload_id, place FROM placed""",
    "incidents_latest_after_updates": P_UPD + """
        SELECT id, service, error, severity, status, changed_us FROM state""",
    "incidents_missing_updates": P_UPD + """
        SELECT id, status, changed_us FROM upd WHERE id NOT IN (SELECT id FROM inc)""",
    "incidents_found_by_id": P_UPD + """
        SELECT id, error FROM inc WHERE id IN (SELECT id FROM upd WHERE status = 'resolved')""",
    "incident_status_history": P_UPD + """
        SELECT id, arg_max(status, changed_us * 10 + seq) AS status, max(changed_us) AS changed_us
        FROM changes GROUP BY id""",
    "lifecycle_transitions": P_UPD + """
        SELECT id, previous, status, changed_us, seq::BIGINT AS seq,
          CASE WHEN previous IS NULL THEN 'opened' WHEN previous = status THEN 'unchanged'
               WHEN previous = 'resolved' THEN 'rejected'
               WHEN previous = 'escalated' AND status = 'in_progress' THEN 'rejected'
               ELSE 'valid' END AS verdict
        FROM steps""",
    "incidents_strict_state": P_UPD + """
        , nth AS (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY opens, changed_us, seq) AS rn
          FROM changes),
        held(id, rn, status) AS (
          SELECT id, rn, status FROM nth WHERE rn = 1
          UNION ALL
          SELECT n.id, n.rn, CASE WHEN h.status || '>' || n.status IN (
              'open>in_progress','open>escalated','open>resolved','in_progress>escalated',
              'in_progress>resolved','escalated>resolved') THEN n.status ELSE h.status END
          FROM held h JOIN nth n ON n.id = h.id AND n.rn = h.rn + 1)
        SELECT h.id, i.error, arg_max(h.status, h.rn) AS status
        FROM held h JOIN inc i ON i.id = h.id GROUP BY 1, 2""",
    "incidents_judged": P_UPD + JUDGED + """
        SELECT * FROM judged""",
    "incidents_overdue": P_UPD + JUDGED + """
        SELECT id, status, changed_us, 0::BIGINT AS seq FROM judged WHERE verdict = 'overdue'""",
    "lifecycle_notices": P_UPD + """
        SELECT id, previous, status, changed_us,
          CASE WHEN previous IS NULL THEN 'created' WHEN status IN ('resolved','escalated')
               THEN status ELSE 'updated' END AS notice
        FROM steps WHERE previous IS DISTINCT FROM status""",
    "incident_rollup": P_UPD + """
        SELECT severity, service, count(*) AS incidents, grouping(severity, service) AS level,
               count(*) FILTER (status <> 'resolved') AS active
        FROM state GROUP BY ROLLUP (severity, service)""",
    "incidents_active": P_UPD + """
        SELECT id, status FROM state WHERE status <> 'resolved'""",
    "incidents_historical": P_UPD + """
        SELECT id, status FROM state WHERE status = 'resolved'""",
    "incident_trend_daily": P_INC + """
        SELECT strftime(make_timestamp(created_us), '%Y-%m-%d') AS day, error,
               count(*) AS incidents FROM inc GROUP BY 1, 2""",
    "top_services": P_INC + """
        SELECT service, count(*) AS incidents FROM inc GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 3""",
    "responses": P_INC + """
        SELECT id AS incident_id,
          CASE WHEN error = 'DB_SLOW_QUERY' THEN 'restart_database' ELSE 'none' END AS action,
          CASE WHEN error = 'DB_SLOW_QUERY' THEN 'success' ELSE 'no_playbook' END AS status
        FROM inc""",
    "playbook_coverage": P_SIG + """
        , known(signal_type, action) AS (VALUES ('DB_SLOW_QUERY','restart_database'),
            ('HTTP_ERROR_RATE','restart_http_service'), ('AUTH_FAILURE_SPIKE','lock_accounts')),
        seen AS (SELECT signal_type, count(*) AS signals FROM sig GROUP BY 1)
        SELECT coalesce(s.signal_type, k.signal_type) AS signal_type,
               coalesce(s.signals, 0) AS signals, k.action,
          CASE WHEN k.action IS NULL THEN 'no_playbook' WHEN s.signals IS NULL
               THEN 'never_signalled' ELSE 'covered' END AS coverage
        FROM seen s FULL JOIN known k ON s.signal_type = k.signal_type""",
    "action_plan_steps": P_RESP + """
        SELECT * FROM actions""",
    "safety_gate": P_RESP + f"""
        , tried AS (
          SELECT incident_id, service, action, created_us AS us,
            count(*) OVER (PARTITION BY service, action ORDER BY created_us
              RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW) AS attempts,
            coalesce(created_us - lag(created_us) OVER (
              PARTITION BY service, action ORDER BY created_us, incident_id) < {2 * HOUR}, FALSE)
              AS in_cooldown
          FROM plan)
        SELECT *, CASE WHEN service = 'auth-service' THEN 'protected' WHEN attempts > 3
                       THEN 'retry_limit' WHEN in_cooldown THEN 'cooldown'
                       ELSE 'allowed' END AS decision
        FROM tried""",
    "safety_gate_after_allowed": P_RESP + f"""
        , tried AS (
          SELECT incident_id, service, action, created_us AS us,
            count(*) OVER (PARTITION BY service, action ORDER BY created_us
              RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW) AS attempts,
            row_number() OVER (PARTITION BY service, action, created_us ORDER BY incident_id) AS nth
          FROM plan),
        walk(service, action, us) AS (
          SELECT service, action, min(us) FROM tried GROUP BY 1, 2
          UNION ALL
          SELECT t.service, t.action, min(t.us) FROM walk w JOIN tried t
            ON t.service = w.service AND t.action = w.action AND t.us >= w.us + {2 * HOUR}
          GROUP BY 1, 2),
        marked AS (
          SELECT t.*, NOT (t.nth = 1 AND w.us IS NOT NULL) AS in_cooldown
          FROM tried t LEFT JOIN walk w
            ON t.service = w.service AND t.action = w.action AND t.us = w.us)
        SELECT incident_id, service, action, us, in_cooldown,
          CASE WHEN attempts > 3 THEN 'retry_limit' WHEN in_cooldown THEN 'cooldown'
               ELSE 'allowed' END AS decision
        FROM marked""",
    "responses_gated": P_RESP + f"""
        , tried AS (
          SELECT incident_id, service, action, error, created_us AS us,
            count(*) OVER (PARTITION BY service, action ORDER BY created_us
              RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW) AS attempts,
            coalesce(created_us - lag(created_us) OVER (
              PARTITION BY service, action ORDER BY created_us, incident_id) < {2 * HOUR}, FALSE)
              AS in_cooldown
          FROM plan)
        SELECT t.*, EXISTS (SELECT 1 FROM bad b WHERE t.error = b.error AND t.service = b.service
            AND t.action = b.action AND t.us > b.failed_us) AS suppressed,
          CASE WHEN service = 'auth-service' THEN 'protected' WHEN attempts > 3
               THEN 'retry_limit' WHEN in_cooldown THEN 'cooldown' ELSE 'allowed' END AS decision
        FROM tried t""",
    "approval_gate": P_RESP + """
        , decided AS (
          SELECT incident_id, action, arg_max(approved, decided_us) AS approved
          FROM approvals GROUP BY 1, 2)
        SELECT a.incident_id, a.command AS action, a.requires_approval,
          CASE WHEN NOT a.requires_approval THEN 'not_needed' WHEN d.approved THEN 'approved'
               WHEN d.approved IS NOT NULL THEN 'denied' ELSE 'awaiting_approval' END AS approval
        FROM actions a LEFT JOIN decided d
          ON a.incident_id = d.incident_id AND a.command = d.action""",
    "failure_suppression": P_RESP + """
        SELECT incident_id, error, service, action, 'success' AS status FROM plan p
        WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE p.error = b.error AND p.service = b.service
          AND p.action = b.action AND p.created_us > b.failed_us)""",
    "failure_suppressed": P_RESP + """
        SELECT p.error, p.service, p.action, b.failures, count(*) AS held_back
        FROM plan p JOIN bad b ON p.error = b.error AND p.service = b.service
          AND p.action = b.action AND p.created_us > b.failed_us GROUP BY 1, 2, 3, 4""",
    "playbook_best_match": P_RESP + """
        , cand(playbook_id, error, lo, hi, priority, action) AS (VALUES
            ('b-1','DB_SLOW_QUERY',1,4,1,'restart_database'),
            ('b-2','DB_SLOW_QUERY',2,2,1,'scale_database'),
            ('b-3','DEPLOYMENT_FAILURE',1,2,9,'notify'),
            ('b-4','DEPLOYMENT_FAILURE',3,4,2,'rollback_deployment'),
            ('b-5','DEPLOYMENT_FAILURE',2,4,2,'restart_http_service'),
            ('b-6','BRUTE_FORCE_LOGIN',3,3,1,'lock_accounts')),
        rate AS (
          SELECT error, action, round(avg(CASE WHEN status = 'success' THEN 1.0::DOUBLE
                                          ELSE 0.0::DOUBLE END), 6) AS success_rate
          FROM ran GROUP BY 1, 2),
        ranked AS (
          SELECT i.id, c.playbook_id, c.action, c.priority,
            coalesce(r.success_rate, 0.0::DOUBLE) AS success_rate,
            row_number() OVER (PARTITION BY i.id ORDER BY c.priority DESC,
              coalesce(r.success_rate, 0.0::DOUBLE) DESC, c.playbook_id) AS place
          FROM inc i JOIN cand c ON i.error = c.error
            AND CASE i.signal_severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END
                BETWEEN c.lo AND c.hi
          LEFT JOIN rate r ON r.error = c.error AND r.action = c.action)
        SELECT i.id AS incident_id, i.error, lower(i.signal_severity) AS severity,
               b.playbook_id, b.action, b.priority, b.success_rate
        FROM inc i LEFT JOIN ranked b ON i.id = b.id AND b.place = 1""",
    "playbook_choice_as_of": P_RESP + """
        , cand(playbook_id, error, lo, hi, priority, action) AS (VALUES
            ('b-1','DB_SLOW_QUERY',1,4,1,'restart_database'),
            ('b-2','DB_SLOW_QUERY',2,2,1,'scale_database'),
            ('b-3','DEPLOYMENT_FAILURE',1,2,9,'notify'),
            ('b-4','DEPLOYMENT_FAILURE',3,4,2,'rollback_deployment'),
            ('b-5','DEPLOYMENT_FAILURE',2,4,2,'restart_http_service'),
            ('b-6','BRUTE_FORCE_LOGIN',3,3,1,'lock_accounts')),
        past AS (
          SELECT error, status, created_us + 60000000 AS done_us,
            CASE WHEN (created_us // 60000000) % 2 = 0 THEN action
                 WHEN action = 'rollback_deployment' THEN 'restart_http_service'
                 WHEN action = 'restart_database' THEN 'scale_database' ELSE action END AS action
          FROM ran),
        pairs AS (
          SELECT i.id, c.*, i.created_us FROM inc i JOIN cand c ON i.error = c.error
            AND CASE i.signal_severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END
                BETWEEN c.lo AND c.hi),
        rated AS (
          SELECT p.id, p.playbook_id, p.action, p.priority, count(h.status) AS tried,
            round(coalesce(avg(CASE WHEN h.status = 'success' THEN 1.0::DOUBLE
                                    WHEN h.status IS NOT NULL THEN 0.0::DOUBLE END), 0.0::DOUBLE), 6) AS success_rate
          FROM pairs p LEFT JOIN past h
            ON h.error = p.error AND h.action = p.action AND h.done_us <= p.created_us
          GROUP BY ALL),
        best AS (
          SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY id
            ORDER BY priority DESC, success_rate DESC, playbook_id) = 1)
        SELECT i.id AS incident_id, i.error, lower(i.signal_severity) AS severity,
               b.playbook_id, b.action, b.priority, b.success_rate, b.tried
        FROM inc i LEFT JOIN best b ON i.id = b.id""",
    "escalations": P_RESP + """
        SELECT incident_id AS id, 'escalated' AS status, created_us + 60000000 AS changed_us
        FROM ran WHERE status = 'failed'""",
    "execution_results": P_RESP + """
        SELECT md5('exec|' || incident_id || '|' || action || '|' || (created_us + 60000000))
                 AS execution_id,
               created_us + 60000000 AS us, status,
               action || ' on ' || service || ' for ' || error AS message
        FROM ran""",
    "notifications_routed": P_INC + f"""
        SELECT id AS incident_id, service, lower(signal_severity) AS severity,
               error AS event_type, {INC_TIME} AS timestamp,
               CASE WHEN signal_severity IN ('HIGH','CRITICAL') THEN 'alert' ELSE 'log' END AS route
        FROM inc""",
    "notification_messages": P_INC + f"""
        , alerts AS (
          SELECT id, service, lower(signal_severity) AS severity, error, created_us FROM inc
          WHERE signal_severity IN ('HIGH','CRITICAL'))
        SELECT id AS incident_id, 'webhook' AS channel, 'planned' AS delivery_state,
          NULL::VARCHAR AS subject,
          chr(10) || chr(128680) || ' INCIDENT ALERT' || chr(10) || chr(10)
            || {ALERT_TEXT.format(label='Type', time=INC_TIME)} AS body
        FROM alerts
        UNION ALL
        SELECT id, 'email', 'planned', '[INCIDENT] ' || severity || ' - ' || service,
          chr(10) || 'Incident Alert' || chr(10) || chr(10)
            || {ALERT_TEXT.format(label='Event', time=INC_TIME)}
            || chr(10) || 'Message:' || chr(10) || chr(10)
        FROM alerts""",
    "notifications_rejected": P_LOGS + """
        SELECT event_id AS incident_id, 'event_type' AS missing FROM proc
        WHERE coalesce(reason, path) IS NULL""",
    "notifications_count": P_LOGS + """
        SELECT count(*) AS notifications_sent FROM proc
        WHERE coalesce(reason, path) IS NOT NULL""",
    "audit_trail": P_RESP + """
        , trail AS (
          SELECT id AS incident_id, created_us AS us, 'incidents' AS component_name,
                 'created' AS action_performed, lower(signal_severity) AS outcome FROM inc
          UNION ALL SELECT incident_id, created_us + 60000000, 'responses', action, status FROM ran
          UNION ALL SELECT incident_id, decided_us, 'approvals', action,
                 CASE WHEN approved THEN 'approved' ELSE 'denied' END FROM approvals
          UNION ALL SELECT id, changed_us, 'notifications',
                 CASE WHEN previous IS NULL THEN 'created' WHEN status IN ('resolved','escalated')
                      THEN status ELSE 'updated' END, status
          FROM steps WHERE previous IS DISTINCT FROM status)
        SELECT md5('audit|' || component_name || '|' || incident_id || '|' || us || '|'
                   || action_performed || '|' || outcome) AS audit_id,
               incident_id, us, component_name, action_performed, outcome
        FROM trail""",
    "detection_latency_quantiles": P_EVSIG + f"""
        , late AS (
          SELECT signal_type, (us - us % {HOUR} + {HOUR} - us) // 1000 AS latency_ms FROM evsig)
        SELECT signal_type, count(*) AS signals, round(max(latency_ms) / 1000::DOUBLE, 6) AS max_s,
               round(quantile_cont(latency_ms, 0.5) / 1000::DOUBLE, 6) AS p50,
               round(quantile_cont(latency_ms, 0.95) / 1000::DOUBLE, 6) AS p95,
               round(quantile_cont(latency_ms, 0.99) / 1000::DOUBLE, 6) AS p99
        FROM late GROUP BY 1""",
    "latency_sketch_quantiles": P_EVSIG + f"""
        , late AS (SELECT signal_type, {HOUR} - us % {HOUR} AS v FROM evsig),
        cut AS (SELECT signal_type, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS cell
                FROM late)
        SELECT signal_type, count(*) AS values, quantile_disc(cell, 0.5) AS p50,
               quantile_disc(cell, 0.95) AS p95, quantile_disc(cell, 0.99) AS p99
        FROM cut GROUP BY 1""",
    "log_throughput": P_LOGS + f"""
        SELECT us - us % {HOUR} AS window_start_us, count(*) AS events,
               count(DISTINCT service_name) AS services,
               round(count(*) / 3600.0::DOUBLE, 6) AS events_per_second
        FROM logs GROUP BY 1""",
}

ORACLES["audit_report"] = ORACLES["audit_trail"]

# Streams are run to their end, so they equal the batch queries.
ORACLES |= {
    "stream_processed_counts": ORACLES["severity_counts"],
    "stream_signals": P_EVSIG + """
        SELECT signal_id, signal_type, severity, service, us FROM evsig""",
    "stream_bruteforce": _with(LOGS, BRUTE) + f"""
        SELECT event_id, service_name AS service, us, client_ip AS ip FROM brute""",
    "stream_error_spike": _with(LOGS, SPIKE) + f"""
        SELECT event_id, service_name AS service, us FROM spike""",
    "stream_error_rates": _with(LOGS, RATES) + f"""
        SELECT service_name, window_start_us, events, errors FROM rates""",
    "stream_incident_sessions": _with(LOGS, EVENT_SIGNALS, GROUPS.replace("FROM sig", "FROM evsig")) + """
        SELECT * FROM sessions""",
    "stream_session_links": _with(LOGS, EVENT_SIGNALS, GROUPS.replace("FROM sig", "FROM evsig")) + """
        SELECT incident_id, signal_id FROM sess""",
    "stream_lifecycle": P_UPD + JUDGED + """
        SELECT * FROM judged
        UNION ALL SELECT id, NULL, status, changed_us, seq, 'unknown', NULL, NULL
        FROM upd WHERE id NOT IN (SELECT id FROM inc)""",
    "stream_zscore_anomalies": _with(LOGS, RATES, dense_scores("errors")) + DENSE_FLAGGED,
    "stream_latency_quantiles": ORACLES["latency_sketch_quantiles"],
    "stream_rule_changes": _with(LOGS, RULE_ROWS, *RULE_WINDOWS) + """
        SELECT rule_id, version, signal_type, severity, event_id, detected_at AS us FROM versioned
        UNION ALL SELECT rule_id, version, signal_type, 'HIGH', event_id, us FROM windowed""",
    "stream_stage_tables": _with(LOGS, LINES) + """
        , kept AS (
          SELECT *, CASE WHEN event_type = 'deployment.failed' THEN 'HIGH'
            WHEN event_type = 'http.request' AND latency_ms > 2000 THEN 'MEDIUM'
            WHEN event_type = 'db.query' AND latency_ms > 3000 THEN 'MEDIUM' END AS found
          FROM lines WHERE reason_out IS NULL)
        SELECT 'raw_logs' AS stage, count(*) AS n_rows FROM lines
        UNION ALL SELECT 'dead_letters', count(*) FROM lines WHERE reason_out IS NOT NULL
        UNION ALL SELECT 'processed_logs', count(*) FROM kept
        UNION ALL SELECT 'signals', count(found) FROM kept
        UNION ALL SELECT 'incidents', count(found) FROM kept
        UNION ALL SELECT 'responses', count(found) FROM kept
        UNION ALL SELECT 'notifications', 0""",
    "stream_incident_store": P_UPD + """
        SELECT id, service, error, severity, status, created_us, changed_us FROM state""",
    "stream_response_gates": ORACLES["responses_gated"],
    "stream_tailed_lines": _with(LOGS, LINES) + """
        SELECT event_id, normalized_type FROM lines WHERE reason_out IS NULL""",
}
