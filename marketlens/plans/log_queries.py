"""Query-log analytics as queries."""

from marketlens.operators import querylog
from marketlens.plans.registry import query


@query("h1_recent_queries", "SELECT * FROM {history} ORDER BY ts DESC, id DESC LIMIT 20")
def _(t):
    return querylog.recent_queries(t.history)


@query("h2_recent_errors", "SELECT * FROM {history} WHERE status = 'error' ORDER BY ts DESC, id DESC LIMIT 10")
def _(t):
    return querylog.recent_errors(t.history)


@query("h3_slowest", "SELECT * FROM {history} ORDER BY execution_time DESC, id LIMIT 10")
def _(t):
    return querylog.slowest(t.history)


@query(
    "h4_log_stats",
    """SELECT total, successful, total - successful AS errors, CAST(successful AS DOUBLE) / total * 100 AS success_pct,
 CAST(total - successful AS DOUBLE) / total * 100 AS error_pct, avg_time, min_time, max_time
FROM (SELECT COUNT(*) AS total, COUNT(*) FILTER (status = 'success') AS successful,
 CAST(SUM(CAST(ROUND(execution_time * 1000000) AS BIGINT)) AS DOUBLE) / COUNT(execution_time) / 1000000 AS avg_time,
 MIN(execution_time) AS min_time, MAX(execution_time) AS max_time FROM {history}) x""",
)
def _(t):
    return querylog.log_stats(t.history)


@query("h5_queries_on", "SELECT * FROM {history} WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def _(t):
    return querylog.queries_on(t.history, "2024-01-15 13:30:00")


@query("h6_search_log", "SELECT * FROM {history} WHERE contains(lower(query), 'purchase from user_1') ORDER BY ts DESC, id DESC LIMIT 10")
def _(t):
    return querylog.search_log(t.history, "PURCHASE from USER_1")


@query("h7_retain_log", "SELECT * FROM {history} ORDER BY ts DESC, id DESC LIMIT 100")
def _(t):
    return querylog.retain_log(t.history)


@query(
    "h8_latency_grades",
    """SELECT CASE WHEN execution_time < 0.1 THEN 'excellent' WHEN execution_time < 0.5 THEN 'good' WHEN execution_time < 1.0 THEN 'acceptable'
 ELSE 'slow' END AS grade, COUNT(*) AS queries FROM {history} GROUP BY 1""",
)
def _(t):
    return querylog.latency_grades(t.history)
