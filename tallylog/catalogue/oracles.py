"""Expected results as SQL over the driver tables, derived from the columns without any log parsing."""

from __future__ import annotations

_EVENTS = """
WITH e AS (
  SELECT event_id, user_id, value, ts, event_type AS kind,
    strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS time,
    'svc-' || (user_id % 7) AS source,
    event_type || ' by user ' || user_id
      || CASE WHEN event_id % 10 = 3 THEN ' ' || repeat('x', 100) ELSE '' END AS message,
    regexp_extract(props, '-?[0-9]+') AS k,
    200 + 100 * (event_id % 4) AS status,
    CASE WHEN event_id % 5 <> 0 THEN '10.0.' || (user_id // 256) || '.' || (user_id % 256) END AS address,
    event_type = 'signup' AND value < 5 AS broken,
    CASE WHEN event_type = 'view' THEN 'DEBUG' WHEN event_type = 'purchase' THEN 'WARN'
      WHEN event_type = 'error' AND value >= 200 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'
      ELSE 'INFO' END AS level,
    CASE WHEN event_type = 'view' THEN 'dbg' WHEN event_type = 'purchase' THEN 'wrn' WHEN event_type = 'click' THEN 'info'
      WHEN event_type = 'signup' THEN 'Information' WHEN value >= 200 THEN 'crit' ELSE 'err' END AS loose_level,
    CASE WHEN event_type = 'view' THEN 'DEBUG' WHEN event_type = 'purchase' THEN 'WARNING'
      WHEN event_type = 'error' AND value >= 200 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
      ELSE 'INFO' END AS strict_level,
    CASE WHEN event_type = 'view' THEN 15 WHEN event_type = 'purchase' THEN 12
      WHEN event_type = 'error' AND value >= 200 THEN 10 WHEN event_type = 'error' THEN 11
      ELSE 14 END AS priority
  FROM events
),
j AS (SELECT * FROM e WHERE NOT broken),
t AS (
  SELECT event_id AS line, CASE WHEN event_id % 6 < 5 THEN time END AS time,
    CASE WHEN event_id % 6 < 4 THEN level END AS level,
    CASE WHEN event_id % 6 = 1 THEN source END AS source,
    CASE WHEN event_id % 6 < 5 THEN message ELSE time || ' ' || strict_level || ' ' || message END AS message
  FROM e
)
"""


def _events(select: str) -> str:
    return _EVENTS + select


def _cut(message: str) -> str:
    return f"CASE WHEN length({message}) > 100 THEN substr({message}, 1, 100) || '...' ELSE {message} END"


def _top(source: str, key: str, n: int) -> str:
    return (
        f"SELECT {key} AS value, count(*) AS count FROM {source} "
        f"GROUP BY 1 ORDER BY count DESC, value LIMIT {n}"
    )


_ERRORS = "(SELECT * FROM j WHERE level IN ('ERROR', 'FATAL'))"
_ADDRESSED = "(SELECT * FROM j WHERE address IS NOT NULL)"
_WHITE = " || ".join(
    f"chr({code})"
    for code in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def _stats(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS field, count(*) AS count, round(min({expr}), 2) AS min, round(max({expr}), 2) AS max, "
        f"round(sum({expr}), 2) AS sum, round(avg({expr}), 2) AS avg FROM {source}"
        for name, expr in columns.items()
    )


_JSON_NUMBERS = {
    "value": "value",
    "k": "CAST(k AS DOUBLE)",
    "user_id": "CAST(user_id AS DOUBLE)",
    "status": "CAST(status AS DOUBLE)",
}


def _report(facet: str, select: str) -> str:
    return f"SELECT '{facet}' AS facet, {select}"


_NO_RANK = "CAST(NULL AS BIGINT) AS rank"
_NO_FIGURES = "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS sum, CAST(NULL AS DOUBLE) AS avg"


def _full_report(chosen: str = "level <> 'DEBUG'", matched: str = "m") -> str:
    def ranked(facet: str, inner: str, n: int) -> str:
        return (
            f"SELECT '{facet}' AS facet, value AS key, rank, count AS n, {_NO_FIGURES} FROM (SELECT value, count, "
            f"row_number() OVER (ORDER BY count DESC, value) AS rank FROM ({inner})) WHERE rank <= {n}"
        )

    numbers = " UNION ALL ".join(
        f"SELECT 'number' AS facet, '{name}' AS key, {_NO_RANK}, count(*) AS n, round(min({expr}), 2) AS min, "
        f"round(max({expr}), 2) AS max, round(sum({expr}), 2) AS sum, round(avg({expr}), 2) AS avg FROM m"
        for name, expr in _JSON_NUMBERS.items()
    )
    parts = [
        _report("summary", f"'total_entries' AS key, {_NO_RANK}, count(*) AS n, {_NO_FIGURES} FROM e"),
        _report("summary", f"'matched_entries' AS key, {_NO_RANK}, count(*) AS n, {_NO_FIGURES} FROM {matched}"),
        _report("first_timestamp", f"min(time) AS key, {_NO_RANK}, CAST(NULL AS BIGINT) AS n, {_NO_FIGURES} FROM m"),
        _report("last_timestamp", f"max(time) AS key, {_NO_RANK}, CAST(NULL AS BIGINT) AS n, {_NO_FIGURES} FROM m"),
        _report("level", f"level AS key, {_NO_RANK}, count(*) AS n, {_NO_FIGURES} FROM m GROUP BY level"),
        _report("group:source", f"source AS key, {_NO_RANK}, count(*) AS n, {_NO_FIGURES} FROM m GROUP BY source"),
        ranked("ip", "SELECT address AS value, count(*) AS count FROM m WHERE address IS NOT NULL GROUP BY 1", 5),
        ranked(
            "error",
            f"SELECT {_cut('message')} AS value, count(*) AS count FROM m WHERE level IN ('ERROR', 'FATAL') GROUP BY 1",
            15,
        ),
        numbers,
    ]
    return _events(f", m AS (SELECT * FROM j WHERE {chosen}) " + " UNION ALL ".join(parts))


_SECTIONS = (
    "SELECT 'level' AS section, level AS key, count(*) AS n FROM j GROUP BY level "
    "UNION ALL SELECT 'group', source, count(*) FROM j GROUP BY source "
    f"UNION ALL SELECT 'ip', value, count FROM ({_top(_ADDRESSED, 'address', 5)}) "
    f"UNION ALL SELECT 'error', value, count FROM ({_top(_ERRORS, _cut('message'), 5)})"
)

ORACLES: dict[str, str] = {
    "parse_json_entries": _events(
        """
SELECT event_id AS line, time, level, source, message, CAST(value AS VARCHAR) AS value, k,
  CAST(user_id AS VARCHAR) AS user_id, CAST(status AS VARCHAR) AS status, address,
  CAST(4 + CASE WHEN address IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_fields, CAST(NULL AS VARCHAR) AS parse_error
FROM j
UNION ALL
SELECT event_id, NULL, NULL, NULL, 'BROKEN ' || event_id, NULL, NULL, NULL, NULL, NULL, 0, 'line is not a JSON object'
FROM e WHERE broken
"""
    ),
    "parse_text_entries": _events("SELECT line, time, level, source, message, CAST(NULL AS VARCHAR) AS parse_error FROM t"),
    "parse_csv_entries": _events(
        """
SELECT event_id AS line, time, level, source, kind || ', "by" user ' || user_id AS message,
  loose_level AS f_level, source AS f_source, CAST(value AS VARCHAR) AS f_value, k AS f_k,
  CAST(user_id AS VARCHAR) AS f_user_id, CAST(status AS VARCHAR) AS f_status, coalesce(address, '') AS f_ip,
  CAST(NULL AS VARCHAR) AS parse_error
FROM j
"""
    ),
    "parse_syslog_entries": _events(
        """
SELECT event_id AS line, time, level, source, message, CAST(priority AS VARCHAR) AS priority,
  CAST(priority >> 3 AS VARCHAR) AS facility, CAST(priority & 7 AS VARCHAR) AS severity, source AS hostname,
  'events' AS process, CAST(user_id AS VARCHAR) AS pid, CAST(NULL AS VARCHAR) AS parse_error
FROM e
"""
    ),
    "parse_warnings": _events(
        """
SELECT 'json' AS format, 'line is not a JSON object' AS parse_error, count(*) AS n FROM e WHERE broken
UNION ALL SELECT 'csv', 'wrong number of fields', count(*) FROM e WHERE broken
UNION ALL SELECT 'syslog', 'line has no syslog shape', count(*) FROM e
"""
    ),
    "detect_format": _events(
        """
, h AS (
  SELECT user_id, broken, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e
), f AS (
  SELECT user_id, count(*) AS n, count(*) FILTER (WHERE broken) AS bad FROM h WHERE i <= 10 GROUP BY user_id
)
SELECT user_id, CASE
    WHEN user_id % 4 = 0 AND n - bad > n // 2 THEN 'json'
    WHEN user_id % 4 = 2 AND bad IN (0, n) THEN 'csv'
    WHEN user_id % 4 = 3 THEN 'syslog'
    ELSE 'text' END AS format
FROM f
"""
    ),
    "detect_format_documents": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS v,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), h AS (
  SELECT doc_id, i, trim(v, {_WHITE}) AS t FROM l WHERE i <= 10 AND trim(v, {_WHITE}) <> ''
), f AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE starts_with(t, '{{')) AS objects,
    count(*) FILTER (WHERE regexp_matches(t, '^(<|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)')) AS syslogs,
    min(length(t) - length(replace(t, ',', ''))) AS fewest, max(length(t) - length(replace(t, ',', ''))) AS most,
    arg_min(t, i) AS first_line
  FROM h GROUP BY doc_id
)
SELECT doc_id, first_line, CASE
    WHEN objects > n // 2 THEN 'json'
    WHEN fewest >= 2 AND fewest = most AND NOT starts_with(first_line, '<') THEN 'csv'
    WHEN syslogs > n // 2 THEN 'syslog'
    ELSE 'text' END AS format
FROM f
""",
    "line_numbers": "SELECT CAST(count(*) AS BIGINT) AS lines, CAST(0 AS BIGINT) AS misnumbered FROM events",
    "level_normalize": _events("SELECT event_id, level FROM e"),
    "timestamp_layouts": _events("SELECT event_id, time FROM e"),
    "search_keyword": "SELECT doc_id AS line FROM documents WHERE contains(lower(text), 'the')",
    "search_keyword_fields": _events("SELECT event_id AS line, level FROM j WHERE level = 'FATAL'"),
    "filter_field_regex": _events(
        "SELECT event_id AS line, CAST(status AS VARCHAR) AS status FROM j WHERE status >= 400"
    ),
    "filter_field_column": _events("SELECT line, message FROM t WHERE level IS NULL"),
    "filter_level_exact": _events("SELECT event_id AS line, level, message FROM j WHERE level = 'ERROR'"),
    "filter_level_min": _events(
        "SELECT event_id AS line, level FROM j WHERE level IN ('WARN', 'ERROR', 'FATAL')"
    ),
    "filter_raw_regex": "SELECT doc_id AS line FROM documents WHERE regexp_matches(text, '[0-9]{3}-[0-9]{4}')",
    "filter_time_range": _events(
        """
SELECT event_id AS line, time FROM j
WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
"""
    ),
    "filter_chain": _events(
        """
SELECT event_id AS line, source, k FROM j
WHERE level = 'ERROR' AND user_id % 7 <= 4 AND regexp_matches(k, '^[1-9][0-9]$')
  AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00'
"""
    ),
    "matched_total": _events(
        """
SELECT count(*) AS total_entries, count(*) FILTER (WHERE level = 'ERROR' AND NOT broken) AS matched_entries,
  min(time) FILTER (WHERE level = 'ERROR' AND NOT broken) AS first_timestamp,
  max(time) FILTER (WHERE level = 'ERROR' AND NOT broken) AS last_timestamp
FROM e
"""
    ),
    "level_counts": _events("SELECT level, count(*) AS count FROM j GROUP BY level"),
    "group_by_source": _events("SELECT source AS value, count(*) AS count FROM j GROUP BY source"),
    "group_by_field": _events("SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM j GROUP BY user_id"),
    "group_counts_orders": "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1",
    "top_ips": _events(_top(_ADDRESSED, "address", 10)),
    "top_errors": _events(_top("(SELECT * FROM t WHERE level IN ('ERROR', 'FATAL'))", _cut("message"), 25)),
    "numeric_stats": _events(_stats("j", _JSON_NUMBERS)),
    "numeric_stats_lineitem": _stats(
        "lineitem",
        {name: f"CAST({name} AS DOUBLE)" for name in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")},
    ),
    "full_report": _full_report(),
    "head_limit": _events(
        "SELECT event_id AS line, message FROM j WHERE level = 'FATAL' ORDER BY event_id LIMIT 20"
    ),
    "tail_n": _events(
        """
SELECT source AS file, event_id AS line FROM (
  SELECT source, event_id, level, row_number() OVER (PARTITION BY source ORDER BY event_id DESC) AS back FROM e
) WHERE back <= 20 AND level = 'INFO'
"""
    ),
    "tail_large": _events(
        """
SELECT source AS file, event_id AS line FROM (
  SELECT source, event_id, row_number() OVER (PARTITION BY source ORDER BY event_id DESC) AS back FROM e
) WHERE back <= 1200
"""
    ),
    "head_files": _events(
        """
, placed AS (
  SELECT source AS service, message, level = 'WARN' AND NOT broken AS fits, row_number() OVER (PARTITION BY source ORDER BY event_id) AS line
  FROM e
), found AS (
  SELECT *, row_number() OVER (ORDER BY service, line) AS place FROM placed WHERE fits
)
SELECT n, service, line, message FROM found JOIN (SELECT unnest([20, 5000])::INT AS n) ON place <= n
"""
    ),
    "tail_files": _events(
        """
SELECT service, row_number() OVER (PARTITION BY service ORDER BY event_id DESC) AS back, level, message
FROM (SELECT *, source AS service FROM e) QUALIFY back <= 1200 AND level = 'INFO'
"""
    ),
    "file_order": _events(
        """
SELECT source AS service, row_number() OVER (PARTITION BY source ORDER BY event_id) AS place,
  '<' || priority || '>' || strftime(ts, '%b %-d %H:%M:%S') || ' ' || source || ' events[' || user_id || ']: ' || message AS raw
FROM e WHERE level = 'ERROR'
"""
    ),
    "follow_appended": _events(
        "SELECT time, level, source, message FROM j WHERE event_id % 3 <> 0 AND level = 'WARN' AND contains(message, 'purchase')"
    ),
    "export_json_roundtrip": _events(
        """
SELECT time AS timestamp, level, source, message, CAST(value AS VARCHAR) AS value,
  CAST(user_id AS VARCHAR) AS user_id, CAST(status AS VARCHAR) AS status
FROM j WHERE level = 'ERROR'
"""
    ),
    "export_csv_roundtrip": _events(
        """
SELECT time AS timestamp, level, source, message, CAST(value AS VARCHAR) AS value, CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_id % 3 = 0 THEN address END AS ip, CASE WHEN event_id % 3 = 1 THEN address END AS client_ip,
  CASE WHEN event_id % 3 = 2 THEN address END AS remote_addr
FROM j WHERE status >= 500
"""
    ),
    "export_raw_roundtrip": _events(
        """
SELECT '<' || priority || '>' || strftime(ts, '%b %-d %H:%M:%S') || ' ' || source || ' events[' || user_id || ']: '
  || message AS raw
FROM e WHERE level = 'ERROR' AND contains(message, 'by user 1')
"""
    ),
    "export_parquet_by_date": _events(
        "SELECT event_id AS line, level, substr(time, 1, 10) AS date FROM j WHERE substr(time, 1, 10) = '2024-01-15'"
    ),
    "listing": _events(
        """
SELECT event_id AS line, CASE WHEN broken THEN 'BROKEN ' || event_id
  ELSE substr(time, 1, 10) || ' ' || substr(time, 12, 8) || ' ' || rpad(level, 5, ' ') || ' [' || source || '] ' || message
  END AS listing
FROM e
"""
    ),
    "report_object": _events(
        "SELECT 'total' AS section, '' AS key, count(*) AS n FROM e UNION ALL "
        + _SECTIONS
        + " UNION ALL SELECT 'number', unnest(['value', 'k', 'user_id', 'status']), count(*) FROM j"
    ),
    "report_csv_sections": _events(_SECTIONS),
    "csv_multiline_files": _events(
        """
SELECT CASE WHEN NOT broken THEN time END AS time, CASE WHEN NOT broken THEN level END AS level,
  CASE WHEN NOT broken THEN source END AS source,
  CASE WHEN NOT broken THEN message || CASE WHEN event_id % 3 = 0 THEN chr(10) || 'and, "more"' ELSE '' END END AS message,
  CASE WHEN NOT broken THEN CAST(status AS VARCHAR) END AS status,
  CASE WHEN broken THEN 'wrong number of fields' END AS parse_error
FROM e
"""
    ),
    "export_csv_wide": _events(
        """
SELECT 'key-' || event_id AS key, row_number() OVER (ORDER BY 'key-' || event_id) AS place, event_id // 50 AS line, 'v, ' || event_id AS value
FROM e
"""
    ),
    "analyze_files": _events(
        """
SELECT 'json' AS folder, count(*) AS n, count(*) AS numbered, min(time) AS first_time FROM j WHERE level = 'FATAL'
UNION ALL SELECT unnest(['csv', 'quoted']), count(*), count(*), min(time) FROM j WHERE level = 'FATAL'
UNION ALL SELECT 'syslog', count(*), count(*), min(time) FROM e WHERE level = 'FATAL'
UNION ALL SELECT 'text', count(*), count(*), min(time) FROM t WHERE level = 'FATAL'
"""
    ),
    "stream_report": _events(
        f"""
SELECT 'summary' AS facet, unnest(['total_entries', 'matched_entries']) AS key, count(*) AS n,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max FROM e
UNION ALL SELECT 'first_timestamp', min(time), NULL, NULL, NULL FROM j
UNION ALL SELECT 'last_timestamp', max(time), NULL, NULL, NULL FROM j
UNION ALL SELECT 'level', level, count(*), NULL, NULL FROM j GROUP BY level
UNION ALL SELECT 'group:source', source, count(*), NULL, NULL FROM j GROUP BY source
UNION ALL SELECT 'ip', address, count(*), NULL, NULL FROM {_ADDRESSED} GROUP BY address
UNION ALL SELECT 'error', {_cut('message')}, count(*), NULL, NULL FROM {_ERRORS} GROUP BY 2
UNION ALL SELECT 'number', 'value', count(*), min(value), max(value) FROM j
UNION ALL SELECT 'number', 'k', count(*), min(CAST(k AS DOUBLE)), max(CAST(k AS DOUBLE)) FROM j
UNION ALL SELECT 'number', 'user_id', count(*), min(user_id), max(user_id) FROM j
UNION ALL SELECT 'number', 'status', count(*), min(status), max(status) FROM j
"""
    ),
    "stream_top": _full_report("TRUE", "e"),
    "report_wide": """
WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS number, 'customer ' || o_custkey AS message, CAST(o_totalprice AS DOUBLE) AS price,
  CASE o_orderstatus WHEN 'F' THEN 'ERROR' WHEN 'O' THEN 'INFO' ELSE 'WARN' END AS level FROM orders)
SELECT 'summary' AS facet, unnest(['total_entries', 'matched_entries']) AS key, CAST(NULL AS BIGINT) AS rank, count(*) AS n,
  CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max FROM o
UNION ALL SELECT 'level', level, NULL, count(*), NULL, NULL FROM o GROUP BY level
UNION ALL SELECT 'group:number', number, NULL, count(*), NULL, NULL FROM o GROUP BY number
UNION ALL SELECT 'number', 'number', NULL, count(*), min(CAST(number AS DOUBLE)), max(CAST(number AS DOUBLE)) FROM o
UNION ALL SELECT 'number', 'price', NULL, count(*), round(min(price), 2), round(max(price), 2) FROM o
UNION ALL (SELECT 'error', message, row_number() OVER (ORDER BY count(*) DESC, message) AS place, count(*), NULL, NULL
  FROM o WHERE level = 'ERROR' GROUP BY message QUALIFY place <= 150)
""",
    "detect_hard_files": _events(
        """
SELECT 'my json' AS folder, count(*) AS n, count(*) FILTER (NOT broken) AS with_level FROM e
UNION ALL SELECT 'text[1]', count(*), count(level) FROM t
UNION ALL SELECT 'sys%20{log}#', count(*), count(level) FROM e
UNION ALL SELECT 'late', count(*), count(level) FROM t
"""
    ),
    "export_counts": _events(
        """
SELECT format, "case", CASE "case" WHEN 'none' THEN 0 WHEN 'limit' THEN least(5, matched) ELSE matched END AS exported,
  total, warnings
FROM (VALUES ('json'), ('csv'), ('raw')) AS f(format)
CROSS JOIN (VALUES ('plain'), ('ordered'), ('limit'), ('none')) AS c("case")
CROSS JOIN (SELECT count(*) AS total, count(*) FILTER (broken) AS warnings,
  count(*) FILTER (level = 'ERROR' AND NOT broken) AS matched FROM e)
"""
    ),
    "export_text_csv": _events(
        "SELECT time AS timestamp, level, source, message, row_number() OVER (PARTITION BY regexp_extract(message, 'by user ([0-9]+)', 1) ORDER BY line) AS place"
        " FROM t WHERE level = 'FATAL'"
    ),
    "report_all_errors": _events(
        f"""
SELECT row_number() OVER (ORDER BY n DESC, error) - 1 AS place, error, n
FROM (SELECT {_cut('message')} AS error, count(*) AS n FROM {_ERRORS} GROUP BY 1)
"""
    ),
    "epoch_timestamps": """
SELECT event_id AS line, CASE event_id % 4
  WHEN 2 THEN regexp_replace(strftime(make_timestamp(CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000000), '%Y-%m-%dT%H:%M:%SZ'), '^([0-9]{5,})', '+\\1')
  WHEN 3 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS time
FROM events
""",
    "stats_files": _events(
        """
SELECT 'summary' AS facet, 'total_entries' AS key, count(*) AS n, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max FROM e
UNION ALL SELECT 'summary', 'matched_entries', count(*), NULL, NULL FROM e WHERE kind = 'purchase'
UNION ALL SELECT 'first_timestamp', min(time), NULL, NULL, NULL FROM e WHERE kind = 'purchase'
UNION ALL SELECT 'last_timestamp', max(time), NULL, NULL, NULL FROM e WHERE kind = 'purchase'
UNION ALL SELECT 'level', level, count(*), NULL, NULL FROM e WHERE kind = 'purchase' GROUP BY level
UNION ALL SELECT 'number', 'priority', count(*), min(priority), max(priority) FROM e WHERE kind = 'purchase'
UNION ALL SELECT 'number', 'severity', count(*), min(priority % 8), max(priority % 8) FROM e WHERE kind = 'purchase'
UNION ALL SELECT 'number', 'facility', count(*), min(priority // 8), max(priority // 8) FROM e WHERE kind = 'purchase'
UNION ALL SELECT 'number', 'pid', count(*), min(user_id), max(user_id) FROM e WHERE kind = 'purchase'
"""
    ),
    "follow_filtered": _events("SELECT time, level, source, message FROM j WHERE kind = 'signup'"),
    "stream_level_counts": _events("SELECT level, count(*) AS count FROM e GROUP BY level"),
}
