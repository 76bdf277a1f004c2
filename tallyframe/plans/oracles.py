"""DuckDB SQL that computes each registered query independently from the same tables.

The text patterns here are the plain ones of the fingerprint contract; the statements made from the
test tables are ASCII, where DuckDB's classes agree with them.
"""

from __future__ import annotations

AS_OF = "DATE '2024-03-31'"

_EVENTS = """
ev AS (
  SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 3 AS p FROM events
),
history AS (
  SELECT 's' || event_id AS statement_id,
         'u' || user_id AS executed_by,
         CASE WHEN user_id % 17 <> 0 THEN 'wh' || (user_id % 5) END AS warehouse_id,
         event_type AS statement_type,
         CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS execution_status,
         CASE WHEN k % 50 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS total_duration_ms,
         k * 1024 AS read_bytes,
         ts + to_days(CAST(p * 30 AS INTEGER)) AS start_time,
         ts + to_days(CAST(p * 30 AS INTEGER))
            + to_milliseconds(CASE WHEN k % 50 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) ELSE 0 END) AS end_time,
         CASE WHEN k <> 99 THEN
           CASE user_id % 3
             WHEN 0 THEN '/* abx v=1 ck=x rule=r' || (k % 10) || ' route='
                         || CASE WHEN k % 2 = 0 THEN 'warehouse' ELSE 'cache_miss' END || ' */ '
             WHEN 1 THEN '  /* bi dash */ '
             ELSE '' END
           || CASE WHEN user_id % 2 = 0 THEN 'SELECT' ELSE 'select' END
           || '  a, b FROM ' || event_type || '_t'
           || CASE WHEN p = 2 AND (k % 10 = 7 OR (k % 10 IN (2, 5) AND event_id % 7 <> 0)) THEN 'z' ELSE '' END
           || (k % 10) || ' WHERE id = ' || event_id || ' AND s = ''u' || user_id || ''' -- k' || k
         END AS statement_text
  FROM ev
)"""

_BILLING = """
billing AS (
  SELECT DATE '2024-01-01' + CAST(o_orderkey % 90 AS INTEGER) AS d,
         'SKU_' || substr(o_orderpriority, 1, 1) AS sku_name,
         CASE WHEN o_custkey % 13 <> 0 THEN 'wh' || (o_custkey % 6) END AS warehouse_id,
         -- thousandths, half up, from whole cents: a double would round some halves down
         CAST(((CAST(round(o_totalprice * 100) AS BIGINT) + 50) // 100) / 1000 AS DECIMAL(18, 6)) AS usage_quantity
  FROM orders
)"""

# The patterns of the fingerprint contract, in its order.
_NORMALIZE = (
    r"regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace("
    r"coalesce(statement_text, ''), '/\*.*?\*/', '', 'gs'), '--[^\n]*', '', 'g')), '\s+', ' ', 'g')),"
    r" '''(?:[^''\\]|\\.)*''', '?', 'g'), '\b\d+(?:\.\d+)?\b', '?', 'g')"
)

_CK = " || ".join(
    "substr('abcdefghijklmnopqrstuvwxyz234567', "
    f"1 + ((CAST('0x' || substr(h, {1 + 5 * (i // 4)}, 5) AS INTEGER) >> {15 - 5 * (i % 4)}) & 31), 1)"
    for i in range(16)
)

# Fixed value: the pattern of the tag. It is read as a list of key=value tokens, NULL if there is none or one is malformed.
_PRINTS = rf"""
hashed AS (
  SELECT *, sha256({_NORMALIZE}) AS h,
         list_filter(regexp_split_to_array(
           nullif(regexp_extract(ltrim(coalesce(statement_text, '')), '^/\*\s*abx\s+([^*]+)\*/', 1), ''), '\s+'),
           lambda t: t <> '') AS raw_tokens
  FROM history
),
read AS (
  SELECT *, {_CK} AS ck,
         CASE WHEN len(list_filter(raw_tokens, lambda t: NOT contains(t, '='))) = 0 THEN raw_tokens END AS tokens
  FROM hashed
),
prints AS (
  SELECT ck, statement_id, CAST(start_time AS DATE) AS d, start_time, warehouse_id, total_duration_ms,
         substr(list_filter(tokens, lambda t: starts_with(t, 'route='))[-1], 7) AS route,
         substr(list_filter(tokens, lambda t: starts_with(t, 'rule='))[-1], 6) AS rule_id
  FROM read WHERE execution_status = 'FINISHED'
)"""

# The log with tags of all kinds: bodies first, their fingerprints, then the tags in front of them.
_TAGGED = f"""
bodies AS (
  SELECT * REPLACE (statement_text || chr(10) || ' JOIN u' || (CAST(substr(statement_id, 2) AS BIGINT) // 40) || ' USING (a)'
    AS statement_text) FROM history
),
body_hashes AS (SELECT *, sha256({_NORMALIZE}) AS h FROM bodies),
body_prints AS (SELECT * EXCLUDE (h), {_CK} AS body_ck, CAST(substr(statement_id, 2) AS BIGINT) % 6 AS kind FROM body_hashes),
tagged AS (
  SELECT * EXCLUDE (body_ck, kind) REPLACE (CASE kind
    WHEN 0 THEN '/* abx v=1 ck=' || body_ck || ' rule=r1 route=warehouse */ '
    WHEN 1 THEN '/* abx v=1 ck=q4tz route=bypass rule=r2 */ '
    WHEN 2 THEN '/* abx v=1 route=smaller_wh */ '
    WHEN 3 THEN '/* abx v=2 ck=' || body_ck || ' route=cache_miss */ '
    WHEN 4 THEN '/* abx v=1 nightly ck=' || body_ck || ' */ '
    ELSE '-- nothing' || chr(10) END || statement_text AS statement_text) FROM body_prints
)"""

_H = "WITH " + _EVENTS
_TP = _H + "," + _TAGGED + "," + _PRINTS.replace("FROM history", "FROM tagged")
_P = _H + "," + _PRINTS
_B = "WITH " + _BILLING
_PB = _P + "," + _BILLING


def _attributed(name: str, lo: int, hi: int = -10_000) -> str:
    """Duration share statement by statement, for ages from ``lo`` down to ``hi`` days, as CTE ``name``."""
    days = f"d BETWEEN {AS_OF} - {lo} AND {AS_OF} - ({hi})"
    return f"""
{name} AS (
  WITH timed AS (
    SELECT ck, d, warehouse_id, total_duration_ms AS ms,
           sum(total_duration_ms) OVER (PARTITION BY d, warehouse_id) AS day_ms
    FROM prints WHERE {days}
  ),
  priced AS (
    SELECT d, warehouse_id, 0.70 * sum(CAST(usage_quantity AS DOUBLE)) AS day_usd
    FROM billing WHERE {days} GROUP BY d, warehouse_id
  )
  SELECT ck, count(*) AS execs, sum(CASE WHEN day_ms > 0 THEN ms / day_ms * day_usd END) AS attributed_usd
  FROM timed JOIN priced USING (d, warehouse_id)
  GROUP BY ck
)"""


def _effectiveness(name: str = "effect", back: int = 0, exact: bool = False) -> str:
    """The savings comparison as of ``back`` days earlier, as CTE ``name``."""

    def day(ago: int) -> str:
        return f"({AS_OF} - {ago + back})"

    expected = "n" if exact else "30 * CAST(n / 30.0 AS DECIMAL(27, 6))"
    return f"""{_attributed(name + "_cost", 30 + back)},
{name} AS (
  WITH before AS (
    SELECT ck, rule_id, count(*) AS n FROM prints WHERE d >= {day(60)} AND d < {day(30)} GROUP BY ck, rule_id
  ),
  after AS (
    SELECT ck, count(*) AS observed FROM prints WHERE d >= {day(30)} GROUP BY ck
  ),
  compared AS (
    SELECT *, greatest({expected} - observed, 0) AS gap FROM before JOIN after USING (ck)
  )
  SELECT ck, rule_id, strftime({day(30)}, '%Y-%m-%d') || '/' || strftime({day(0)}, '%Y-%m-%d') AS "window",
         CAST(n / 30.0 AS DECIMAL(27, 6)) AS baseline_rate, observed, CAST(trunc(gap) AS BIGINT) AS avoided,
         CASE WHEN attributed_usd IS NULL THEN 0 ELSE CAST(gap AS DOUBLE) * attributed_usd / execs END AS realized_usd
  FROM compared LEFT JOIN {name}_cost USING (ck)
)"""


_COVERAGE = f"""
cov AS (
  SELECT CAST(start_time AS DATE) AS d,
         count(*) FILTER (statement_text LIKE '/* abx %') AS gateway_routed,
         count(*) AS total,
         count(*) FILTER (statement_text LIKE '/* abx %') / count(*) AS coverage_ratio
  FROM history WHERE start_time >= {AS_OF} - 30 GROUP BY 1
),
trend AS (
  SELECT d, gateway_routed, total, round(coverage_ratio * 100, 1) AS coverage_pct FROM cov
)"""

_WATERFALL = f"""
waterfall AS (
  SELECT d, sku_name, warehouse_id, sum(CAST(usage_quantity AS DOUBLE)) AS dbus,
         sum(CAST(usage_quantity AS DOUBLE)) * 0.70 AS usd, 'raw' AS layer
  FROM billing WHERE d >= {AS_OF} - 30 AND warehouse_id IS NOT NULL GROUP BY d, sku_name, warehouse_id
)"""

# Largest remainder in whole units of a ten-thousandth USD: over days, then over the SKUs of a day.
_LAYERS = f"""
totals AS (
  SELECT 'projected_saving' AS layer, CAST(round(coalesce(sum(attributed_usd * (execs - 1) / execs), 0) / 0.0001) AS HUGEINT) AS total
  FROM effect_cost
  UNION ALL
  SELECT 'realized_saving', CAST(round(coalesce(sum(realized_usd), 0) / 0.0001) AS HUGEINT) FROM effect
),
usages AS (
  SELECT d, sku_name, CAST(sum(usage_quantity) * 1000000 AS HUGEINT) AS weight
  FROM billing WHERE d >= {AS_OF} - 30 AND warehouse_id IS NOT NULL GROUP BY d, sku_name
),
by_day AS (
  WITH quotas AS (
    SELECT layer, d, total, total * weight // sum(weight) OVER w AS base, total * weight % sum(weight) OVER w AS rest
    FROM (SELECT d, CAST(sum(weight) AS HUGEINT) AS weight FROM usages GROUP BY d), totals WINDOW w AS (PARTITION BY layer)
  )
  SELECT layer, d, CAST(base + CASE WHEN row_number() OVER (PARTITION BY layer ORDER BY rest DESC, d)
    <= total - sum(base) OVER (PARTITION BY layer) THEN 1 ELSE 0 END AS HUGEINT) AS total FROM quotas
),
by_sku AS (
  WITH quotas AS (
    SELECT layer, d, sku_name, total, total * weight // sum(weight) OVER w AS base, total * weight % sum(weight) OVER w AS rest
    FROM usages JOIN by_day USING (d) WINDOW w AS (PARTITION BY layer, d)
  )
  SELECT layer, d, sku_name, base + CASE WHEN row_number() OVER (PARTITION BY layer, d ORDER BY rest DESC, sku_name)
    <= total - sum(base) OVER (PARTITION BY layer, d) THEN 1 ELSE 0 END AS units FROM quotas
),
all_layers AS (
  SELECT d, sku_name, warehouse_id, usd, layer FROM waterfall
  UNION ALL SELECT d, sku_name, NULL, CAST(units AS DOUBLE) * 0.0001, layer FROM by_sku
)"""

_REDUNDANT = f"""
redundant AS (
  SELECT ck, count(*) AS execs, CAST(round(CAST(sum(total_duration_ms) AS DECIMAL(27, 0)) / 1000, 1) AS DOUBLE) AS total_sec,
         min(d) AS first_seen, max(d) AS last_seen, coalesce(max(rule_id), 'unmatched') AS rule_id
  FROM prints WHERE d >= {AS_OF} - 30 GROUP BY ck HAVING count(*) > 1
)"""

_RULES = """
rules AS (
  SELECT 'r' || (s_suppkey * 2) AS rule_id,
         CASE s_suppkey % 3 WHEN 0 THEN 'cache' WHEN 1 THEN 'bypass' ELSE 'smaller_wh' END AS rule_type,
         s_name AS description, '{"nation":' || s_nationkey || '}' AS config_json,
         TIMESTAMP '2024-03-01 00:00:00' AS pulled_at
  FROM supplier
)"""

_UPSERT = (
    "WITH "
    + _RULES
    + """,
incoming AS (
  SELECT 'r' || (c_custkey // 2 * 3) AS rule_id,
         CASE c_custkey % 3 WHEN 0 THEN 'cache' WHEN 1 THEN 'bypass' ELSE 'smaller_wh' END AS rule_type,
         c_name AS description, '{"nation":' || c_nationkey || '}' AS config_json,
         TIMESTAMP '2024-03-02 00:00:00' + to_seconds(c_custkey) AS pulled_at
  FROM customer
),
newest AS (
  SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY pulled_at DESC) = 1
)
SELECT * FROM newest
UNION ALL
SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.rule_id = r.rule_id)"""
)

_RULE_DOCUMENTS = """
WITH doc AS (
  SELECT 'r' || (s_suppkey * 2) AS rule_id,
         CASE s_suppkey % 3 WHEN 0 THEN 'cache' WHEN 1 THEN 'bypass' END AS rule_type,
         s_name AS description, s_nationkey AS nation
  FROM supplier
  UNION ALL
  SELECT 'r' || (s_suppkey * 2 + 1),
         CASE s_suppkey % 3 WHEN 0 THEN 'cache' WHEN 1 THEN 'bypass' ELSE 'smaller_wh' END,
         CASE WHEN s_suppkey % 2 = 0 THEN s_name END, s_nationkey
  FROM supplier
)
SELECT rule_id, coalesce(rule_type, '') AS rule_type, coalesce(description, '') AS description,
       '{"rule_id":"' || rule_id || '"' || coalesce(',"rule_type":"' || rule_type || '"', '')
         || coalesce(',"description":"' || description || '"', '') || ',"nation":' || nation || '}' AS config_json,
       TIMESTAMP '2024-03-01 00:00:00' AS pulled_at
FROM doc"""

_PRINT_COLUMNS = "ck, statement_id, d, start_time, warehouse_id, total_duration_ms, route, rule_id"
_ALL_PRINTS = _P + f" SELECT {_PRINT_COLUMNS} FROM prints"
_EFFECT_COLUMNS = 'ck, rule_id, "window", CAST(baseline_rate AS DOUBLE) AS baseline_rate'
_STATEMENT_COLUMNS = "statement_id, warehouse_id, total_duration_ms, start_time, statement_text"
_CUT = "TIMESTAMP '2024-03-01 00:00:00'"

_ROUTE_MIX = f""" SELECT d, count(*) FILTER (route = 'warehouse') AS warehouse,
           count(*) FILTER (route = 'cache_miss') AS cache_miss,
           count(*) FILTER (route = 'smaller_wh') AS smaller_wh,
           count(*) FILTER (route = 'bypass') AS bypass,
           count(*) FILTER (route IS NULL) AS untagged
           FROM prints WHERE d >= {AS_OF} - 30 GROUP BY d"""

_TAG_AUDIT = r""" SELECT CASE WHEN raw_tokens IS NULL THEN 'untagged'
                WHEN tokens IS NULL THEN 'void'
                WHEN substr(list_filter(tokens, lambda t: starts_with(t, 'v='))[-1], 3) IS DISTINCT FROM '1'
                  THEN 'other_version'
                WHEN len(list_filter(tokens, lambda t: starts_with(t, 'ck='))) = 0 THEN 'no_ck'
                WHEN substr(list_filter(tokens, lambda t: starts_with(t, 'ck='))[-1], 4) = ck THEN 'match'
                ELSE 'ck_mismatch' END AS outcome, count(*) AS statements
           FROM read GROUP BY 1"""

_FULL_WATERFALL = _PB + "," + _effectiveness() + "," + _WATERFALL + "," + _LAYERS

_FULLY_AVOIDED = (
    _PB
    + ","
    + _attributed("cost", 60, 31)
    + f""" SELECT b.ck, b.rule_id, '2024-03-01/2024-03-31' AS "window",
           CAST(CAST(b.n / 30.0 AS DECIMAL(27, 6)) AS DOUBLE) AS baseline_rate, b.n AS avoided,
           round(b.n * coalesce(c.attributed_usd / nullif(c.execs, 0), 0), 4) AS realized_usd
           FROM (SELECT ck, rule_id, count(*) AS n FROM prints
                 WHERE d BETWEEN {AS_OF} - 60 AND {AS_OF} - 31 GROUP BY ck, rule_id) b
           LEFT JOIN cost c USING (ck)
           WHERE b.ck NOT IN (SELECT ck FROM prints WHERE d >= {AS_OF} - 30)"""
)

ORACLES: dict[str, str] = {
    "history_view": _H + f" SELECT * FROM history WHERE start_time >= {AS_OF} - 90",
    "history_self_view": _H
    + f" SELECT * FROM history WHERE start_time >= {AS_OF} - 90 AND executed_by = 'u7'",
    "billing_window": _B
    + f""" SELECT d, sku_name, warehouse_id, CAST(usage_quantity AS DOUBLE) AS usage_quantity,
           CAST(d AS TIMESTAMP) AS usage_start_time, CAST(d + 1 AS TIMESTAMP) AS usage_end_time,
           'SQL' AS billing_origin_product
           FROM billing WHERE d >= {AS_OF} - 30 AND warehouse_id IS NOT NULL""",
    "view_sql": _H
    + ","
    + _BILLING
    + f""",
    seen AS (SELECT * FROM history WHERE start_time >= {AS_OF} - 90),
    h AS (SELECT warehouse_id, count(*) AS statements FROM seen GROUP BY 1),
    s AS (SELECT warehouse_id, count(*) AS own_statements FROM seen WHERE executed_by = 'u7' GROUP BY 1),
    b AS (SELECT warehouse_id, count(*) AS usage_records FROM billing
          WHERE d >= {AS_OF} - 30 AND warehouse_id IS NOT NULL GROUP BY 1)
    SELECT warehouse_id, statements, own_statements, usage_records
    FROM h LEFT JOIN s USING (warehouse_id) LEFT JOIN b USING (warehouse_id)""",
    "normalized_sql": _H + f" SELECT statement_id, {_NORMALIZE} AS normalized FROM history",
    "fingerprint": _P + " SELECT statement_id, ck FROM read",
    "fingerprint_versioned": _P + " SELECT statement_id, ck, 1 AS fp_version FROM read",
    "tag_fields": _P
    + """ SELECT statement_id,
           substr(list_filter(tokens, lambda t: starts_with(t, 'v='))[-1], 3) AS v,
           substr(list_filter(tokens, lambda t: starts_with(t, 'ck='))[-1], 4) AS ck,
           substr(list_filter(tokens, lambda t: starts_with(t, 'rule='))[-1], 6) AS rule_id,
           substr(list_filter(tokens, lambda t: starts_with(t, 'route='))[-1], 7) AS route,
           CAST(len(list_distinct(list_transform(tokens, lambda t: split_part(t, '=', 1)))) AS INTEGER) AS fields
           FROM read""",
    "gateway_routed_flag": _H
    + " SELECT statement_id, statement_text LIKE '/* abx %' AS routed FROM history",
    "has_tag_flag": _H
    + r""" SELECT statement_id,
           regexp_matches(ltrim(coalesce(statement_text, '')), '^/\*\s*abx\s+([^*]+)\*/') AS has_tag FROM history""",
    "lenient_numbers": """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS digit,
           TRY_CAST(o_orderpriority AS DOUBLE) AS label FROM orders""",
    "finished_statements": _H
    + f" SELECT {_STATEMENT_COLUMNS} FROM history WHERE execution_status = 'FINISHED'",
    "ingest_checkpoint": _H
    + f""" SELECT max(start_time) AS checkpoint FROM history
           WHERE execution_status = 'FINISHED' AND start_time < {_CUT}""",
    "incremental_since": _H
    + f""" SELECT {_STATEMENT_COLUMNS} FROM history
           WHERE execution_status = 'FINISHED' AND start_time >
             (SELECT max(start_time) FROM history WHERE execution_status = 'FINISHED' AND start_time < {_CUT})""",
    "ingest_batch": _ALL_PRINTS + f" WHERE start_time > {AS_OF} - 90",
    "ingest_whole_seconds": _P
    + f""" SELECT ck, statement_id, d, date_trunc('second', start_time) AS start_time FROM prints
           WHERE start_time > {AS_OF} - 90""",
    "ingest_idempotent": _ALL_PRINTS + f" WHERE start_time >= {_CUT}",
    "fingerprint_history_table": _ALL_PRINTS,
    "ingest_late_arrivals": _ALL_PRINTS,
    "stream_ingest": _ALL_PRINTS,
    "stream_coverage": _H
    + """ SELECT CAST(start_time AS DATE) AS d,
           count(*) FILTER (statement_text LIKE '/* abx %') AS gateway_routed, count(*) AS total,
           round(count(*) FILTER (statement_text LIKE '/* abx %') / count(*), 6) AS coverage_ratio
           FROM history GROUP BY 1""",
    "waterfall_daily": _B
    + ","
    + _WATERFALL
    + " SELECT d, sku_name, warehouse_id, round(dbus, 4) AS dbus, round(usd, 4) AS usd, layer FROM waterfall",
    "waterfall_table": _B
    + f""" SELECT d, sku_name, warehouse_id, round(sum(CAST(usage_quantity AS DOUBLE)), 4) AS dbus,
           round(sum(CAST(usage_quantity AS DOUBLE)) * 0.70, 4) AS usd, 'raw' AS layer
           FROM billing WHERE d >= {AS_OF} - 90 AND warehouse_id IS NOT NULL GROUP BY d, sku_name, warehouse_id""",
    "warehouse_cost": _B
    + f""" SELECT d, warehouse_id, round(sum(CAST(usage_quantity AS DOUBLE)) * 0.70, 4) AS wh_usd
           FROM billing WHERE d >= {AS_OF} - 30 AND warehouse_id IS NOT NULL GROUP BY d, warehouse_id""",
    "warehouse_duration": _P
    + f""" SELECT d, warehouse_id, CAST(sum(total_duration_ms) AS BIGINT) AS tot_ms
           FROM prints WHERE d >= {AS_OF} - 30 GROUP BY d, warehouse_id""",
    "attributed_cost": _PB
    + ","
    + _attributed("cost", 30)
    + " SELECT ck, execs, round(attributed_usd, 4) AS attributed_usd FROM cost",
    "attributed_cost_90": _PB
    + ","
    + _attributed("cost", 90)
    + " SELECT ck, execs, round(attributed_usd, 4) AS attributed_usd FROM cost",
    "coverage_daily": _H
    + ","
    + _COVERAGE
    + " SELECT d, gateway_routed, total, round(coverage_ratio, 6) AS coverage_ratio FROM cov",
    "coverage_trend": _H + "," + _COVERAGE + " SELECT * FROM trend ORDER BY d",
    "coverage_kpis": _H
    + ","
    + _COVERAGE
    + """ SELECT round(avg(coverage_pct), 6) AS avg_coverage_pct, round(100 - avg(coverage_pct), 6) AS untagged_pct,
           CAST(sum(total) AS BIGINT) AS total_statements, CAST(sum(gateway_routed) AS BIGINT) AS gateway_routed,
           100 - avg(coverage_pct) > 10 AS alert FROM trend""",
    "baseline_rate": _P
    + f""" SELECT ck, rule_id, CAST(CAST(count(*) / 30.0 AS DECIMAL(27, 6)) AS DOUBLE) AS baseline_rate
           FROM prints WHERE d BETWEEN {AS_OF} - 60 AND {AS_OF} - 31 GROUP BY ck, rule_id""",
    "observed_execs": _P
    + f" SELECT ck, count(*) AS observed FROM prints WHERE d >= {AS_OF} - 30 GROUP BY ck",
    "rule_effectiveness": _PB
    + ","
    + _effectiveness()
    + f" SELECT {_EFFECT_COLUMNS}, observed, avoided, round(realized_usd, 4) AS realized_usd FROM effect",
    "rule_effectiveness_exact": _PB
    + ","
    + _effectiveness(exact=True)
    + f" SELECT {_EFFECT_COLUMNS}, observed, avoided, round(realized_usd, 4) AS realized_usd FROM effect",
    "effectiveness_latest": _PB
    + ","
    + _effectiveness("newer")
    + ","
    + _effectiveness("older", back=1)
    + """, both_windows AS (SELECT * FROM newer UNION ALL SELECT * FROM older)
       SELECT rule_id, ck, "window", avoided, round(realized_usd, 4) AS realized_usd FROM both_windows
       WHERE "window" = (SELECT max("window") FROM both_windows)""",
    "fully_avoided": _FULLY_AVOIDED,
    "savings_layers": _PB
    + ","
    + _effectiveness()
    + ","
    + _WATERFALL
    + """ SELECT 'raw' AS layer, round(sum(usd), 4) AS usd FROM waterfall
          UNION ALL
          SELECT 'projected_saving', round(sum(attributed_usd * (execs - 1) / execs), 4) FROM effect_cost
          UNION ALL
          SELECT 'realized_saving', round(sum(realized_usd), 4) FROM effect""",
    "redundant_top50": _P + "," + _REDUNDANT + " SELECT * FROM redundant ORDER BY execs DESC, ck LIMIT 50",
    "redundancy_table": _P + "," + _REDUNDANT + " SELECT * FROM redundant",
    "redundant_count": _P
    + ","
    + _REDUNDANT
    + " SELECT count(*) AS redundant_fingerprints, least(count(*), 50) AS rows_shown FROM redundant",
    "redundant_top50_90": _P
    + ","
    + _REDUNDANT.replace("- 30", "- 90")
    + " SELECT * FROM redundant ORDER BY execs DESC, ck LIMIT 50",
    "spend_by_sku_90": _B
    + ","
    + _WATERFALL.replace("- 30", "- 90")
    + " SELECT d, sku_name, round(sum(usd), 4) AS usd, layer FROM waterfall GROUP BY d, sku_name, layer",
    "coverage_trend_7": _H + "," + _COVERAGE.replace("- 30", "- 7") + " SELECT * FROM trend ORDER BY d",
    "waterfall_withdrawn_day": _B
    + ","
    + _WATERFALL
    + f""" SELECT d, sku_name, warehouse_id, round(dbus, 4) AS dbus, round(usd, 4) AS usd, layer FROM waterfall
           WHERE d NOT BETWEEN {AS_OF} - 20 AND {AS_OF} - 11""",
    "sync_chain": _PB
    + ","
    + _effectiveness()
    + f""" SELECT 'push_pull' AS direction, 'ok' AS status, true AS size_agrees,
           (SELECT count(DISTINCT rule_id) FROM ({_RULE_DOCUMENTS})) AS rules,
           (SELECT count(*) FROM effect) AS exported""",
    "spend_by_sku": _FULL_WATERFALL
    + " SELECT d, sku_name, round(sum(usd), 4) AS usd, layer FROM all_layers GROUP BY d, sku_name, layer",
    "waterfall_layers": _FULL_WATERFALL + " SELECT d, layer, round(sum(usd), 4) AS usd FROM all_layers GROUP BY d, layer",
    "recompute_waterfall": _FULL_WATERFALL
    + " SELECT d, sku_name, warehouse_id, round(usd, 4) AS usd, layer FROM all_layers",
    "recompute_coverage": _H
    + ","
    + _COVERAGE
    + " SELECT d, gateway_routed, total, round(coverage_ratio, 6) AS coverage_ratio FROM cov",
    "recompute_effectiveness": _PB
    + ","
    + _effectiveness()
    + f" SELECT {_EFFECT_COLUMNS}, observed, avoided, round(realized_usd, 4) AS realized_usd FROM effect",
    "executions_rollup": _P
    + """ SELECT ck, rule_id, warehouse_id, count(*) AS n, CAST(sum(total_duration_ms) AS BIGINT) AS ms, d
           FROM prints GROUP BY ck, rule_id, warehouse_id, d""",
    "rollup_redundancy": _P + "," + _REDUNDANT + " SELECT * FROM redundant",
    "rollup_fully_avoided": _FULLY_AVOIDED,
    "ingest_arrivals": _ALL_PRINTS,
    "ingest_changed_days": _P
    + """ SELECT d, count(*) AS statements FROM prints
          WHERE d IN (DATE '2024-02-20', DATE '2024-03-29', DATE '2024-03-30') GROUP BY d""",
    "savings_kpis": _PB
    + ","
    + _effectiveness()
    + ","
    + _WATERFALL
    + """, t AS (SELECT (SELECT coalesce(sum(usd), 0) FROM waterfall) AS total,
                 (SELECT coalesce(sum(realized_usd), 0) FROM effect) AS saved)
       SELECT round(total, 4) AS total_usd, round(saved, 4) AS realized_usd,
              round(nullif(saved, 0) / nullif(total, 0) * 100, 4) AS savings_rate_pct FROM t""",
    "rule_attribution": _PB
    + ","
    + _effectiveness()
    + ","
    + _RULES
    + """ SELECT e.rule_id, r.description, e."window", CAST(e.baseline_rate AS DOUBLE) AS baseline_rate, e.observed,
           e.avoided, round(e.realized_usd, 2) AS realized_usd
           FROM effect e LEFT JOIN rules r ON e.rule_id = r.rule_id""",
    "route_mix": _P + _ROUTE_MIX,
    "route_mix_all": _TP + _ROUTE_MIX,
    "redundant_top50_growing": _TP + "," + _REDUNDANT + " SELECT * FROM redundant ORDER BY execs DESC, ck LIMIT 50",
    "redundant_count_growing": _TP
    + ","
    + _REDUNDANT
    + " SELECT count(*) AS redundant_fingerprints, least(count(*), 50) AS rows_shown FROM redundant",
    "rules_upsert": _UPSERT,
    "rules_table": _UPSERT,
    "rules_from_json": _RULE_DOCUMENTS,
    "rules_from_files": _RULE_DOCUMENTS,
    "rule_drift": f"""
      WITH pulled AS ({_RULE_DOCUMENTS}),
      fields AS (SELECT config_json AS j, unnest(json_keys(config_json)) AS field FROM pulled)
      SELECT field, CASE json_type(j, '$.' || field) WHEN 'VARCHAR' THEN 'STRING' ELSE 'BIGINT' END AS type, count(*) AS rules,
             field IN ('rule_id', 'rule_type', 'description') AS known
      FROM fields GROUP BY ALL""",
    "effectiveness_json": _PB
    + ","
    + _effectiveness()
    + """ SELECT '2024-03-31T00:00:00+00:00' AS reported_at, rule_id, ck, "window", avoided,
           round(realized_usd, 4) AS realized_usd FROM effect""",
    "tag_audit": _P + _TAG_AUDIT,
    "tag_audit_all": _TP + _TAG_AUDIT,
    "recompute_counts": _PB
    + ","
    + _effectiveness()
    + ","
    + _COVERAGE
    + ","
    + _WATERFALL
    + ","
    + _LAYERS
    + """ SELECT 'waterfall_daily' AS table_name, count(*) AS "rows" FROM all_layers
          UNION ALL SELECT 'coverage_daily', count(*) FROM cov
          UNION ALL SELECT 'rule_effectiveness', count(*) FROM effect""",
}
