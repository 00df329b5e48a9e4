"""For each query the SQL that gives the same result on the same tables, written on its own terms for DuckDB."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

BASE = """
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
"""

MKT = BASE + """,
mkt0 AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'session_started' WHEN 'purchase' THEN 'session_completed'
    WHEN 'error' THEN 'ib_call_logged' WHEN 'signup' THEN 'customer_health_update'
    ELSE CASE WHEN k % 2 = 0 THEN 'tutor_availability_updated' ELSE 'supply_demand_update' END END AS kind FROM ev),
mkt AS (
  SELECT event_id, ts, kind AS event_type, user_id AS student_id, CAST(k % 20 AS BIGINT) AS tutor_id,
    'subject-' || (k % 9) AS subject, 'region-' || (event_id % 4) AS region,
    CASE WHEN kind = 'session_completed' THEN CAST(event_id % 6 AS INTEGER) END AS rating,
    CASE WHEN kind = 'session_completed' THEN 20 + k END AS duration_min,
    CASE WHEN kind = 'session_completed' THEN k % 10 = 0 END AS was_cancelled,
    CASE WHEN kind = 'session_completed' THEN k % 15 = 1 END AS no_show,
    CASE WHEN kind = 'ib_call_logged' THEN (k - 50) / 50.0::DOUBLE END AS sentiment,
    CASE WHEN kind = 'customer_health_update' THEN 100.0::DOUBLE - least(100.0::DOUBLE, value) END AS health_score,
    CASE WHEN kind = 'customer_health_update' AND k % 3 = 0 THEN CAST(k % 8 AS BIGINT) END AS sessions_last_7_days,
    CASE WHEN kind = 'customer_health_update' AND k % 4 = 0 THEN CAST(k % 30 AS BIGINT) END AS sessions_last_30_days,
    CASE WHEN kind = 'customer_health_update' AND k % 5 = 0 THEN CAST(k % 6 AS BIGINT) END AS ib_calls_last_14_days,
    CASE WHEN kind = 'supply_demand_update' THEN CAST(50 + k AS DOUBLE) END AS demand_score,
    CASE WHEN kind = 'supply_demand_update' THEN CAST(50 + event_id % 50 AS DOUBLE) END AS supply_score,
    CASE WHEN kind = 'supply_demand_update' THEN CASE
      WHEN CAST(50 + k AS DOUBLE) / (50 + event_id % 50) > 1.5::DOUBLE THEN 'high_demand'
      WHEN CAST(50 + event_id % 50 AS DOUBLE) / (50 + k) > 1.5::DOUBLE THEN 'high_supply' ELSE 'balanced' END END AS balance_status,
    CASE WHEN kind = 'supply_demand_update' THEN event_id % 20 END AS available_tutors,
    CASE WHEN kind = 'supply_demand_update' THEN user_id % 40 END AS active_students,
    CASE WHEN kind = 'supply_demand_update' THEN CAST(k % 12 AS BIGINT) END AS pending_requests,
    CASE WHEN kind = 'tutor_availability_updated' THEN CAST(k % 40 AS BIGINT) END AS available_slots_this_week,
    value, k, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 86400000000 AS age
  FROM mkt0)
"""

ACT = BASE + """,
act0 AS (SELECT *, CASE event_type WHEN 'view' THEN 'login' WHEN 'click' THEN 'message' WHEN 'purchase' THEN 'payment'
    WHEN 'error' THEN 'ib_call' ELSE 'session' END AS activity FROM ev),
act AS (
  SELECT event_id, ts, user_id AS customer_id, activity,
    CASE WHEN activity = 'session' THEN CASE WHEN k % 10 = 0 THEN 'cancelled' WHEN k % 15 = 1 THEN 'no_show' ELSE 'completed' END END AS status,
    CASE WHEN activity = 'session' THEN CAST(20 + k AS DOUBLE) END AS duration_min,
    CASE WHEN activity = 'session' AND k % 10 <> 0 AND k % 15 <> 1 THEN CAST(event_id % 6 AS DOUBLE) END AS rating,
    CASE WHEN activity = 'ib_call' THEN CAST(k * 10 AS DOUBLE) END AS call_seconds,
    CASE WHEN activity = 'ib_call' THEN k >= 80 END AS escalated,
    CASE WHEN activity = 'payment' THEN value END AS amount,
    CASE WHEN activity = 'payment' THEN k % 10 <> 0 END AS paid,
    (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 86400000000 AS age
  FROM act0)
"""

INS = BASE + """,
ins AS (
  SELECT event_id AS entity_id, ts AS "timestamp", CASE WHEN k % 19 <> 0 THEN user_id END AS related_entity,
    CASE WHEN k % 11 <> 0 THEN CASE event_type WHEN 'view' THEN 'customer_health' WHEN 'purchase' THEN 'session_quality'
      WHEN 'error' THEN 'churn_risk' WHEN 'signup' THEN 'first_session_success' ELSE 'tutor_capacity' END END AS prediction_type,
    CASE WHEN k % 17 <> 0 THEN CAST(least(100, floor(value)) AS INTEGER) END AS risk_score,
    CASE WHEN k % 7 <> 0 THEN 'value ' || k END AS explanation,
    CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 3 = 0 THEN 'rules' ELSE 'health-v1' END END AS model_used,
    0.5::DOUBLE + k / 200.0::DOUBLE AS confidence,
    CAST(floor(epoch(ts)) AS BIGINT) + 30 * 86400 AS ttl
  FROM ev),
served AS (
  SELECT entity_id AS alert_id, coalesce(related_entity, entity_id) AS entity_id, "timestamp",
    coalesce(prediction_type, 'unknown') AS prediction_type, coalesce(risk_score, 0) AS risk_score,
    coalesce(explanation, '') AS explanation, coalesce(model_used, 'unknown') AS model_used, round(confidence, 6) AS confidence
  FROM ins)
"""

TEL = BASE + """,
tel AS (
  SELECT event_id AS insight_id, user_id AS device_id, ts, value, value * 1000 AS iops, value * 600 AS read_iops,
    value * 400 AS write_iops, value / 5 AS latency, value / 5 * 1.5::DOUBLE AS p95_latency,
    value / 5 * (1.2::DOUBLE + (k % 10) / 8.0::DOUBLE) AS p99_latency, k / 25.0::DOUBLE AS error_rate, k AS queue_depth,
    value * 20 AS throughput, k % 2 = 0 AS sequential, CAST(4 + k AS DOUBLE) AS io_size_kb,
    CASE WHEN event_id % 5 <> 0 THEN CASE WHEN value >= 150 THEN 'critical' WHEN value >= 80 THEN 'high'
      WHEN value >= 30 THEN 'medium' ELSE 'low' END END AS risk_level,
    CASE WHEN event_id % 5 <> 0 THEN 100.0::DOUBLE - least(100.0::DOUBLE, value) END AS performance_score
  FROM ev)
"""

STR = BASE + """,
str AS (
  SELECT event_id AS metric_id, user_id AS stream_id, ts, value / 5 AS latency_p99, CAST(k AS DOUBLE) AS utilization,
    (k % 13) / 200.0::DOUBLE AS error_rate, 50.0::DOUBLE + value AS bandwidth_gbps, event_id % 150 AS qp_errors
  FROM ev),
base AS (SELECT stream_id, median(latency_p99) AS lat_b, median(utilization) AS util_b, median(error_rate) AS err_b,
    median(bandwidth_gbps) AS bw_b FROM str GROUP BY stream_id),
delta AS (
  SELECT str.*, lat_b, util_b, err_b, bw_b,
    CASE WHEN lat_b <> 0 THEN (latency_p99 - lat_b) / lat_b * 100 END AS lat_pct, utilization - util_b AS util_d,
    CASE WHEN bw_b <> 0 THEN (bandwidth_gbps - bw_b) / bw_b * 100 END AS bw_pct, latency_p99 - lat_b AS lat_abs
  FROM str JOIN base USING (stream_id))
"""

LABEL = STR + """,
rise AS (SELECT *, lat_pct / 100 AS r, bandwidth_gbps / bw_b AS share,
    (latency_p99 - lat_b) / lat_b AS rx FROM delta),
lab0 AS (
  SELECT *, CASE
    WHEN utilization > 90 THEN 1 WHEN qp_errors > 100 THEN 2
    WHEN error_rate > 0.05::DOUBLE AND latency_p99 > lat_b * 4 THEN 3 WHEN rx > 0.5::DOUBLE THEN 4
    WHEN error_rate > 0.02::DOUBLE THEN 5 WHEN rx > 0.3::DOUBLE AND rx <= 0.5::DOUBLE THEN 6
    WHEN share < 0.7::DOUBLE THEN 7 WHEN error_rate > 0.01::DOUBLE AND error_rate <= 0.02::DOUBLE THEN 8
    WHEN utilization > 80 OR rx > 0.2::DOUBLE OR error_rate > 0.005::DOUBLE THEN 9 ELSE 0 END AS rule FROM rise),
lab AS (
  SELECT *, ['resource_saturation', 'qp_error_rate_high', 'rdma_timeout', 'performance_degradation', 'packet_loss_detected',
      'latency_spike', 'bandwidth_throttling', 'connection_instability', 'anomaly_detected'][nullif(rule, 0)] AS prediction_type,
    CAST(trunc(CASE rule WHEN 0 THEN 0 WHEN 1 THEN least(100, 70 + (utilization - 90) * 3) WHEN 2 THEN least(100, 60 + qp_errors / 10.0::DOUBLE)
      WHEN 3 THEN 95 WHEN 4 THEN least(100, 60 + rx * 60) WHEN 5 THEN least(100, 50 + error_rate * 1000) WHEN 6 THEN 70
      WHEN 7 THEN 60 + (1 - share) * 50 WHEN 8 THEN 65 ELSE 55 END) AS INTEGER) AS risk_score,
    ([0.0, 0.95, 0.90, 0.92, 0.85, 0.88, 0.80, 0.75, 0.82, 0.65]::DOUBLE[])[rule + 1] AS label_confidence
  FROM lab0)
"""

RAW = MKT + """,
raw0 AS (
  SELECT *, event_id % 37 AS d, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') || 'Z' AS stamp,
    '{' || concat_ws(',', '"' || CASE WHEN event_id % 4 = 0 THEN 'customer_id' ELSE 'student_id' END || '":' || student_id,
      '"tutor_id":' || tutor_id, '"subject":"' || subject || '"',
      '"' || CASE event_id % 3 WHEN 0 THEN 'tutor_rating' WHEN 1 THEN 'rating' ELSE 'student_rating' END || '":' || rating,
      '"' || CASE event_id % 2 WHEN 0 THEN 'duration_minutes' ELSE 'actual_duration_minutes' END || '":' || duration_min,
      '"was_cancelled":' || was_cancelled, '"no_show":' || no_show,
      '"available_slots_this_week":' || available_slots_this_week) || '}' AS pl
  FROM mkt),
raw AS (
  SELECT *, CASE WHEN d = 0 THEN '{bad' ELSE '{' || concat_ws(',',
      CASE d WHEN 1 THEN NULL WHEN 2 THEN '"event_type":"bogus"' WHEN 11 THEN '"event_type":""' ELSE '"event_type":"' || event_type || '"' END,
      CASE d WHEN 3 THEN '"timestamp":"nope"' WHEN 12 THEN NULL ELSE '"timestamp":"' || stamp || '"' END,
      CASE d WHEN 4 THEN NULL WHEN 5 THEN '"payload":[]' WHEN 13 THEN '"payload":7' ELSE '"payload":' || pl END,
      CASE d WHEN 6 THEN '"metrics":{"iops":-1}' WHEN 7 THEN '"metrics":{"iops":null}' WHEN 8 THEN '"metrics":{"errorRate":100.5}'
        WHEN 9 THEN '"metrics":"high"' WHEN 10 THEN '"metrics":{"latency":"slow","iops":12}'
        WHEN 14 THEN '"metrics":{"iops":' || k || ',"latency":1.5,"errorRate":0}' END) || '}' END AS body
  FROM raw0),
js AS (SELECT event_id, ts, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM raw),
facts AS (
  SELECT event_id, ts, body, j, json_extract_string(j, '$.event_type') AS et, json_extract_string(j, '$.timestamp') AS tm,
    json_type(j, '$.payload') AS pk, json_type(j, '$.metrics') AS mk,
    json_type(j, '$.metrics.iops') AS ik, TRY_CAST(json_extract_string(j, '$.metrics.iops') AS DOUBLE) AS iv,
    json_type(j, '$.metrics.latency') AS lk, TRY_CAST(json_extract_string(j, '$.metrics.latency') AS DOUBLE) AS lv,
    json_type(j, '$.metrics.errorRate') AS ek, TRY_CAST(json_extract_string(j, '$.metrics.errorRate') AS DOUBLE) AS xv FROM js),
checks AS (
  SELECT *, j IS NULL AS bad_json, coalesce(et, '') = '' AS no_type,
    coalesce(et, '') <> '' AND et NOT IN ('session_started', 'session_completed', 'ib_call_logged', 'tutor_availability_updated',
      'customer_health_update', 'supply_demand_update') AS odd_type,
    coalesce(pk, 'NULL') NOT IN ('OBJECT', 'ARRAY') AS no_payload, mk = 'VARCHAR' AS odd_metrics,
    ik IS NOT NULL AND (ik NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR iv < 0) AS bad_iops,
    lk IS NOT NULL AND (lk NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR lv < 0) AS bad_latency,
    ek IS NOT NULL AND (ek NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR xv < 0 OR xv > 100) AS bad_rate,
    coalesce(tm, '') <> '' AND TRY_CAST(tm AS TIMESTAMP) IS NULL AS bad_time FROM facts),
val AS (
  SELECT event_id, ts, body, j, et, tm,
    CASE WHEN bad_json THEN 'raw_data:critical' ELSE concat_ws('; ', CASE WHEN no_type THEN 'event_type:critical' END,
      CASE WHEN odd_type THEN 'event_type:error' END, CASE WHEN no_payload THEN 'payload:critical' END,
      CASE WHEN odd_metrics THEN 'metrics:error' END, CASE WHEN bad_iops THEN 'metrics.iops:error' END,
      CASE WHEN bad_latency THEN 'metrics.latency:error' END, CASE WHEN bad_rate THEN 'metrics.errorRate:error' END,
      CASE WHEN bad_time THEN 'timestamp:warning' END) END AS errors,
    coalesce(bad_json, false)::INT + (NOT bad_json AND no_type)::INT + (NOT bad_json AND no_payload)::INT AS n_critical,
    CASE WHEN bad_json THEN 0 ELSE coalesce(odd_type, false)::INT + coalesce(odd_metrics, false)::INT + coalesce(bad_iops, false)::INT
      + coalesce(bad_latency, false)::INT + coalesce(bad_rate, false)::INT END AS n_error,
    CASE WHEN bad_json THEN 0 ELSE coalesce(bad_time, false)::INT END AS n_warning
  FROM checks),
norm AS (
  SELECT event_id, body, et AS event_type, coalesce(TRY_CAST(tm AS TIMESTAMP), TIMESTAMP '2024-01-31 00:00:00') AS ts,
    coalesce(json_extract_string(j, '$.payload.student_id'), json_extract_string(j, '$.payload.customer_id')) AS student_id,
    json_extract_string(j, '$.payload.tutor_id') AS tutor_id, json_extract_string(j, '$.payload.subject') AS subject,
    CAST(coalesce(json_extract_string(j, '$.payload.tutor_rating'), json_extract_string(j, '$.payload.rating'), json_extract_string(j, '$.payload.student_rating')) AS DOUBLE) AS rating,
    CAST(coalesce(json_extract_string(j, '$.payload.duration_minutes'), json_extract_string(j, '$.payload.actual_duration_minutes')) AS DOUBLE) AS duration_min,
    CAST(json_extract_string(j, '$.payload.was_cancelled') AS BOOLEAN) AS was_cancelled,
    CAST(json_extract_string(j, '$.payload.no_show') AS BOOLEAN) AS no_show,
    CAST(json_extract_string(j, '$.payload.available_slots_this_week') AS BIGINT) AS available_slots_this_week
  FROM val WHERE n_critical + n_error = 0)
"""

STUDENT = MKT + """,
stu AS (
  SELECT student_id AS entity_id,
    count(*) FILTER (event_type = 'session_completed' AND age < 7) AS sessions_7d,
    count(*) FILTER (event_type = 'session_completed' AND age < 14) AS sessions_14d,
    count(*) FILTER (event_type = 'session_completed' AND age < 30) AS sessions_30d,
    count(*) FILTER (event_type = 'ib_call_logged' AND age < 7) AS ib_calls_7d,
    count(*) FILTER (event_type = 'ib_call_logged' AND age < 14) AS ib_calls_14d,
    coalesce(avg(nullif(rating, 0)) FILTER (event_type = 'session_completed'), 0.0) AS avg_rating,
    coalesce(arg_max(health_score, ts) FILTER (event_type = 'customer_health_update'), 100.0) AS health_score,
    min(age) FILTER (event_type = 'session_completed') AS days_since_last_session, max(ts) AS last_updated
  FROM mkt WHERE event_type IN ('session_completed', 'ib_call_logged', 'customer_health_update') AND age >= 0 GROUP BY student_id),
pred AS (
  SELECT *, least(1.0, ib_calls_14d / 10.0::DOUBLE) AS c14, least(1.0, ib_calls_14d / 8.0::DOUBLE) AS c30,
    sessions_30d / 30.0::DOUBLE * 7 AS velocity, round(avg_rating / 5, 6) AS success FROM stu)
"""

TUTOR = STUDENT + """,
tin AS (SELECT * FROM mkt WHERE age >= 0 AND age < 30),
tst AS (
  SELECT tutor_id, student_id, count(*) FILTER (event_type = 'session_started') AS started,
    count(*) FILTER (event_type = 'session_completed') AS completed,
    count(*) FILTER (event_type = 'session_completed' AND nullif(rating, 0) < 3) AS negative,
    count(*) FILTER (event_type = 'session_completed' AND rating >= 4) AS positive,
    sum(duration_min) FILTER (event_type = 'session_completed') AS minutes, count(*) FILTER (was_cancelled) AS cancelled, count(*) FILTER (no_show) AS no_shows
  FROM tin WHERE event_type IN ('session_started', 'session_completed') GROUP BY ALL),
tag AS (
  SELECT tutor_id, CAST(sum(started) AS BIGINT) AS sessions_started, CAST(sum(completed) AS BIGINT) AS sessions_completed,
    count(*) FILTER (completed > 0) AS unique_students, count(*) FILTER (completed > 1) AS returning_students,
    CAST(sum(negative) AS BIGINT) AS negative_reviews, CAST(sum(positive) AS BIGINT) AS positive_reviews,
    CAST(coalesce(sum(minutes), 0) AS BIGINT) AS booked_minutes, sum(cancelled) AS cancelled, sum(no_shows) AS no_shows FROM tst GROUP BY tutor_id),
trat AS (SELECT tutor_id, stddev_samp(nullif(rating, 0)) AS volatility, min(age) AS days FROM tin WHERE event_type = 'session_completed' GROUP BY tutor_id),
tsub AS (SELECT tutor_id, count(*) AS subjects, max(c) AS top FROM (
    SELECT tutor_id, subject, count(*) AS c FROM tin WHERE event_type = 'session_completed' GROUP BY ALL) GROUP BY tutor_id),
thr AS (SELECT tutor_id, available_slots_this_week AS hours, k % 4 = 0 AS instant FROM tin WHERE event_type = 'tutor_availability_updated'
    QUALIFY row_number() OVER (PARTITION BY tutor_id ORDER BY ts DESC, event_id DESC) = 1),
tfeat AS (
  SELECT tag.*, coalesce(subjects, 0) AS subjects, sessions_completed / nullif(sessions_started, 0)::DOUBLE AS completion_rate,
    returning_students / nullif(unique_students, 0)::DOUBLE AS retention_rate,
    sessions_completed / nullif(subjects, 0)::DOUBLE AS sessions_per_subject,
    top / nullif(sessions_completed, 0)::DOUBLE AS specialization,
    booked_minutes / 60.0::DOUBLE / nullif(hours, 0)::DOUBLE AS utilization_rate, volatility, days, hours, instant
  FROM tag LEFT JOIN tsub USING (tutor_id) LEFT JOIN thr USING (tutor_id) LEFT JOIN trat USING (tutor_id)),
tcnt AS (
  SELECT tutor_id, count(*) FILTER (age < 7) AS t7, count(*) FILTER (age < 14) AS t14, count(*) FILTER (age < 30) AS t30,
    count(*) FILTER (age < 7 AND event_type = 'session_completed') AS c7,
    count(*) FILTER (age < 14 AND event_type = 'session_completed') AS cc14,
    count(*) FILTER (age < 30 AND event_type = 'session_completed') AS cc30,
    avg(nullif(rating, 0)) FILTER (event_type = 'session_completed') AS mean_rating
  FROM mkt WHERE event_type IN ('session_started', 'session_completed') GROUP BY tutor_id),
tut AS (SELECT * FROM tcnt LEFT JOIN tfeat USING (tutor_id))
"""

SEG = """CASE WHEN entity_type = 'tutor' THEN CASE WHEN c14 > 0.7::DOUBLE OR health_score < 40 THEN 'churning'
    WHEN c14 > 0.4::DOUBLE OR health_score < 60 THEN 'at_risk' WHEN c14 < 0.2::DOUBLE AND health_score > 80 THEN 'star' ELSE 'healthy' END
  ELSE CASE WHEN c14 > 0.7::DOUBLE OR health_score < 40 THEN 'churned'
    WHEN c14 > 0.4::DOUBLE OR c30 > 0.6::DOUBLE OR health_score < 60 THEN 'at_risk'
    WHEN c14 < 0.2::DOUBLE AND health_score > 80 THEN 'thriving' ELSE 'healthy' END END"""

SCORED = TUTOR + f""",
both_types AS (
  SELECT CAST(entity_id AS VARCHAR) AS entity_id, 'student' AS entity_type, c14, c30, velocity, success, health_score, avg_rating,
    sessions_7d, sessions_30d, ib_calls_14d, days_since_last_session, last_updated, NULL AS utilization_rate, NULL AS retention FROM pred
  UNION ALL
  SELECT CAST(tutor_id AS VARCHAR), 'tutor', least(1.0, t30 / 2000.0::DOUBLE), least(1.0, t30 / 1500.0::DOUBLE), cc30 / 30.0::DOUBLE * 7,
    round(coalesce(mean_rating, 0.0) / 5, 6), CAST(100 - coalesce(negative_reviews, 0) % 90 AS DOUBLE), coalesce(mean_rating, 0.0),
    NULL, NULL, NULL, NULL, NULL, utilization_rate, retention_rate FROM tut),
scored AS (SELECT *, {SEG} AS segment FROM both_types)
"""

ALERTS = BASE + """,
al AS (SELECT event_id AS alert_no, event_type AS alert_type, user_id % 25 AS entity_id, ts AS "timestamp",
    CASE WHEN value >= 100 THEN 'critical' WHEN value >= 30 THEN 'warning' ELSE 'info' END AS severity
  FROM ev WHERE event_type IN ('error', 'click', 'signup'))
"""


def oracle(name: str, base: str, body: str, recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{base.strip()}\n{body.strip()}"


def _windows(template: str, days=(7, 14, 30)) -> str:
    return ", ".join(template.replace("{d}", str(d)) for d in days)


# --- entity metrics -------------------------------------------------------------------------------------------

oracle("windowed_features", MKT, "SELECT student_id, " + _windows("""
  count(*) FILTER (done AND age < {d}) AS session_count_{d}d, round(count(*) FILTER (done AND age < {d}) / {d}.0::DOUBLE, 6) AS session_frequency_{d}d,
  round(coalesce(avg(nullif(rating, 0)) FILTER (done AND age < {d}), 0.0), 6) AS avg_rating_{d}d,
  count(*) FILTER (NOT done AND age < {d}) AS ib_call_count_{d}d,
  count(*) FILTER (NOT done AND age < {d} AND sentiment < -0.3::DOUBLE) AS negative_calls_{d}d""") + """,
  CAST(coalesce(min(age) FILTER (done), 999) AS INTEGER) AS days_since_last_session,
  CAST(coalesce(min(age) FILTER (NOT done), 999) AS INTEGER) AS days_since_last_ib_call
FROM (SELECT *, event_type = 'session_completed' AS done FROM mkt WHERE event_type IN ('session_completed', 'ib_call_logged'))
GROUP BY student_id""")

oracle("window_catalogue", ACT, "SELECT customer_id, " + _windows("""
  round(count(*) FILTER (age < {d} AND status = 'completed') / nullif(count(*) FILTER (age < {d} AND activity = 'session'), 0)::DOUBLE, 6) AS session_completion_rate_{d}d,
  round(count(*) FILTER (age < {d} AND status = 'cancelled') / nullif(count(*) FILTER (age < {d} AND activity = 'session'), 0)::DOUBLE, 6) AS cancellation_rate_{d}d,
  round(count(*) FILTER (age < {d} AND status = 'no_show') / nullif(count(*) FILTER (age < {d} AND activity = 'session'), 0)::DOUBLE, 6) AS no_show_rate_{d}d,
  round(avg(duration_min) FILTER (age < {d}), 6) AS avg_session_duration_{d}d, round(avg(call_seconds) FILTER (age < {d}), 6) AS avg_call_duration_{d}d,
  count(*) FILTER (age < {d} AND escalated) AS escalation_count_{d}d, count(*) FILTER (age < {d} AND activity = 'login') AS login_count_{d}d,
  count(*) FILTER (age < {d} AND activity = 'message') AS message_count_{d}d,
  CAST(count(DISTINCT CAST(ts AS DATE)) FILTER (age < {d}) AS INTEGER) AS days_active_{d}d,
  round(count(*) FILTER (age < {d} AND paid) / nullif(count(*) FILTER (age < {d} AND activity = 'payment'), 0)::DOUBLE, 6) AS payment_success_rate_{d}d,
  round(coalesce(sum(amount) FILTER (age < {d} AND paid), 0.0), 6) AS payment_amount_{d}d""") + " FROM act GROUP BY customer_id")

_OWNERS = """ow AS (
  SELECT CAST(student_id AS VARCHAR) AS entity_id, 'student' AS entity_type, event_type, age FROM mkt WHERE event_type IN ('session_started', 'session_completed', 'ib_call_logged')
  UNION ALL SELECT CAST(tutor_id AS VARCHAR), 'tutor', event_type, age FROM mkt WHERE event_type IN ('session_started', 'session_completed'))"""

oracle("entity_counters", MKT + "," + _OWNERS, "SELECT entity_id, entity_type, " + _windows(
    "count(*) FILTER (event_type = 'session_started' AND age < {d}) AS started_{d}d, count(*) FILTER (event_type = 'session_completed' AND age < {d}) AS completed_{d}d"
) + ", " + _windows("count(*) FILTER (event_type = 'ib_call_logged' AND age < {d}) AS ib_calls_{d}d", (7, 14)) + " FROM ow GROUP BY ALL")

oracle("entity_counters_total", MKT + "," + _OWNERS, "SELECT entity_id, entity_type, " + _windows(
    "count(*) FILTER (event_type <> 'ib_call_logged') AS sessions_{d}d"
) + ", " + _windows("count(*) FILTER (event_type = 'ib_call_logged') AS ib_calls_{d}d", (7, 14)) + " FROM ow GROUP BY ALL")

oracle("tutor_session_agg", MKT, """
SELECT tutor_id, count(*) AS sessions_completed_count, CAST(sum(duration_min) AS BIGINT) AS session_duration_total_min,
  CAST(coalesce(sum(nullif(rating, 0)), 0) AS BIGINT) AS session_rating_sum, count(nullif(rating, 0)) AS session_rating_count,
  count(*) FILTER (was_cancelled) AS cancellation_count, count(*) FILTER (no_show) AS no_show_count,
  arg_max(subject, ts) AS primary_subject, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects_taught,
  max(ts) AS last_session_timestamp, (list(nullif(rating, 0) ORDER BY ts, event_id))[-1] AS last_session_rating
FROM mkt WHERE event_type = 'session_completed' GROUP BY tutor_id""")

EARNED = TUTOR + """,
rates AS (SELECT tutor_id, ts, arg_max(20 + k % 40, event_id)::DOUBLE AS rate FROM mkt WHERE event_type = 'tutor_availability_updated' GROUP BY tutor_id, ts),
paid AS (SELECT s.tutor_id, age, rate, coalesce(rate * duration_min / 60, 0.0) AS e
  FROM (SELECT * FROM mkt WHERE event_type = 'session_completed' AND age >= 0 AND age < 30 AND NOT was_cancelled AND NOT no_show) AS s
  ASOF LEFT JOIN rates AS r ON s.tutor_id = r.tutor_id AND s.ts >= r.ts),
halves AS (SELECT tutor_id, sum(e) AS total, count(*) AS paid, count(*) FILTER (rate IS NULL) AS unrated, coalesce(sum(e) FILTER (age < 15), 0.0) AS late, coalesce(sum(e) FILTER (age >= 15), 0.0) AS early
  FROM paid GROUP BY tutor_id),
earn AS (SELECT tutor_id, total, paid, unrated, CASE WHEN late > early * 1.1::DOUBLE THEN 'growing' WHEN late < early * 0.9::DOUBLE THEN 'declining' ELSE 'stable' END AS trend FROM halves)"""

oracle("tutor_feature_agg", EARNED, """
SELECT tutor_id, sessions_started, sessions_completed, unique_students, returning_students, negative_reviews, positive_reviews,
  booked_minutes, subjects, round(completion_rate, 6) AS completion_rate, round(retention_rate, 6) AS retention_rate,
  round(sessions_per_subject, 6) AS sessions_per_subject, round(specialization, 6) AS specialization,
  round(utilization_rate, 6) AS utilization_rate, round(cancelled / nullif(sessions_completed, 0)::DOUBLE, 6) AS cancellation_rate,
  round(no_shows / nullif(sessions_completed, 0)::DOUBLE, 6) AS no_show_rate, round(booked_minutes / nullif(sessions_completed, 0)::DOUBLE, 6) AS avg_session_duration_min,
  round(volatility, 6) AS rating_volatility, round(sessions_completed / nullif(unique_students, 0)::DOUBLE, 6) AS avg_student_sessions,
  CAST(coalesce(days, 999) AS INTEGER) AS days_since_last_session, hours AS available_hours, instant AS instant_book_enabled, round(coalesce(total, 0.0), 6) AS total_earnings, coalesce(paid, 0) AS paid_sessions,
  coalesce(unrated, 0) AS unrated_sessions, round(total / paid, 6) AS avg_earnings_per_session, trend AS earnings_trend FROM tfeat LEFT JOIN earn USING (tutor_id)""")

oracle("running_rating", MKT + """,
st AS (SELECT tutor_id, row_number() OVER (PARTITION BY tutor_id ORDER BY ts, event_id) AS n,
    CASE WHEN event_type = 'session_completed' THEN rating END AS r FROM mkt WHERE event_type IN ('session_started', 'session_completed')),
f(tutor_id, n, a) AS (
  SELECT DISTINCT tutor_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM st
  UNION ALL SELECT f.tutor_id, st.n, CASE WHEN st.r IS NULL THEN f.a ELSE (f.a * (st.n - 1) + st.r) / st.n END
  FROM f JOIN st ON st.tutor_id = f.tutor_id AND st.n = f.n + 1)""",
       "SELECT tutor_id, max(n) AS sessions, round(arg_max(a, n), 6) AS running_rating FROM f GROUP BY tutor_id", recursive=True)

oracle("mean_rating", MKT, """SELECT tutor_id, round(avg(nullif(rating, 0)), 6) AS mean_rating, count(nullif(rating, 0)) AS n_rated
FROM mkt WHERE event_type = 'session_completed' GROUP BY tutor_id""")


def _overlay(metric: str, field: str, types: str) -> str:
    return f"""coalesce(arg_max({field}, ts) FILTER ({field} IS NOT NULL), 0) +
  count(*) FILTER (event_type IN ({types}) AND (at_{field} IS NULL OR ts > at_{field})) AS {metric}"""


oracle("health_overlay", MKT + """,
hs AS (SELECT *, max(CASE WHEN sessions_last_7_days IS NOT NULL THEN ts END) OVER w AS at_sessions_last_7_days,
    max(CASE WHEN sessions_last_30_days IS NOT NULL THEN ts END) OVER w AS at_sessions_last_30_days,
    max(CASE WHEN ib_calls_last_14_days IS NOT NULL THEN ts END) OVER w AS at_ib_calls_last_14_days
  FROM mkt WHERE event_type IN ('session_started', 'session_completed', 'ib_call_logged', 'customer_health_update')
  WINDOW w AS (PARTITION BY student_id))""", "SELECT student_id, "
       + _overlay("sessions_7d", "sessions_last_7_days", "'session_started', 'session_completed'")
       + ", count(*) FILTER (event_type IN ('session_started', 'session_completed')) AS sessions_14d, "
       + _overlay("sessions_30d", "sessions_last_30_days", "'session_started', 'session_completed'")
       + ", count(*) FILTER (event_type = 'ib_call_logged') AS ib_calls_7d, "
       + _overlay("ib_calls_14d", "ib_calls_last_14_days", "'ib_call_logged'")
       + ", round(coalesce(arg_max(health_score, ts), 100.0), 6) AS health_score FROM hs GROUP BY student_id")

oracle("latest_supply_demand", MKT, """
SELECT subject, region, available_tutors, active_students, demand_score, supply_score, balance_status,
  CASE WHEN demand_score > supply_score * 1.5::DOUBLE THEN 'high_demand' WHEN supply_score > demand_score * 1.5::DOUBLE THEN 'high_supply'
    ELSE 'balanced' END AS balance_by_ratio, ts AS last_updated
FROM mkt WHERE event_type = 'supply_demand_update' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) = 1""")

_SUPPLY = MKT + """,
m AS (SELECT subject, CAST(sum(available_tutors) AS BIGINT) AS available_tutors, CAST(sum(pending_requests) AS BIGINT) AS pending_requests,
    round(avg(demand_score / supply_score), 6) AS avg_pressure FROM mkt WHERE event_type = 'supply_demand_update' AND age < 30 GROUP BY subject),
l AS (SELECT subject, count(DISTINCT tutor_id) FILTER (event_type <> 'tutor_availability_updated') AS tutor_count,
    sum(duration_min) AS booked, sum(available_slots_this_week) AS hours FROM mkt
  WHERE event_type IN ('session_started', 'session_completed', 'tutor_availability_updated') AND age < 30 GROUP BY subject),
sd AS (SELECT subject, available_tutors, pending_requests, avg_pressure,
    round(available_tutors / nullif(pending_requests, 0)::DOUBLE, 6) AS supply_demand_ratio,
    round(booked / 60.0::DOUBLE / nullif(hours, 0)::DOUBLE, 6) AS utilization_rate, coalesce(tutor_count, 0) AS tutor_count
  FROM m FULL JOIN l USING (subject))"""
oracle("supply_demand_features", _SUPPLY, "SELECT * FROM sd")
oracle("supply_demand_wide", _SUPPLY, "SELECT " + ", ".join(
    f"""max(supply_demand_ratio) FILTER (subject = 'subject-{i}') AS "subject-{i}" """ for i in range(9)) + ", CAST(count(*) FILTER (subject IS NULL OR NOT regexp_full_match(subject, 'subject-[0-8]')) AS INTEGER) AS other_subjects FROM sd")

oracle("recency", ACT, "SELECT customer_id, " + ", ".join(
    f"CAST(coalesce(min(age) FILTER (activity = '{k}'), 999) AS INTEGER) AS days_since_last_{k}" for k in ("session", "login", "payment", "ib_call")
) + ", CAST(max(age) AS INTEGER) AS days_since_signup FROM act GROUP BY customer_id")

oracle("lifetime", ACT, """
SELECT customer_id, count(*) FILTER (activity = 'session') AS total_sessions_lifetime,
  round(coalesce(sum(amount) FILTER (paid), 0.0), 6) AS total_spend_lifetime, CAST(max(age) AS INTEGER) AS customer_tenure_days,
  coalesce(arg_min(nullif(rating, 0), ts) > 4.0, false) AS first_session_was_success, round(avg(nullif(rating, 0)), 6) AS avg_lifetime_rating
FROM act GROUP BY customer_id""")

oracle("tutor_consistency", MKT + """,
rec AS (SELECT * FROM mkt WHERE event_type = 'session_completed' QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, event_id DESC) <= 20),
bt AS (SELECT student_id, tutor_id, count(*) AS c, avg(nullif(rating, 0)) AS r FROM rec GROUP BY ALL),
pt AS (SELECT *, sum(c) OVER (PARTITION BY student_id) AS total FROM bt QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY c DESC, tutor_id) = 1),
sw AS (SELECT student_id, count(DISTINCT tutor_id) AS n FROM mkt WHERE event_type = 'session_completed' AND age < 30 GROUP BY student_id)""",
       """SELECT student_id, tutor_id AS primary_tutor, round(c / total::DOUBLE, 6) AS tutor_consistency_score, round(r, 6) AS primary_tutor_rating,
  coalesce(n, 0) AS tutor_switch_count_30d FROM pt LEFT JOIN sw USING (student_id)""")

oracle("session_trends", MKT + """,
w AS (SELECT student_id, count(*) FILTER (done AND age < 7) AS s7, count(*) FILTER (done AND age < 14) AS s14, count(*) FILTER (done AND age < 30) AS s30,
    coalesce(avg(nullif(rating, 0)) FILTER (done AND age < 7), 0.0) AS r7, coalesce(avg(nullif(rating, 0)) FILTER (done AND age < 30), 0.0) AS r30,
    count(*) FILTER (NOT done AND age < 7) AS c7, count(*) FILTER (NOT done AND age < 30) AS c30
  FROM (SELECT *, event_type = 'session_completed' AS done FROM mkt WHERE event_type IN ('session_completed', 'ib_call_logged')) GROUP BY student_id)""",
       """SELECT student_id, round(s7 / 7.0::DOUBLE - s30 / 30.0::DOUBLE, 6) AS session_velocity_change, round(r7 - r30, 6) AS rating_trend,
  round(c7 / 7.0::DOUBLE - c30 / 30.0::DOUBLE, 6) AS call_acceleration,
  CASE WHEN s7 = 0 AND s30 > 0 THEN 'inactive' WHEN s7 < s14 - s7 THEN 'declining' WHEN s7 > s14 - s7 THEN 'increasing' ELSE 'steady' END AS session_pattern FROM w""")

oracle("activity_trends", ACT, """
SELECT customer_id, count(*) FILTER (activity = 'login' AND age < 7) - count(*) FILTER (activity = 'login' AND age < 14) AS engagement_trend,
  round(coalesce(sum(amount) FILTER (paid AND age < 7), 0.0) / 7 - coalesce(sum(amount) FILTER (paid AND age < 30), 0.0) / 30, 6) AS spend_acceleration FROM act GROUP BY customer_id""")
oracle("latest_metrics", MKT, """SELECT student_id AS entity_id, 'student' AS entity_type, ts, event_id, rating, duration_min FROM mkt WHERE event_type = 'session_completed'
QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, event_id DESC) = 1""")

oracle("sliding_refresh", MKT, "SELECT student_id, " + _windows("""
  count(*) FILTER (done AND age < {d}) AS session_count_{d}d, count(*) FILTER (NOT done AND age < {d}) AS ib_call_count_{d}d,
  count(*) FILTER (NOT done AND age < {d} AND sentiment < -0.3::DOUBLE) AS negative_calls_{d}d,
  round(coalesce(avg(nullif(rating, 0)) FILTER (done AND age < {d}), 0.0), 6) AS avg_rating_{d}d,
  count(DISTINCT CAST(ts AS DATE)) FILTER (age < {d}) AS days_active_{d}d""") + """
FROM (SELECT *, event_type = 'session_completed' AS done FROM mkt WHERE event_type IN ('session_completed', 'ib_call_logged') AND age < 30) GROUP BY student_id""")

oracle("metrics_with_defaults", STUDENT, """
SELECT c_custkey AS entity_id, coalesce(sessions_7d, 0) AS sessions_7d, coalesce(sessions_14d, 0) AS sessions_14d, coalesce(sessions_30d, 0) AS sessions_30d,
  coalesce(ib_calls_7d, 0) AS ib_calls_7d, coalesce(ib_calls_14d, 0) AS ib_calls_14d, round(coalesce(avg_rating, 0.0), 6) AS avg_rating,
  round(coalesce(health_score, 100.0), 6) AS health_score FROM customer LEFT JOIN stu ON c_custkey = entity_id""")

# --- validation and routing -----------------------------------------------------------------------------------

oracle("event_validation", RAW, "SELECT event_id, n_critical + n_error = 0 AS is_valid, errors FROM val")
_WORST = "CASE WHEN n_critical > 0 THEN 'critical' WHEN n_error > 0 THEN 'error' ELSE 'warning' END"
oracle("malformed_summary", RAW, f"""SELECT event_id, {_WORST} AS severity,
  'Found ' || n_critical || ' critical, ' || n_error || ' errors, ' || n_warning || ' warnings' AS summary FROM val WHERE n_critical + n_error > 0""")
oracle("quarantine_by_severity", RAW, f"SELECT {_WORST} AS severity, count(*) AS n FROM val WHERE n_critical + n_error > 0 GROUP BY 1")
oracle("ingest_reject_reason", RAW, """SELECT event_id, CASE WHEN bad_json THEN 'Request body is not valid JSON' WHEN no_type THEN 'event_type is required'
  WHEN odd_type THEN 'Invalid event_type. Must be one of: session_started, session_completed, ib_call_logged, tutor_availability_updated, customer_health_update, supply_demand_update'
  WHEN no_payload THEN 'payload is required and must be an object' END AS reject_reason FROM checks""")
oracle("required_gate", RAW, """SELECT event_id, concat_ws(',', 'entity_id', 'entity_type', CASE WHEN tm IS NULL THEN 'timestamp' END,
  CASE WHEN mk IS NOT NULL AND mk <> 'OBJECT' THEN 'metrics' END) AS missing FROM facts""")
oracle("short_validation", RAW, """SELECT event_id, n = 0 AS is_valid, CASE WHEN n > 3 THEN 'critical' ELSE 'error' END AS severity, n AS n_reasons FROM (
  SELECT event_id, (bad_json OR no_type OR odd_type)::INT + (coalesce(tm, '') = '')::INT + (pk IS NULL)::INT + coalesce(iv < 0, false)::INT AS n FROM checks)""")
oracle("ingest_normalised", RAW, """SELECT event_id, ts, event_type, student_id, tutor_id, subject, rating, duration_min, was_cancelled, no_show,
  available_slots_this_week FROM norm""")
oracle("event_items", RAW, """
SELECT sha256(body) AS entity_id, 'event' AS entity_type, ts, event_id, event_type, 1706659200 + 30 * 86400 AS ttl FROM norm
QUALIFY row_number() OVER (PARTITION BY sha256(body) ORDER BY ts DESC, event_id DESC) = 1""")
oracle("ingest_tutor_state", RAW, """
SELECT tutor_id AS entity_id, 'tutor' AS entity_type, 1706659200 + 90 * 86400 AS ttl, max(ts) AS ts, count(*) FILTER (done) AS sessions_completed_count,
  coalesce(sum(duration_min) FILTER (done), 0)::DOUBLE AS session_duration_total_min, coalesce(sum(rating) FILTER (done), 0)::DOUBLE AS session_rating_sum,
  count(*) FILTER (done AND coalesce(rating, 0) <> 0) AS session_rating_count, count(*) FILTER (done AND was_cancelled) AS cancellation_count,
  count(*) FILTER (done AND no_show) AS no_show_count, (list(subject ORDER BY ts, event_id) FILTER (done AND subject IS NOT NULL))[-1] AS primary_subject,
  (list(coalesce(available_slots_this_week, 0) ORDER BY ts, event_id) FILTER (NOT done))[-1] AS available_slots_this_week
FROM (SELECT *, event_type = 'session_completed' AS done FROM norm WHERE event_type IN ('session_completed', 'tutor_availability_updated') AND coalesce(tutor_id, '') <> '')
GROUP BY tutor_id""")
oracle("malformed_rate_5m", RAW, """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS period, count(*) AS total, count(*) FILTER (n_critical + n_error > 0) AS malformed,
  round(count(*) FILTER (n_critical + n_error > 0) / count(*)::DOUBLE * 100, 6) AS malformed_rate FROM val GROUP BY 1""")

# --- insight serving ------------------------------------------------------------------------------------------

_NEWEST = 'ORDER BY "timestamp" DESC, alert_id DESC LIMIT'
_SINCE = "\"timestamp\" >= TIMESTAMP '2024-01-20'"
_PAGE = f"""SELECT * FROM served WHERE {_SINCE} AND ("timestamp", alert_id) < (TIMESTAMP '2024-01-25 12:00:00', 1000000000) {_NEWEST} 50"""
oracle("insight_recent", INS, f"SELECT * FROM served {_NEWEST} 50")
oracle("insight_stream_view", INS, f"SELECT * FROM served {_NEWEST} 10")
oracle("insight_page", INS, _PAGE)
oracle("insight_fetch_all", INS, f"SELECT * FROM served WHERE {_SINCE}")
_KPI = """count(*) AS total, count(*) FILTER (coalesce(risk_score, 0) >= 80) AS critical,
  CAST(coalesce(floor(avg(coalesce(risk_score, 0)) + 0.5), 0) AS BIGINT) AS avg_risk"""
oracle("insight_kpis", INS, f"SELECT {_KPI} FROM ins WHERE {_SINCE}")
oracle("insight_by_type", INS, "SELECT coalesce(prediction_type, 'unknown') AS prediction_type, count(*) AS n FROM ins GROUP BY 1")
oracle("insight_page_kpis", INS + f", p AS ({_PAGE})", f"SELECT {_KPI} FROM p")
oracle("kpi_card", INS + f", q AS (SELECT {_KPI} FROM ins)", """SELECT *, CAST(floor(critical / total::DOUBLE * 100 + 0.5) AS BIGINT) AS critical_pct,
  CASE WHEN critical > 5 THEN 'up' ELSE 'down' END AS trend FROM q""")
oracle("risk_distribution", INS, """
SELECT CAST(p.i AS INTEGER) AS position, p.name, round(avg(coalesce(risk_score, 0)), 1) AS avg_risk, count(*) AS n
FROM ins JOIN (VALUES (1, 'customer_health', 'Customer Health'), (2, 'churn_risk', 'Churn Risk'), (3, 'session_quality', 'Session Quality'),
  (4, 'marketplace_balance', 'Marketplace Balance'), (5, 'tutor_capacity', 'Tutor Capacity'), (6, 'first_session_success', 'First Session Success')) p(i, t, name)
  ON p.t = prediction_type GROUP BY p.i, p.name""")


def _trend(name: str, start: str, minutes: int) -> None:
    width = f"INTERVAL {minutes} MINUTE"
    floor = lambda x: f"time_bucket({width}, {x}, TIMESTAMP '1970-01-01')"
    oracle(f"insight_trend_{name}", INS + f""",
spine AS (SELECT unnest(generate_series({floor(f"TIMESTAMP '{start}'")}, {floor("TIMESTAMP '2024-01-25 17:42:10'")}, {width})) AS b),
cnt AS (SELECT {floor('"timestamp"')} AS b, count(*) FILTER (risk_score >= 80) AS c, count(*) FILTER (prediction_type = 'churn_risk') AS ch FROM ins GROUP BY 1)""",
           "SELECT b AS bucket_start, coalesce(c, 0) AS critical_alerts, coalesce(ch, 0) AS churn_risks FROM spine LEFT JOIN cnt USING (b)")


_trend("1h", "2024-01-25 16:42:10", 10)
_trend("3h", "2024-01-25 14:42:10", 20)
_trend("today", "2024-01-25 00:00:00", 120)
_trend("week", "2024-01-18 17:42:10", 1440)
_trend("default", "2024-01-24 17:42:10", 30)

oracle("ttl_active", INS, """SELECT entity_id, "timestamp", ttl FROM ins WHERE ttl > epoch(TIMESTAMP '2024-02-05')""")
_OVERLAP = INS + """,
old AS (SELECT * FROM served WHERE "timestamp" < TIMESTAMP '2024-01-22'),
fresh AS (SELECT * REPLACE (risk_score + 1 AS risk_score) FROM served WHERE "timestamp" >= TIMESTAMP '2024-01-18')"""
oracle("insight_merge_unique", _OVERLAP, """
SELECT coalesce(o.alert_id, f.alert_id) AS alert_id, coalesce(o.entity_id, f.entity_id) AS entity_id, coalesce(o.risk_score, f.risk_score) AS risk_score,
  f.alert_id IS NOT NULL AS is_new FROM old o FULL JOIN fresh f ON o.alert_id = f.alert_id""")
oracle("insight_not_held", _OVERLAP, "SELECT alert_id, entity_id, risk_score FROM fresh WHERE alert_id NOT IN (SELECT alert_id FROM old)")
oracle("insight_poll", INS, f"""SELECT * FROM served WHERE "timestamp" > TIMESTAMP '2024-01-29' {_NEWEST} 10""")
oracle("insight_by_filter", INS, "SELECT alert_id, entity_id, risk_score, prediction_type AS kind FROM served WHERE prediction_type = 'churn_risk'")
oracle("insight_lookup", INS, "SELECT alert_id, entity_id, prediction_type, risk_score, confidence FROM served WHERE alert_id IN (SELECT o_orderkey FROM orders)")
oracle("critical_per_hour", INS, """SELECT date_trunc('hour', "timestamp") AS hour, count(*) AS critical_alerts FROM served WHERE risk_score >= 80 GROUP BY 1""")
oracle("severity_view", INS, """SELECT alert_id, risk_score, CASE WHEN risk_score >= 80 THEN 'error' WHEN risk_score >= 60 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' ELSE 'medium' END AS tier,
  CASE WHEN risk_score >= 80 THEN 'critical_performance_issue' WHEN risk_score >= 60 THEN 'performance_degradation' WHEN risk_score >= 40 THEN 'anomaly_detected'
    ELSE 'normal_operation' END AS performance_type FROM served""")
oracle("path_unhealthy_students", STUDENT, "SELECT entity_id, round(health_score, 6) AS health_score, last_updated FROM stu WHERE health_score < 70")
oracle("path_risky_by_type", INS, """SELECT entity_id, risk_score, "timestamp" FROM ins WHERE prediction_type = 'churn_risk' AND risk_score > 80""")

# --- telemetry ------------------------------------------------------------------------------------------------

_ROLL = TEL + """,
roll AS (SELECT *, stddev_samp(value) OVER w AS iv, stddev_samp(throughput) OVER w AS tv, stddev_samp(io_size_kb) OVER w AS ov,
    coalesce(value - lag(value) OVER o, 0.0) AS tr, error_rate - lag(error_rate) OVER o AS step,
    avg(value) OVER d AS dm, stddev_samp(value) OVER d AS ds FROM tel
  WINDOW w AS (PARTITION BY device_id ORDER BY ts, insight_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    o AS (PARTITION BY device_id ORDER BY ts, insight_id), d AS (PARTITION BY device_id))"""
_ET = "CASE WHEN step > 0.001::DOUBLE THEN 1 WHEN step < -0.001::DOUBLE THEN -1 ELSE 0 END"
oracle("rolling_std10", _ROLL, "SELECT insight_id, round(iv, 4) AS iops_variance, round(tv, 4) AS throughput_variance, round(ov, 4) AS io_size_variance FROM roll")
oracle("error_trend", _ROLL, f"SELECT insight_id, round(tr, 4) AS trend_score, {_ET} AS error_trend FROM roll")
oracle("device_anomaly", _ROLL, """SELECT insight_id, round(dm, 9) AS device_mean, round(ds, 6) AS device_std, round(abs(value - dm) / (ds + 1), 6) AS anomaly_score FROM roll""")
oracle("telemetry25", _ROLL, f"""
SELECT round(read_iops, 6) AS read_iops, round(write_iops, 6) AS write_iops, round(iops, 6) AS total_iops, round(iv, 6) AS iops_variance, round(latency, 6) AS avg_latency,
  round(p95_latency, 6) AS p95_latency, round(p99_latency, 6) AS p99_latency, (p99_latency > 2 * latency)::INT AS latency_spike_count,
  round(throughput, 6) AS bandwidth_mbps, round(tv, 6) AS throughput_variance, round(error_rate, 6) AS error_rate, {_ET} AS error_trend,
  CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, 24.0::DOUBLE AS time_since_last_alert,
  CASE WHEN sequential THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sequential_access_ratio, CASE WHEN sequential THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS random_access_ratio,
  queue_depth, round(io_size_kb, 6) AS io_size_avg, round(ov, 6) AS io_size_variance, round(iops / (latency + 1), 6) AS iops_per_latency,
  round(abs(value - dm) / (ds + 1), 6) AS anomaly_score, round(tr, 6) AS trend_score, round(iops / 15000.0::DOUBLE, 6) AS load_factor,
  round(throughput / (iops + 1), 6) AS efficiency_ratio, coalesce(risk_level, 'unknown') AS risk_level, round(coalesce(performance_score, -1.0), 6) AS performance_score,
  insight_id, device_id, ts FROM roll""")
oracle("serving_features", TEL, """
SELECT insight_id, CAST(floor(iops * 0.6::DOUBLE) AS BIGINT) AS read_iops, CAST(floor(iops * 0.4::DOUBLE) AS BIGINT) AS write_iops, round(iops, 4) AS total_iops,
  CAST(floor(iops * 0.15::DOUBLE) AS BIGINT) AS iops_variance, round(latency, 4) AS avg_latency, round(latency * 2.5::DOUBLE, 4) AS p95_latency,
  round(latency * 5, 4) AS p99_latency, CASE WHEN latency > 10 THEN 3 ELSE 0 END AS latency_spike_count, round(throughput, 4) AS bandwidth_mbps,
  CAST(floor(throughput * 0.1::DOUBLE) AS BIGINT) AS throughput_variance, round(error_rate, 4) AS error_rate, CASE WHEN error_rate > 1 THEN 0.5::DOUBLE ELSE -0.2::DOUBLE END AS error_trend,
  CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, 3600 AS time_since_last_alert,
  0.7::DOUBLE AS sequential_access_ratio, 0.3::DOUBLE AS random_access_ratio, queue_depth, 128 AS io_size_avg, 32 AS io_size_variance,
  round(CASE WHEN latency > 0 THEN iops / latency ELSE 0.0 END, 4) AS iops_per_latency, round(error_rate * 2 + CASE WHEN latency > 10 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS anomaly_score,
  CASE WHEN iops > 80000 THEN 7 ELSE 3 END + CASE WHEN latency > 15 THEN 2 ELSE 0 END AS trend_score, round(least(iops / 150000, 1.0), 4) AS capacity_utilization,
  CASE WHEN iops > 100000 THEN 2 WHEN latency > 10 THEN 1 ELSE 0 END AS workload_type FROM tel""")
oracle("feature_csv", TEL, "SELECT insight_id, printf('%.2f', round_even(latency, 2)) AS avg_latency, 25 AS cells FROM tel")
_SROLL = STR + """,
sr AS (SELECT *, avg(latency_p99) OVER w5 AS l5, avg(utilization) OVER w5 AS u5, stddev_samp(latency_p99) OVER w5 AS s5,
    avg(latency_p99) OVER w15 AS l15, avg(latency_p99) OVER w60 AS l60, latency_p99 - lag(latency_p99) OVER o AS rate,
    utilization - lag(utilization) OVER o AS urate, lag(latency_p99) OVER o - lag(latency_p99, 2) OVER o AS prate FROM delta
  WINDOW o AS (PARTITION BY stream_id ORDER BY ts, metric_id),
    w5 AS (PARTITION BY stream_id ORDER BY ts, metric_id ROWS 4 PRECEDING), w15 AS (PARTITION BY stream_id ORDER BY ts, metric_id ROWS 14 PRECEDING),
    w60 AS (PARTITION BY stream_id ORDER BY ts, metric_id ROWS 59 PRECEDING)),
feat AS (SELECT *, 100 - greatest(0.0, least(100.0, utilization * 0.4::DOUBLE + greatest(0.0, least(100.0, lat_pct)) * 0.3::DOUBLE + error_rate * 1000 * 0.3::DOUBLE)) AS health FROM sr)"""
oracle("rolling_means", _SROLL, """SELECT metric_id, round(l5, 9) AS latency_p99_5m_avg, round(u5, 9) AS utilization_5m_avg, round(s5, 6) AS latency_p99_5m_std,
  round(l15, 9) AS latency_p99_15m_avg, round(l60, 9) AS latency_p99_1h_avg FROM sr""")
oracle("rate_accel", _SROLL, "SELECT metric_id, round(rate, 4) AS latency_p99_rate, round(urate, 4) AS utilization_rate, round(rate - prate, 4) AS latency_p99_accel FROM sr")
oracle("stream_baselines", STR, """SELECT stream_id, round(lat_b, 6) AS latency_p99_baseline, round(util_b, 6) AS utilization_baseline, round(err_b, 6) AS error_rate_baseline,
  round(bw_b, 6) AS bandwidth_gbps_baseline FROM base""")
_DELTA_COLS = """round(lat_pct, 6) AS latency_p99_delta_pct, round(util_d, 6) AS utilization_delta_pct, round(bw_pct, 6) AS bandwidth_delta_pct,
  round(lat_abs, 6) AS latency_p99_delta_abs, round(latency_p99 * utilization / 100, 6) AS latency_x_utilization,
  round(error_rate * bandwidth_gbps, 6) AS error_x_bandwidth, round(health, 6) AS health_score"""
oracle("stream_baseline_delta", _SROLL, f"SELECT metric_id, {_DELTA_COLS} FROM feat")
oracle("stream_features", _SROLL, f"""
SELECT metric_id, round(latency_p99, 6) AS latency_p99, round(utilization, 6) AS utilization, round(error_rate, 6) AS error_rate, round(bandwidth_gbps, 6) AS bandwidth_gbps,
  qp_errors, round(l5, 9) AS latency_p99_5m_avg, round(s5, 6) AS latency_p99_5m_std, round(l15, 9) AS latency_p99_15m_avg, round(l60, 9) AS latency_p99_1h_avg,
  round(u5, 9) AS utilization_5m_avg, {_DELTA_COLS}, round(rate, 6) AS latency_p99_rate, round(rate - prate, 6) AS latency_p99_accel, round(urate, 6) AS utilization_rate,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, (isodow(ts) >= 6)::INT AS is_weekend, (hour(ts) BETWEEN 8 AND 18)::INT AS is_business_hours
FROM feat WHERE rate - prate IS NOT NULL AND lat_pct IS NOT NULL""")


def _trailing(interval: str) -> str:
    return STR + f""",
tb AS (SELECT *, count(*) OVER w AS n, avg(latency_p99) OVER w AS m FROM str
  WINDOW w AS (PARTITION BY stream_id ORDER BY ts RANGE BETWEEN INTERVAL {interval} PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))"""


oracle("trailing_baseline_15m", _trailing("15 MINUTE"), """SELECT metric_id, n AS history, round(coalesce(m, 0.0), 8) AS baseline,
  latency_p99 > coalesce(m, 0.0) * 1.5::DOUBLE AS is_anomaly FROM tb""")
oracle("trailing_baseline_extremes", STR + """,
wl AS (SELECT *, CASE WHEN metric_id % 101 = 0 THEN 'nan'::DOUBLE WHEN metric_id % 101 = 1 THEN 'inf'::DOUBLE WHEN metric_id % 101 = 2 THEN '-inf'::DOUBLE
    WHEN metric_id % 101 < 20 THEN 2e24::DOUBLE WHEN metric_id % 101 < 60 THEN 2e-11::DOUBLE ELSE latency_p99 END AS wild FROM str),
tb AS (SELECT metric_id, count(*) OVER w AS n, avg(wild) OVER w AS m FROM wl
  WINDOW w AS (PARTITION BY stream_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))""", """
SELECT metric_id, n AS history, CASE WHEN isnan(m) THEN 'nan' WHEN isinf(m) THEN CASE WHEN m > 0 THEN 'inf' ELSE '-inf' END ELSE printf('%.6e', coalesce(m, 0.0)) END AS baseline FROM tb""")
oracle("trailing_baseline_3d", _trailing("3 DAY"), "SELECT metric_id, n AS history, round(coalesce(m, 0.0), 8) AS baseline FROM tb")


def _asof(name: str, interval: str) -> None:
    near = lambda c, alias: f"CASE WHEN r.ts <= l.ts + INTERVAL {interval} THEN r.{c} END AS {alias}"
    oracle(name, STR + """, risky AS (SELECT event_id AS alert_id, CASE WHEN k % 19 <> 0 THEN user_id END AS stream_id, ts,
    CASE WHEN k % 11 <> 0 THEN CASE event_type WHEN 'view' THEN 'customer_health' WHEN 'purchase' THEN 'session_quality' WHEN 'error' THEN 'churn_risk'
      WHEN 'signup' THEN 'first_session_success' ELSE 'tutor_capacity' END END AS prediction_type, CAST(least(100, floor(value)) AS INTEGER) AS risk_score
  FROM ev WHERE k % 17 <> 0 AND least(100, floor(value)) >= 30)""", f"""
SELECT l.metric_id, l.stream_id, l.ts, round(l.latency_p99, 6) AS latency_p99, {near('ts', 'matched_ts')}, {near('alert_id', 'alert_id')},
  {near('prediction_type', 'prediction_type')}, {near('risk_score', 'risk_score')}
FROM str l ASOF LEFT JOIN risky r ON l.stream_id = r.stream_id AND l.ts <= r.ts""")


_asof("asof_next_alert", "5 MINUTE")
_asof("asof_next_alert_1d", "1 DAY")

oracle("auto_label", LABEL, "SELECT metric_id, prediction_type, risk_score, label_confidence, prediction_type IS NULL OR label_confidence < 0.75::DOUBLE AS needs_review FROM lab")
oracle("label_coverage", LABEL, """SELECT count(*) AS rows, count(prediction_type) AS labelled, round(count(prediction_type) / count(*)::DOUBLE * 100, 6) AS coverage_pct,
  count(*) FILTER (prediction_type IS NULL OR label_confidence < 0.75::DOUBLE) AS needs_review FROM lab""")
_NORMAL = "utilization BETWEEN 40 AND 70 AND latency_p99 < lat_b * 2 AND error_rate < 0.01::DOUBLE"
oracle("analysis_trigger", STR, f"""SELECT metric_id, coalesce(utilization > 80 OR latency_p99 > lat_b * 2 OR error_rate > 0.05::DOUBLE OR abs(lat_pct) > 20, false) AS needs_analysis,
  {_NORMAL} AS looks_normal FROM delta""")
oracle("trigger_suppression", LABEL + f""",
cand AS (SELECT metric_id, coalesce(prediction_type, 'none') AS alert_type, stream_id AS entity_id, ts AS "timestamp" FROM lab WHERE NOT ({_NORMAL})),
gaps AS (SELECT *, "timestamp" - lag("timestamp") OVER (PARTITION BY alert_type, entity_id ORDER BY "timestamp", metric_id) AS gap FROM cand)""",
       """SELECT metric_id, alert_type, entity_id, "timestamp" FROM gaps WHERE gap IS NULL OR gap >= INTERVAL 5 MINUTE""")
oracle("similar_metric_reuse", LABEL, """SELECT metric_id, first_value(metric_id) OVER w AS source_metric, first_value(metric_id) OVER w <> metric_id AS reused FROM lab
WINDOW w AS (PARTITION BY stream_id, coalesce(prediction_type, 'none'), floor(utilization / 10) ORDER BY ts, metric_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
_RULES = TEL + """,
rl AS (SELECT *, iops > 100000 AS a, latency > 10 AS b, error_rate > 1 AS c, queue_depth > 64 AS d, throughput < 1000 AND iops > 50000 AS e FROM tel),
pts AS (SELECT *, 20 * a::INT + 25 * b::INT + 30 * c::INT + 15 * d::INT + 10 * e::INT AS points, a::INT + b::INT + c::INT + d::INT + e::INT AS n_issues FROM rl)"""
_ISSUES = """list_filter([CASE WHEN a THEN 'Node ' || device_id || ': High IOPS (' || iops || ')' END, CASE WHEN b THEN 'Node ' || device_id || ': High latency (' || latency || 'ms)' END,
  CASE WHEN c THEN 'Node ' || device_id || ': Elevated error rate (' || error_rate || '%)' END, CASE WHEN d THEN 'Node ' || device_id || ': Queue saturation (depth: ' || queue_depth || ')' END,
  CASE WHEN e THEN 'Node ' || device_id || ': Low throughput relative to IOPS' END], lambda x: x IS NOT NULL) AS issues"""
_ADVICE = """list_filter([CASE WHEN a THEN 'Scale out storage for node ' || device_id END, CASE WHEN b THEN 'Investigate network congestion on node ' || device_id END,
  CASE WHEN c THEN 'Check hardware health on node ' || device_id END, CASE WHEN d THEN 'Increase queue depth or reduce load on node ' || device_id END,
  CASE WHEN e THEN 'Optimize block size for node ' || device_id END], lambda x: x IS NOT NULL) AS advice"""
_RULES += f""",
txt AS (SELECT *, {_ISSUES}, {_ADVICE} FROM pts)"""
oracle("telemetry_rules", _RULES, "SELECT insight_id, points, array_to_string(issues, '; ') AS issues, array_to_string(advice, '; ') AS advice FROM txt")
oracle("rules_by_batch", _RULES, """SELECT batch_id, node_id, risk_score,
  CASE WHEN len(i) > 0 THEN 'Rules-based analysis detected ' || len(i) || ' issue(s): ' || array_to_string(i, '; ') ELSE 'All metrics within acceptable thresholds' END AS analysis,
  CASE WHEN len(a) > 0 THEN array_to_string(a, '; ') ELSE 'Continue monitoring' END AS recommendations
FROM (SELECT insight_id // 100 AS batch_id, arg_min(device_id, insight_id) AS node_id, CAST(least(sum(points), 100) AS INTEGER) AS risk_score,
  flatten(list(issues ORDER BY insight_id)) AS i, flatten(list(advice ORDER BY insight_id)) AS a FROM txt GROUP BY 1)""")
oracle("class_advice", TEL, """SELECT insight_id, [0, 33, 67, 100][lv + 1] AS score, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][lv + 1] AS label, CASE lv
  WHEN 3 THEN concat_ws('; ', 'CRITICAL: Immediate investigation required', CASE WHEN error_rate > 3 THEN 'Check for hardware failures or connectivity issues' END,
    CASE WHEN latency > 20 THEN 'Network congestion detected - investigate InfiniBand fabric' END, CASE WHEN iops > 120000 THEN 'Resource saturation - consider scaling or load balancing' END)
  WHEN 2 THEN concat_ws('; ', 'HIGH: Schedule maintenance window for investigation', CASE WHEN latency > 10 THEN 'Monitor latency trends - potential congestion building' END,
    CASE WHEN queue_depth > 64 THEN 'Queue depth approaching limits - review workload distribution' END)
  WHEN 1 THEN concat_ws('; ', 'MEDIUM: Monitor closely for trend changes', CASE WHEN iops > 80000 THEN 'IOPS trending high - prepare capacity plan' END)
  ELSE 'LOW: Continue normal monitoring' END AS advice FROM (SELECT *, queue_depth % 4 AS lv FROM tel)""")

# --- scoring --------------------------------------------------------------------------------------------------

_CONST_STUDENT = """0.3 sessions_weekend_ratio, 0.5 sessions_evening_ratio, 0 rating_trend, 0 rating_volatility, 60 avg_session_duration_min, 0 total_session_hours_30d,
50 engagement_score, 0 questions_asked_30d, 0 materials_accessed_30d, 1 payment_success_rate_30d, 0 payment_failures_30d, 50 avg_transaction_value, 0 total_revenue_30d,
1 payment_method_count, 7 days_since_last_payment, 0 cancellation_rate_7d, 0 cancellation_rate_30d, 0 no_show_rate_30d, 0 late_cancellations_30d, 24 avg_response_time_hours,
0 support_tickets_30d, 0 complaints_30d, 0.5 tutor_consistency_score, 1 unique_tutors_30d, 0.7 preferred_tutor_ratio, 4 tutor_rating_avg, 0.8 tutor_availability_score,
0.7 tutor_subject_expertise_score, 0.75 tutor_match_score, 0 tutor_changed_count_30d, 0.8 preferred_tutor_sessions_ratio"""
_CONST_TUTOR = """60 avg_session_duration_min, 0 no_show_rate, 0 cancellation_rate, 7 days_since_last_session, 0 rating_trend, 0 rating_volatility, 5 avg_student_lifetime_sessions,
20 available_hours_this_week, 20 available_hours_next_week, 1 instant_book_enabled, 2 avg_response_time_hours, 48 booking_lead_time_avg_hours, 1 primary_subject_count,
0.5 subject_diversity_score, 4.5 avg_rating_by_subject, 0.8 subject_match_accuracy, 2 certification_count, 3 years_of_experience, 0.7 specialization_score,
1 advanced_topics_count, 10 student_grade_improvement_avg, 1000 total_earnings_30d, 50 avg_earnings_per_session, 0 earnings_trend, 0.3 premium_tier_sessions_ratio,
0.1 discount_sessions_ratio, 0 payment_disputes_count_30d, 0 refund_rate_30d, 0.75 pricing_competitiveness_score, 25 revenue_per_available_hour"""


def _constants(text: str, without: list[str] | tuple = ()) -> str:
    pairs = [p.split() for p in text.replace("\n", " ").split(",")]
    return ", ".join(f"{value}::DOUBLE AS {name}" for value, name in pairs if name not in without)


oracle("student_features46", STUDENT + """,
tr AS (SELECT *, CASE WHEN sessions_14d > sessions_7d THEN sessions_7d - (sessions_14d - sessions_7d) ELSE 0 END::DOUBLE AS t1,
    CASE WHEN sessions_30d > sessions_14d THEN sessions_14d - (sessions_30d - sessions_14d) ELSE 0 END::DOUBLE AS t2 FROM stu)""", f"""
SELECT entity_id, 'student' AS entity_type, sessions_7d::DOUBLE AS sessions_7d, sessions_14d::DOUBLE AS sessions_14d, sessions_30d::DOUBLE AS sessions_30d,
  round(sessions_7d / 7.0::DOUBLE, 6) AS session_freq_7d, round(sessions_14d / 14.0::DOUBLE, 6) AS session_freq_14d, round(sessions_30d / 30.0::DOUBLE, 6) AS session_freq_30d,
  coalesce(days_since_last_session, 30)::DOUBLE AS days_since_last_session,
  round(CASE WHEN sessions_30d > 0 THEN 30.0::DOUBLE / sessions_30d ELSE 30.0 END, 6) AS avg_gap_between_sessions, t1 AS session_trend_7d_14d, t2 AS session_trend_14d_30d,
  t1 - t2 AS session_acceleration, round(avg_rating, 6) AS avg_rating, ib_calls_7d::DOUBLE AS ib_calls_7d, ib_calls_14d::DOUBLE AS ib_calls_14d,
  round(ib_calls_14d / 14.0::DOUBLE, 6) AS ib_call_rate, {_constants(_CONST_STUDENT)} FROM tr""")
_MORE_STUDENT = ("sessions_weekend_ratio sessions_evening_ratio rating_trend rating_volatility avg_session_duration_min total_session_hours_30d cancellation_rate_7d cancellation_rate_30d "
                 "no_show_rate_30d tutor_consistency_score unique_tutors_30d preferred_tutor_ratio tutor_rating_avg tutor_changed_count_30d preferred_tutor_sessions_ratio").split()
oracle("student_vector46", STUDENT + """,
hb AS (SELECT *, lag(tutor_id) OVER (PARTITION BY student_id ORDER BY ts, event_id) AS was, count(*) OVER (PARTITION BY student_id, tutor_id) AS mine
  FROM mkt WHERE event_type = 'session_completed' AND age >= 0 AND age < 30),
hp AS (SELECT student_id AS entity_id, avg((isodow(ts) >= 6)::INT) AS weekend, avg((hour(ts) >= 18)::INT) AS evening, avg(duration_min) AS minutes, sum(duration_min) / 60.0::DOUBLE AS hours,
  avg(nullif(rating, 0)) FILTER (age < 15) - avg(nullif(rating, 0)) FILTER (age >= 15) AS moved, stddev_samp(nullif(rating, 0)) AS volatility,
  count(*) FILTER (was_cancelled AND age < 7) / nullif(count(*) FILTER (age < 7), 0)::DOUBLE AS cancelled7, avg(was_cancelled::INT) AS cancelled, avg(no_show::INT) AS missed,
  count(DISTINCT tutor_id) AS tutors, max(mine) / count(*)::DOUBLE AS preferred, count(*) FILTER (was <> tutor_id) AS changed FROM hb GROUP BY student_id),
rec AS (SELECT * FROM mkt WHERE event_type = 'session_completed' QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, event_id DESC) <= 20),
bt AS (SELECT student_id, tutor_id, count(*) AS c, avg(nullif(rating, 0)) AS r FROM rec GROUP BY ALL),
pt AS (SELECT student_id AS entity_id, c / (sum(c) OVER (PARTITION BY student_id))::DOUBLE AS steady, r AS primary_rating FROM bt QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY c DESC, tutor_id) = 1),
tr AS (SELECT *, CASE WHEN sessions_14d > sessions_7d THEN sessions_7d - (sessions_14d - sessions_7d) ELSE 0 END::DOUBLE AS t1,
    CASE WHEN sessions_30d > sessions_14d THEN sessions_14d - (sessions_30d - sessions_14d) ELSE 0 END::DOUBLE AS t2 FROM stu LEFT JOIN hp USING (entity_id) LEFT JOIN pt USING (entity_id))""", f"""
SELECT entity_id, 'student' AS entity_type, sessions_7d::DOUBLE AS sessions_7d, sessions_14d::DOUBLE AS sessions_14d, sessions_30d::DOUBLE AS sessions_30d,
  round(sessions_7d / 7.0::DOUBLE, 6) AS session_freq_7d, round(sessions_14d / 14.0::DOUBLE, 6) AS session_freq_14d, round(sessions_30d / 30.0::DOUBLE, 6) AS session_freq_30d,
  coalesce(days_since_last_session, 30)::DOUBLE AS days_since_last_session,
  round(CASE WHEN sessions_30d > 0 THEN 30.0::DOUBLE / sessions_30d ELSE 30.0 END, 6) AS avg_gap_between_sessions, t1 AS session_trend_7d_14d, t2 AS session_trend_14d_30d,
  t1 - t2 AS session_acceleration, round(avg_rating, 6) AS avg_rating, ib_calls_7d::DOUBLE AS ib_calls_7d, ib_calls_14d::DOUBLE AS ib_calls_14d,
  round(ib_calls_14d / 14.0::DOUBLE, 6) AS ib_call_rate, round(coalesce(weekend, 0.3), 6) AS sessions_weekend_ratio, round(coalesce(evening, 0.5), 6) AS sessions_evening_ratio,
  round(coalesce(moved, 0), 6) AS rating_trend, round(coalesce(volatility, 0), 6) AS rating_volatility, round(coalesce(minutes, 60), 6) AS avg_session_duration_min, round(coalesce(hours, 0), 6) AS total_session_hours_30d,
  round(coalesce(cancelled7, 0), 6) AS cancellation_rate_7d, round(coalesce(cancelled, 0), 6) AS cancellation_rate_30d, round(coalesce(missed, 0), 6) AS no_show_rate_30d,
  round(coalesce(steady, 0.5), 6) AS tutor_consistency_score, coalesce(tutors, 1)::DOUBLE AS unique_tutors_30d, round(coalesce(preferred, 0.7), 6) AS preferred_tutor_ratio,
  round(coalesce(primary_rating, 4), 6) AS tutor_rating_avg, coalesce(changed, 0)::DOUBLE AS tutor_changed_count_30d, round(coalesce(preferred, 0.8), 6) AS preferred_tutor_sessions_ratio,
  {_constants(_CONST_STUDENT, _MORE_STUDENT)} FROM tr""")
_MORE_TUTOR = ("avg_session_duration_min no_show_rate cancellation_rate days_since_last_session rating_trend rating_volatility avg_student_lifetime_sessions available_hours_this_week instant_book_enabled "
               "primary_subject_count subject_diversity_score avg_rating_by_subject specialization_score total_earnings_30d avg_earnings_per_session earnings_trend revenue_per_available_hour").split()
oracle("tutor_vector46", EARNED + """,
tsb AS (SELECT tutor_id, subject, count(*) AS c, avg(nullif(rating, 0)) AS mean FROM tin WHERE event_type = 'session_completed' GROUP BY ALL),
trt AS (SELECT tutor_id, avg(mean) AS by_subject, 1 - sum(c * c) / (sum(c) * sum(c))::DOUBLE AS diversity FROM tsb GROUP BY tutor_id),
ttr AS (SELECT tutor_id, avg(nullif(rating, 0)) FILTER (age < 15) - avg(nullif(rating, 0)) FILTER (age >= 15) AS moved FROM tin WHERE event_type = 'session_completed' GROUP BY tutor_id),
tv AS (SELECT * FROM tut LEFT JOIN trt USING (tutor_id) LEFT JOIN ttr USING (tutor_id) LEFT JOIN earn USING (tutor_id))""", f"""
SELECT CAST(tutor_id AS VARCHAR) AS entity_id, 'tutor' AS entity_type, t7::DOUBLE AS sessions_taught_7d, t14::DOUBLE AS sessions_taught_14d, t30::DOUBLE AS sessions_taught_30d,
  c7::DOUBLE AS sessions_completed_7d, cc14::DOUBLE AS sessions_completed_14d, cc30::DOUBLE AS sessions_completed_30d,
  round(coalesce(completion_rate, 0.95), 6) AS session_completion_rate, round(t7 / 7.0::DOUBLE, 6) AS session_frequency_7d, round(t14 / 14.0::DOUBLE, 6) AS session_frequency_14d,
  round(coalesce(mean_rating, 4.5), 6) AS avg_rating, coalesce(positive_reviews, 0)::DOUBLE AS positive_reviews_count_30d, coalesce(negative_reviews, 0)::DOUBLE AS negative_reviews_count_30d,
  round(coalesce(retention_rate, 0.7), 6) AS student_retention_rate, coalesce(unique_students, 10)::DOUBLE AS unique_students_30d,
  round(coalesce(utilization_rate, 0.6), 6) AS utilization_rate, round(coalesce(sessions_per_subject, 10), 6) AS sessions_per_subject_30d, round(coalesce(booked_minutes / nullif(sessions_completed, 0)::DOUBLE, 60), 6) AS avg_session_duration_min, round(coalesce(no_shows / nullif(sessions_completed, 0)::DOUBLE, 0), 6) AS no_show_rate,
  round(coalesce(cancelled / nullif(sessions_completed, 0)::DOUBLE, 0), 6) AS cancellation_rate, CASE WHEN sessions_started IS NULL THEN 7 ELSE coalesce(days, 999) END::DOUBLE AS days_since_last_session,
  round(coalesce(moved, 0), 6) AS rating_trend, round(coalesce(volatility, 0), 6) AS rating_volatility, round(coalesce(sessions_completed / nullif(unique_students, 0)::DOUBLE, 5), 6) AS avg_student_lifetime_sessions,
  coalesce(hours, 20)::DOUBLE AS available_hours_this_week, coalesce(instant::INT, 1)::DOUBLE AS instant_book_enabled, coalesce(subjects, 1)::DOUBLE AS primary_subject_count, round(coalesce(diversity, 0.5), 6) AS subject_diversity_score,
  round(coalesce(by_subject, 4.5), 6) AS avg_rating_by_subject, round(coalesce(specialization, 0.7), 6) AS specialization_score, round(coalesce(total, 1000), 6) AS total_earnings_30d,
  round(coalesce(total / paid, 50), 6) AS avg_earnings_per_session, CASE trend WHEN 'growing' THEN 1 WHEN 'declining' THEN -1 ELSE 0 END::DOUBLE AS earnings_trend,
  round(coalesce(total / nullif(hours, 0), 25), 6) AS revenue_per_available_hour, {_constants(_CONST_TUTOR, _MORE_TUTOR)} FROM tv""")
oracle("rules_risk", STUDENT, """SELECT entity_id, CAST(least(floor((100 - health_score) * 0.5::DOUBLE + least(ib_calls_14d * 5, 30) + greatest(5 - sessions_7d, 0) * 4 + 0.5::DOUBLE), 100) AS INTEGER) AS risk_score,
  CASE WHEN health_score < 50 THEN 'critical' WHEN health_score < 70 THEN 'warning' ELSE 'normal' END AS severity FROM stu""")
oracle("segments", SCORED, """SELECT entity_id, entity_type, round(c14, 6) AS churn_risk_14d, round(c30, 6) AS churn_risk_30d, round(health_score, 6) AS health_score, segment FROM scored""")
oracle("refresh_twice", STUDENT + """,
tw AS (SELECT *, 0.75::DOUBLE * least(1.0, ib_calls_14d / 10.0::DOUBLE) AS c14, least(1.0, ib_calls_14d / 8.0::DOUBLE) AS c30 FROM stu)""", """
SELECT entity_id, sessions_30d, round_even(c14, 4)::DOUBLE AS churn_risk_14d, round_even(c30, 4)::DOUBLE AS churn_risk_30d, CASE WHEN c14 > 0.7::DOUBLE OR health_score < 40 THEN 'churned'
  WHEN c14 > 0.4::DOUBLE OR c30 > 0.6::DOUBLE OR health_score < 60 THEN 'at_risk' WHEN c14 < 0.2::DOUBLE AND health_score > 80 THEN 'thriving' ELSE 'healthy' END AS segment,
  TIMESTAMP '2024-01-31' AS prediction_timestamp FROM tw""")
oracle("segment_counts", SCORED, "SELECT entity_type, " + ", ".join(f"count(*) FILTER (segment = '{s}') AS {s}" for s in ("thriving", "healthy", "at_risk", "churned", "star", "churning")) + " FROM scored GROUP BY entity_type")
_PK = """SELECT count(*) AS total_processed, count(*) FILTER (c14 > 0.7::DOUBLE) AS high_churn_count, round(avg(c14), 6) AS avg_churn_risk_14d, round(avg(health_score), 6) AS avg_health_score,
  count(*) FILTER (segment = 'thriving') AS thriving, count(*) FILTER (segment = 'at_risk') AS at_risk, count(*) FILTER (segment = 'churned') AS churned FROM scored"""
oracle("prediction_kpis", SCORED, _PK)
oracle("metric_points", SCORED + f", pk AS ({_PK})", " UNION ALL ".join(
    f"SELECT '{n}' AS metric_name, {c}::DOUBLE AS value, '{u}' AS unit, TIMESTAMP '2024-01-31 00:00:00' AS \"timestamp\" FROM pk" for n, c, u in (
        ("TotalCustomersProcessed", "total_processed", "Count"), ("HighChurnRiskCount", "high_churn_count", "Count"), ("AverageChurnRisk14d", "avg_churn_risk_14d", "None"),
        ("AverageHealthScore", "avg_health_score", "None"), ("ThrivingCustomers", "thriving", "Count"), ("AtRiskCustomers", "at_risk", "Count"), ("ChurnedCustomers", "churned", "Count"))))
_ADVICE = """list_filter(CASE WHEN entity_type = 'tutor' THEN [
    CASE WHEN c14 > 0.6::DOUBLE THEN '⚠️ HIGH BURNOUT RISK: Schedule wellness check-in within 48 hours' END,
    CASE WHEN coalesce(utilization_rate, 0) > 0.9::DOUBLE THEN 'High utilization - suggest reducing hours or adding breaks' END,
    CASE WHEN avg_rating < 4 THEN 'Low ratings detected - provide coaching or additional training' END,
    CASE WHEN velocity < 0.5::DOUBLE THEN 'Low booking rate - increase visibility or marketing support' END,
    CASE WHEN coalesce(retention, 1) < 0.5::DOUBLE THEN 'Low student retention - review teaching style and student feedback' END,
    CASE WHEN segment = 'star' THEN '✅ Star tutor - consider featuring in marketplace or bonus incentives' END]
  ELSE [CASE WHEN c14 > 0.6::DOUBLE THEN '⚠️ HIGH CHURN RISK: Schedule proactive check-in call within 48 hours' END,
    CASE WHEN c14 > 0.6::DOUBLE AND sessions_7d = 0 THEN 'No sessions in 7 days - send re-engagement campaign' END,
    CASE WHEN c14 > 0.6::DOUBLE AND ib_calls_14d >= 2 THEN 'Multiple IB calls detected - assign dedicated account manager' END,
    CASE WHEN velocity < 0.5::DOUBLE AND segment <> 'churned' THEN 'Low session frequency - offer scheduling assistance or flexible hours' END,
    CASE WHEN success < 0.5::DOUBLE THEN 'Low first session success probability - provide onboarding support' END,
    CASE WHEN segment = 'thriving' THEN '✅ Thriving customer - consider upsell or referral program' END] END, lambda x: x IS NOT NULL)[1:5]"""
oracle("recommendations", SCORED, f"SELECT entity_id, entity_type, coalesce(array_to_string({_ADVICE}, ' | '), '') AS recommendations FROM scored")
oracle("generate_insights", SCORED + f""",
g AS (SELECT *, greatest(c14, c30) AS churn, printf('%.2f', velocity) AS rate, printf('%.0f', round_even(health_score, 0)) AS hs, array_to_string(({_ADVICE})[1:3], '; ') AS n_rec FROM scored),
items AS (
  SELECT entity_id, entity_type, 1 AS o, 'churn_risk' AS t, CAST(trunc(churn * 100) AS INTEGER) AS risk, 'Student shows ' || CAST(trunc(churn * 100) AS INTEGER) || '% churn probability. '
    || CASE WHEN c14 > 0.5::DOUBLE THEN 'High risk of churning within 14 days. ' WHEN c30 > 0.5::DOUBLE THEN 'Elevated risk of churning within 30 days. ' ELSE '' END
    || 'Session velocity: ' || rate || '/week, Health score: ' || hs || '/100.' AS x, 0.85 AS conf, n_rec FROM g WHERE churn > 0.3::DOUBLE
  UNION ALL SELECT entity_id, entity_type, 2, 'customer_health', CAST(trunc(100 - health_score) AS INTEGER), 'Overall health score of ' || hs || '/100 indicates ' || segment || ' status. Session frequency: ' || rate || '/week. '
    || CASE WHEN avg_rating < 4 THEN 'Low satisfaction ratings detected. ' ELSE '' END, 0.88, n_rec FROM g WHERE health_score < 70
  UNION ALL SELECT entity_id, entity_type, 3, 'session_quality', CAST(least(trunc((0.5::DOUBLE - velocity) * 200), 100) AS INTEGER), 'Low session booking rate of ' || rate || ' sessions/week. Last session '
    || coalesce(days_since_last_session, 0) || ' days ago. ', 0.82, n_rec FROM g WHERE velocity < 0.5::DOUBLE
  UNION ALL SELECT entity_id, entity_type, 4, 'first_session_success', CAST(trunc((1 - success) * 100) AS INTEGER), 'First session success probability: ' || printf('%.0f', round_even(success * 100, 0))
    || '%. Student may need additional onboarding support or tutor matching optimization.', 0.79, n_rec FROM g WHERE success < 0.6::DOUBLE
  UNION ALL SELECT entity_id, entity_type, 5, 'tutor_capacity', 100 - CAST(least(trunc(velocity * 20), 100) AS INTEGER), 'Current session velocity: ' || rate || '/week. '
    || CASE WHEN velocity > 2 THEN 'High engagement - ensure tutor availability matches demand.' WHEN velocity < 0.5::DOUBLE THEN 'Low engagement - may need tutor outreach or scheduling flexibility.'
      ELSE 'Moderate engagement - monitor for changes.' END, 0.75, n_rec FROM g
  UNION ALL SELECT entity_id, entity_type, 6, 'marketplace_balance', 100 - CAST(trunc(health_score) AS INTEGER), 'Student health: ' || hs || '/100, Segment: ' || segment || '. Churn risk: '
    || printf('%.0f', round_even(churn * 100, 0)) || '%, Session velocity: ' || rate || '/week.', 0.80, n_rec FROM g)""", """
SELECT entity_id AS related_entity, t AS prediction_type, risk AS risk_score, x AS explanation, conf::DOUBLE AS confidence,
  TIMESTAMP '2024-01-31 00:00:00' + (row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY o) - 1) * INTERVAL 100 MILLISECOND AS "timestamp",
  1706659200 + 30 * 86400 AS ttl, n_rec AS recommendations FROM items""")
oracle("stored_predictions", SCORED, """
SELECT entity_id, entity_type, last_updated, round_even(health_score, 2) AS health_score, round_even(c14, 4) AS churn_risk_14d,
  round_even(c30, 4) AS churn_risk_30d, round_even(success, 4) AS first_session_success_prob,
  round_even(velocity, 4) AS session_velocity, segment AS segment, 'health-v1' AS model_version FROM scored""")
_FB = """,
fb AS (SELECT metric_id, utilization > 90 AS busy, round(latency_p99 - lat_b, 4) > lat_b * 0.5::DOUBLE AS slow, utilization, round(latency_p99 - lat_b, 4) AS ld FROM delta),
fbi AS (SELECT metric_id, CASE WHEN busy THEN 'resource_saturation' WHEN slow THEN 'performance_degradation' ELSE 'anomaly_detected' END AS pt, CASE WHEN busy THEN 85 WHEN slow THEN 70 ELSE 50 END AS risk,
    CASE WHEN busy THEN 'Port utilization at ' || utilization || '% (fallback analysis)' WHEN slow THEN 'Latency increased by ' || ld || 'μs (fallback analysis)'
      ELSE 'Anomaly detected, AI analysis unavailable (fallback)' END AS x, busy, slow FROM fb)"""
oracle("fallback_insight", STR + _FB, """SELECT metric_id, pt AS prediction_type, risk AS risk_score, CASE WHEN busy THEN 'Scale workload; Check for hot spots'
  WHEN slow THEN 'Check network topology; Review switch configs' ELSE 'Manual investigation required' END AS recommendations,
  CASE WHEN busy OR slow THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence, x AS explanation FROM fbi""")
oracle("scorer_compare", LABEL + _FB, """SELECT count(*) AS comparisons, count(*) FILTER (prediction_type = pt) AS matches, round(count(*) FILTER (prediction_type = pt) / count(*)::DOUBLE * 100, 6) AS match_pct,
  round(avg(abs(risk_score - risk)), 6) AS avg_risk_delta, CASE WHEN avg(abs(risk_score - risk)) > 10 THEN 'MORE' ELSE 'SIMILARLY' END AS sensitivity FROM lab JOIN fbi USING (metric_id)""")
oracle("source_mix", LABEL, """SELECT CASE metric_id % 3 WHEN 0 THEN 'primary-model' WHEN 1 THEN 'second-model' ELSE 'rules-based' END AS source, count(*) AS n,
  round(count(*) / (SELECT count(*) FROM lab)::DOUBLE, 6) AS share FROM lab GROUP BY 1""")
oracle("response_parse", BASE, """
SELECT event_id, CASE WHEN k % 5 = 2 THEN 'unknown' WHEN k % 5 <> 3 THEN event_type END AS prediction_type, CASE k % 5 WHEN 2 THEN 50.0 WHEN 3 THEN 12.0 ELSE k END::DOUBLE AS risk_score,
  CASE k % 5 WHEN 2 THEN 'no json at all' WHEN 3 THEN '' ELSE 'user ' || user_id END AS explanation,
  CASE k % 5 WHEN 2 THEN 'Review metric manually' WHEN 3 THEN NULL ELSE 'a,b' END AS recommendations, CASE k % 5 WHEN 2 THEN 0.5 WHEN 3 THEN NULL ELSE 0.9 END::DOUBLE AS confidence,
  k % 5 <> 3 AS usable FROM ev""")
oracle("model_response_parse", BASE, """
SELECT event_id, CASE k % 3 WHEN 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS first_session_success, CASE WHEN k % 3 = 2 THEN 0 ELSE k END::DOUBLE AS session_velocity,
  CASE k % 3 WHEN 1 THEN 0.1 ELSE 0.5 END::DOUBLE AS churn_risk_14d, CASE k % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.2 ELSE 0.5 END::DOUBLE AS churn_risk_30d,
  CASE WHEN k % 3 = 2 THEN 50 ELSE k END::DOUBLE AS health_score FROM ev""")

# --- alerts ---------------------------------------------------------------------------------------------------

_SEV = "CASE WHEN health_score < 50 THEN 'critical' ELSE 'warning' END"
_FOUND = STUDENT + f""",
found AS (
  SELECT 'high_ib_call_frequency' AS alert_type, 'warning' AS severity, CAST(entity_id AS VARCHAR) AS entity_id, 'student' AS entity_type,
    'Student ' || entity_id || ' has ' || ib_calls_14d || ' IB calls in 14 days' AS message, TIMESTAMP '2024-01-31 00:00:00' AS "timestamp",
    ['ib_calls_14d: ' || ib_calls_14d, 'health_score: ' || health_score] AS d FROM stu WHERE ib_calls_14d >= 3
  UNION ALL SELECT 'low_health_score', {_SEV}, CAST(entity_id AS VARCHAR), 'student', 'Student ' || entity_id || ' has low health score: ' || health_score, TIMESTAMP '2024-01-31 00:00:00',
    ['health_score: ' || health_score, 'sessions_7d: ' || sessions_7d, 'ib_calls_14d: ' || ib_calls_14d] FROM stu WHERE health_score < 70
  UNION ALL SELECT 'supply_demand_imbalance', 'info', subject, 'subject', 'High demand detected for ' || subject || ' (Demand: ' || demand_score || ', Supply: ' || supply_score || ')', ts,
    ['balance_status: ' || balance_status, 'demand_score: ' || demand_score, 'supply_score: ' || supply_score] FROM mkt WHERE balance_status = 'high_demand')"""
oracle("detect_anomalies", _FOUND, "SELECT * EXCLUDE (d), array_to_string(d, '; ') AS details FROM found")
oracle("alerts_after_events", MKT + """,
cu AS (SELECT *, count(*) FILTER (event_type IN ('session_started', 'session_completed')) OVER w AS cs, count(*) FILTER (event_type = 'ib_call_logged') OVER w AS cc,
    last_value(health_score IGNORE NULLS) OVER w AS h FROM mkt WINDOW w AS (PARTITION BY student_id ORDER BY ts, event_id)),
sn AS (SELECT *, cs + coalesce(last_value(sessions_last_7_days - cs IGNORE NULLS) OVER w, 0) AS s7, cc + coalesce(last_value(ib_calls_last_14_days - cc IGNORE NULLS) OVER w, 0) AS c14,
    coalesce(h, 100.0::DOUBLE) AS hs FROM cu WINDOW w AS (PARTITION BY student_id ORDER BY ts, event_id))""", """
SELECT event_id, 'high_ib_call_frequency' AS alert_type, 'warning' AS severity, CAST(student_id AS VARCHAR) AS entity_id, 'student' AS entity_type,
  'ib_calls_14d: ' || c14 || '; health_score: ' || hs AS details, 'Student ' || student_id || ' has ' || c14 || ' IB calls in 14 days' AS message, ts AS "timestamp" FROM sn WHERE c14 >= 3
UNION ALL SELECT event_id, 'low_health_score', CASE WHEN hs < 50 THEN 'critical' ELSE 'warning' END, CAST(student_id AS VARCHAR), 'student',
  'health_score: ' || hs || '; sessions_7d: ' || s7 || '; ib_calls_14d: ' || c14, 'Student ' || student_id || ' has low health score: ' || hs, ts FROM sn WHERE hs < 70
UNION ALL SELECT event_id, 'supply_demand_imbalance', 'info', subject, 'subject', 'balance_status: ' || balance_status || '; demand_score: ' || demand_score || '; supply_score: ' || supply_score,
  'High demand detected for ' || subject || ' (Demand: ' || demand_score || ', Supply: ' || supply_score || ')', ts FROM mkt WHERE balance_status = 'high_demand'""")
oracle("prediction_alerts", SCORED + """, sp AS (SELECT * FROM scored)""", """
SELECT entity_id, entity_type, 'IB_CALL_SPIKE' AS alert_type, 'CRITICAL' AS severity, 'Assign retention specialist within 24 hours' AS recommendation FROM sp WHERE ib_calls_14d >= 2
UNION ALL SELECT entity_id, entity_type, 'HIGH_CHURN_RISK', 'HIGH', 'Offer discount or free session credit' FROM sp WHERE c30 > 0.6::DOUBLE
UNION ALL SELECT entity_id, entity_type, 'HEALTH_SCORE_CRITICAL', 'HIGH', 'Proactive outreach + personalized recovery plan' FROM sp WHERE health_score < 40
UNION ALL SELECT entity_id, entity_type, 'FIRST_SESSION_RISK', 'MEDIUM', 'Match with top-rated tutor (>4.5 stars)' FROM sp WHERE success < 0.5::DOUBLE
UNION ALL SELECT entity_id, entity_type, 'SESSION_VELOCITY_DROP', 'MEDIUM', 'Send re-engagement email campaign' FROM sp WHERE velocity < 1 AND sessions_30d / 30.0::DOUBLE * 7 > 2""")
oracle("threshold_alerts", SCORED + """, sp AS (SELECT * FROM scored)""", """
SELECT entity_id, entity_type, 'churn_risk_ib_calls' AS alert_type, 'critical' AS severity FROM sp WHERE c14 > 0.7::DOUBLE
UNION ALL SELECT entity_id, entity_type, 'churn_risk_high', 'high' FROM sp WHERE c30 > 0.6::DOUBLE
UNION ALL SELECT entity_id, entity_type, 'health_score_critical', 'high' FROM sp WHERE health_score < 40""")
oracle("alert_render", _FOUND, """SELECT alert_type, entity_id, "timestamp", CASE severity WHEN 'critical' THEN '🚨' WHEN 'warning' THEN '⚠️' ELSE 'ℹ️' END || ' ' || upper(severity) || ': ' || alert_type AS subject,
  concat_ws(chr(10), repeat('━', 40), CASE severity WHEN 'critical' THEN '🚨' WHEN 'warning' THEN '⚠️' ELSE 'ℹ️' END || ' Severity: ' || upper(severity), '📋 Alert Type: ' || alert_type,
    '🆔 Entity: ' || entity_id || ' (' || entity_type || ')', '⏰ Timestamp: ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S'), repeat('━', 40), '📄 Summary:', message,
    '📊 Details:', array_to_string(list_transform(d, lambda x: '  • ' || x), chr(10)), repeat('━', 40)) AS body FROM found""")
oracle("alerts_dedup_gap", ALERTS, """SELECT alert_no, coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY alert_type, entity_id ORDER BY "timestamp", alert_no) >= INTERVAL 1 HOUR, true) AS is_new FROM al""")
oracle("alerts_dedup_cooldown", ALERTS + """,
num AS (SELECT *, row_number() OVER (PARTITION BY alert_type, entity_id ORDER BY "timestamp", alert_no) AS n FROM al),
f(alert_type, entity_id, n, last, alert_no, sent) AS (
  SELECT alert_type, entity_id, n, "timestamp", alert_no, true FROM num WHERE n = 1
  UNION ALL SELECT f.alert_type, f.entity_id, num.n, CASE WHEN num."timestamp" - f.last >= INTERVAL 1 HOUR THEN num."timestamp" ELSE f.last END, num.alert_no,
    num."timestamp" - f.last >= INTERVAL 1 HOUR FROM f JOIN num ON num.alert_type = f.alert_type AND num.entity_id = f.entity_id AND num.n = f.n + 1)""",
       """SELECT al.alert_no, al.alert_type, al.entity_id, al."timestamp" FROM f JOIN al USING (alert_no) WHERE sent""", recursive=True)
oracle("alert_severity", ALERTS, "SELECT severity, count(*) AS n FROM al GROUP BY 1")
oracle("alert_delivery", ALERTS, """SELECT count(*) AS total, count(*) FILTER (alert_no % 50 <> 0) AS delivered, round(count(*) FILTER (alert_no % 50 <> 0) / count(*)::DOUBLE * 100, 6) AS success_pct FROM al""")
oracle("alert_batch", ALERTS + """,
nb AS (SELECT *, date_trunc('day', "timestamp")::TIMESTAMP AS period, CAST((row_number() OVER (PARTITION BY entity_id, date_trunc('day', "timestamp") ORDER BY "timestamp", alert_no) - 1) // 10 AS INTEGER) AS part FROM al)""",
       """SELECT entity_id, period, part, count(*) AS alert_count, string_agg(CAST(alert_no AS VARCHAR), ',' ORDER BY "timestamp", alert_no) AS alert_nos FROM nb GROUP BY ALL""")
oracle("alert_digest", ALERTS, """SELECT date_trunc('hour', "timestamp") AS period, severity, count(*) AS n FROM al GROUP BY ALL""")
oracle("alarm_eval", BASE + """,
rules(alarm, metric, statistic, secs, op, threshold, periods) AS (VALUES ('errors-high', 'error', 'Sum', 3600, '>', 100.0, 2), ('errors-max', 'error', 'Maximum', 300, '>=', 90.0, 1),
  ('views-low', 'view', 'Average', 900, '<', 20.0, 2), ('clicks-high', 'click', 'Sum', 3600, '>', 60.0, 3)),
spine AS (SELECT *, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31' - secs * INTERVAL 1 SECOND, secs * INTERVAL 1 SECOND)) AS p FROM rules),
stat AS (SELECT alarm, TIMESTAMP '1970-01-01' + (epoch_us(ts) // (secs::BIGINT * 1000000)) * secs * INTERVAL 1 SECOND AS p, sum(value) AS s, avg(value) AS a, max(value) AS m
  FROM ev JOIN rules ON event_type = metric GROUP BY ALL),
br AS (SELECT spine.*, CASE statistic WHEN 'Sum' THEN s WHEN 'Average' THEN a ELSE m END AS v FROM spine LEFT JOIN stat ON spine.alarm = stat.alarm AND spine.p = stat.p),
bb AS (SELECT *, coalesce(CASE op WHEN '>' THEN v > threshold WHEN '>=' THEN v >= threshold ELSE v < threshold END, false) AS breach FROM br)""", """
SELECT alarm, p AS period_start, round(v, 9) AS value, breach, CASE periods
  WHEN 1 THEN breach WHEN 2 THEN sum(breach::INT) OVER (PARTITION BY alarm ORDER BY p ROWS 1 PRECEDING) = 2
  ELSE sum(breach::INT) OVER (PARTITION BY alarm ORDER BY p ROWS 2 PRECEDING) = 3 END AS in_alarm FROM bb""")
_ALARM_EVAL = ORACLES["alarm_eval"]
ORACLES["stream_alarm_states"] = f"""WITH evaluated AS ({_ALARM_EVAL})
SELECT evaluated.* FROM evaluated JOIN (VALUES ('errors-high', 3600), ('errors-max', 300), ('views-low', 900), ('clicks-high', 3600)) AS w(alarm, secs) USING (alarm)
WHERE period_start + secs * INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""".replace("SELECT evaluated.*", "SELECT alarm, period_start, value, breach, in_alarm")
oracle("alarms_on_metrics", RAW + """,
cu AS (SELECT *, count(*) FILTER (event_type = 'ib_call_logged') OVER w AS cc, last_value(health_score IGNORE NULLS) OVER w AS h FROM mkt
  WHERE event_type IN ('session_started', 'session_completed', 'ib_call_logged', 'customer_health_update') WINDOW w AS (PARTITION BY student_id ORDER BY ts, event_id)),
sn AS (SELECT student_id, ts, event_id, cc + coalesce(last_value(ib_calls_last_14_days - cc IGNORE NULLS) OVER w, 0) AS c14, coalesce(h, 100.0::DOUBLE) AS hs
  FROM cu WINDOW w AS (PARTITION BY student_id ORDER BY ts, event_id)),
la AS (SELECT student_id, time_bucket(INTERVAL 5 MINUTE, ts) AS p, arg_max(struct_pack(c := c14, h := hs), (ts, event_id)) AS s FROM sn GROUP BY ALL),
fl AS (SELECT student_id, p, CASE WHEN least(1.0, s.c / 10.0::DOUBLE) > 0.7::DOUBLE THEN 1 ELSE 0 END AS churn, s.h AS h,
  CASE WHEN least(1.0, s.c / 10.0::DOUBLE) > 0.7::DOUBLE OR s.h < 40 THEN 0 WHEN least(1.0, s.c / 10.0::DOUBLE) > 0.4::DOUBLE OR least(1.0, s.c / 8.0::DOUBLE) > 0.6::DOUBLE OR s.h < 60 THEN 1 ELSE 0 END AS risk FROM la),
ch AS (SELECT p, churn - lag(churn, 1, 0) OVER w AS churn, h - lag(h, 1, 0.0) OVER w AS h, risk - lag(risk, 1, 0) OVER w AS risk, CASE WHEN lag(p) OVER w IS NULL THEN 1 ELSE 0 END AS n
  FROM fl WINDOW w AS (PARTITION BY student_id ORDER BY p)),
lv AS (SELECT p, sum(sum(churn)) OVER o AS churn, sum(sum(h)) OVER o / sum(sum(n)) OVER o AS h, sum(sum(risk)) OVER o AS risk FROM ch GROUP BY p WINDOW o AS (ORDER BY p)),
pt AS (SELECT 'HighChurnRiskCount' AS metric, p, churn::DOUBLE AS x FROM lv UNION ALL SELECT 'AverageHealthScore', p, h FROM lv UNION ALL SELECT 'AtRiskCustomers', p, risk FROM lv
  UNION ALL SELECT 'malformed_rate', time_bucket(INTERVAL 5 MINUTE, ts), count(*) FILTER (n_critical + n_error > 0) / count(*)::DOUBLE * 100 FROM val GROUP BY 2),
rules(alarm, metric, statistic, secs, op, threshold, periods) AS (VALUES
  -- fixed values
  ('ingest-errors', 'ingest_errors', 'Sum', 300, '>', 50.0, 2), ('ingest-throttles', 'ingest_throttles', 'Sum', 300, '>', 10.0, 1), ('ai-errors', 'ai_errors', 'Sum', 300, '>', 5.0, 2),
  ('high-churn-rate', 'HighChurnRiskCount', 'Maximum', 300, '>=', 10.0, 2), ('low-health-average', 'AverageHealthScore', 'Average', 900, '<', 60.0, 2),
  ('at-risk-customers', 'AtRiskCustomers', 'Maximum', 900, '>=', 50.0, 1), ('store-read-capacity', 'read_capacity', 'Sum', 300, '>', 10000.0, 3),
  ('store-write-capacity', 'write_capacity', 'Sum', 300, '>', 5000.0, 3), ('api-4xx', 'api_4xx', 'Sum', 300, '>', 100.0, 2), ('api-5xx', 'api_5xx', 'Sum', 300, '>', 10.0, 2),
  ('ingest-duration', 'ingest_duration_ms', 'Average', 300, '>', 5000.0, 3), ('iterator-age', 'iterator_age_ms', 'Maximum', 60, '>', 60000.0, 2),
  ('write-throughput', 'write_throughput_exceeded', 'Sum', 300, '>', 10.0, 1), ('stream-processor-errors', 'stream_processor_errors', 'Sum', 300, '>', 10.0, 2),
  ('malformed-rate', 'malformed_rate', 'Average', 300, '>', 5.0, 2)),
spine AS (SELECT *, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31' - secs * INTERVAL 1 SECOND, secs * INTERVAL 1 SECOND)) AS p FROM rules),
stat AS (SELECT alarm, TIMESTAMP '1970-01-01' + (epoch_us(pt.p) // (secs::BIGINT * 1000000)) * secs * INTERVAL 1 SECOND AS p, sum(x) AS s, avg(x) AS a, max(x) AS m FROM pt JOIN rules USING (metric) GROUP BY ALL),
br AS (SELECT spine.*, CASE statistic WHEN 'Sum' THEN s WHEN 'Average' THEN a ELSE m END AS v FROM spine LEFT JOIN stat ON spine.alarm = stat.alarm AND spine.p = stat.p),
bb AS (SELECT *, coalesce(CASE op WHEN '>' THEN v > threshold WHEN '>=' THEN v >= threshold ELSE v < threshold END, false) AS breach FROM br)""", """
SELECT alarm, p AS period_start, round(v, 6) AS value, breach, CASE periods
  WHEN 1 THEN breach WHEN 2 THEN sum(breach::INT) OVER (PARTITION BY alarm ORDER BY p ROWS 1 PRECEDING) = 2
  ELSE sum(breach::INT) OVER (PARTITION BY alarm ORDER BY p ROWS 2 PRECEDING) = 3 END AS in_alarm FROM bb""")


def _ranks(source: str, group: str, value: str, offset: int, where: str = "true") -> str:
    pick = lambda p: f"max({value}) FILTER (r = CAST(floor(n * {p}::DOUBLE) AS BIGINT) + {offset})"
    return f"""SELECT {group}, %s{pick(0.5)} AS p50, {pick(0.95)} AS p95, {pick(0.99)} AS p99 FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {where}) GROUP BY {group}"""


_REQ = BASE + """, req AS (SELECT event_type AS operation, value AS duration, CASE WHEN event_id % 40 = 0 THEN 500 WHEN event_id % 25 = 0 THEN 404 ELSE 200 END AS status FROM ev)"""
_BASIC = "count(*) AS count, min({v}) AS min, max({v}) AS max, round(avg({v}), {d}) AS avg, "
oracle("latency_stats", _REQ, _ranks("req", "operation", "duration", 1) % _BASIC.format(v="duration", d=6))
oracle("latency_stats_ok", _REQ, _ranks("req", "operation", "duration", 0, "status = 200") % "count(*) AS n, ")
oracle("latency_stats_lineitem", BASE, _ranks("lineitem", "l_returnflag", "l_extendedprice", 1) % _BASIC.format(v="l_extendedprice", d=4))
oracle("request_rates", _REQ, """SELECT operation, count(*) AS total, count(*) FILTER (status = 200) AS success, count(*) FILTER (status <> 200) AS failed,
  round(count(*) FILTER (status = 200) / count(*)::DOUBLE * 100, 6) AS success_pct, round(count(*) FILTER (status >= 400) / count(*)::DOUBLE * 100, 6) AS error_pct FROM req GROUP BY 1""")
_SKEW = "SELECT count(*) AS keys, round(avg(c), 4) AS mean_rows, max(c) AS max_rows, round(var_pop(c), 4) AS variance FROM (SELECT count(*) AS c FROM {t} GROUP BY {k})"
oracle("partition_skew", MKT, _SKEW.format(t="mkt", k="event_type"))
oracle("partition_skew_orders", BASE, _SKEW.format(t="lineitem", k="l_suppkey"))
oracle("high_risk_routing", INS, "SELECT entity_id, risk_score, model_used AS source FROM ins WHERE risk_score >= 80 AND model_used IS NOT NULL")
oracle("inference_trigger", MKT, "SELECT event_id, student_id, event_type FROM mkt WHERE event_type = 'session_completed'")
oracle("error_log", BASE, """SELECT ts AS "timestamp", 'ERROR user ' || user_id AS message FROM ev WHERE event_type = 'error' ORDER BY ts DESC LIMIT 20""")

# --- state and change feeds -----------------------------------------------------------------------------------

_SNAP = MKT + """,
sd AS (SELECT subject || '/' || region || '/' || (student_id % 50) AS entity_id, * FROM mkt WHERE event_type = 'supply_demand_update'),
o AS (SELECT * FROM sd WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT * FROM sd WHERE ts >= TIMESTAMP '2024-01-08' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1),
feed AS (SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, CASE WHEN o.entity_id IS NULL THEN 'INSERT' WHEN n.entity_id IS NULL THEN 'REMOVE'
      WHEN (o.region, o.demand_score, o.supply_score, o.balance_status) IS DISTINCT FROM (n.region, n.demand_score, n.supply_score, n.balance_status) THEN 'MODIFY' END AS change_type,
    o.demand_score AS old_demand, n.demand_score AS new_demand, coalesce(n.region, o.region) AS region, coalesce(n.demand_score, o.demand_score) AS demand_score,
    coalesce(n.supply_score, o.supply_score) AS supply_score, coalesce(n.balance_status, o.balance_status) AS balance_status FROM o FULL JOIN n ON o.entity_id = n.entity_id)"""
oracle("change_feed", _SNAP, "SELECT entity_id, 'subject' AS entity_type, change_type, old_demand, new_demand FROM feed WHERE change_type IS NOT NULL")
oracle("change_messages", _SNAP, "SELECT entity_id, 'subject' AS entity_type, change_type, region, demand_score, supply_score, balance_status FROM feed WHERE change_type IS NOT NULL")
oracle("upsert_merge", MKT, """SELECT student_id AS entity_id, 'student' AS entity_type, ts, event_id, rating, subject FROM mkt WHERE event_type = 'session_completed'
QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, event_id DESC) = 1""")

# --- training data --------------------------------------------------------------------------------------------


def _hash(key: str) -> str:
    return f"(({key} % 2147483648) * 2654435761 % 4294967296)"


_CUT = "CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END"
_BUCKET = "CASE WHEN {h} % 10000 < 7000 THEN 'train' WHEN {h} % 10000 < 8500 THEN 'validation' ELSE 'test' END"
oracle("stratified_split", TEL + f""",
rk AS (SELECT insight_id, risk_level, row_number() OVER (PARTITION BY risk_level ORDER BY {_hash('insight_id')}, insight_id) AS r, count(*) OVER (PARTITION BY risk_level) AS n
  FROM tel WHERE risk_level IS NOT NULL)""", f"SELECT insight_id, risk_level, {_CUT} AS split FROM rk")
oracle("stratified_split_lineitem", BASE + f""",
li AS (SELECT (l_orderkey * 8 + l_linenumber) * 20011 + l_partkey AS row_key, l_orderkey, l_returnflag FROM lineitem),
rk AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_hash('row_key')}, row_key) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM li)""",
       f"SELECT l_returnflag, {_CUT} AS split, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS sum_orderkey FROM rk GROUP BY ALL")
oracle("hash_split", BASE, f"SELECT doc_id, quality, {_BUCKET.format(h=_hash('doc_id'))} AS split FROM labels")
oracle("dataset_union", TEL, "SELECT coalesce(risk_level, 'unknown') AS risk_level, count(*) AS n, round(avg(coalesce(performance_score, -1.0)), 6) AS avg_score FROM tel GROUP BY 1")
_SCALED = ("value", "latency", "error_rate", "queue_depth")
_PARAMS = TEL + f""", sp AS (SELECT *, {_BUCKET.format(h=_hash('insight_id'))} AS split FROM tel),
pr AS (SELECT """ + ", ".join(f"avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std" for c in _SCALED) + " FROM sp WHERE split = 'train')"
oracle("scaling_params", _PARAMS, "SELECT " + ", ".join(f"round({c}__{s}, 6) AS {c}__{s}" for c in _SCALED for s in ("mean", "std")) + " FROM pr")
oracle("standardize", _PARAMS, "SELECT insight_id, split, " + ", ".join(f"round(({c} - {c}__mean) / CASE WHEN {c}__std = 0 THEN 1 ELSE {c}__std END, 5) AS {c}" for c in _SCALED) + " FROM sp, pr")
oracle("standardize_epsilon", _PARAMS, "SELECT insight_id, split, " + ", ".join(f"round(({c} - {c}__mean) / ({c}__std + 1e-7::DOUBLE), 5) AS {c}" for c in _SCALED) + " FROM sp, pr")
_QUAL = BASE + """, ql AS (SELECT quality AS label, (n_chars > 400)::INT AS prediction FROM labels JOIN documents USING (doc_id)),
cf AS (SELECT label, prediction, count(*) AS n FROM ql GROUP BY ALL),
cr AS (SELECT label, coalesce(a.support, 0) AS support, coalesce(a.hits, 0) AS hits, coalesce(b.predicted, 0) AS predicted FROM
  (SELECT label, count(*) AS support, count(*) FILTER (label = prediction) AS hits FROM ql GROUP BY label) a FULL JOIN (SELECT prediction AS label, count(*) AS predicted FROM ql GROUP BY 1) b USING (label)),
rp AS (SELECT *, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0.0) AS p, coalesce(hits / nullif(support, 0)::DOUBLE, 0.0) AS rc FROM cr),
rf AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END AS f FROM rp)"""
oracle("confusion", _QUAL, "SELECT * FROM cf")
oracle("class_report", _QUAL, "SELECT label, support, hits, predicted, round(p, 6) AS precision, round(rc, 6) AS recall, round(f, 6) AS f1 FROM rf")
oracle("summary_report", _QUAL, """SELECT round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
  round(sum(rc * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS rows FROM rf""")
oracle("regression_report", BASE, """SELECT round(sqrt(avg((o_totalprice - 250000) * (o_totalprice - 250000))), 3) AS rmse, round(avg(abs(o_totalprice - 250000)), 3) AS mae,
  round(1 - sum((o_totalprice - 250000) * (o_totalprice - 250000)) / (var_pop(o_totalprice) * count(*)), 3) AS r2, count(*) AS rows FROM orders""")
oracle("dataset_profile", SCORED, """SELECT segment, count(*) AS n, round(min(velocity), 6) AS min_session_velocity, round(max(velocity), 6) AS max_session_velocity, round(min(health_score), 6) AS min_health_score,
  round(max(health_score), 6) AS max_health_score, round(avg(c14), 6) AS avg_churn_risk_14d, round(avg(health_score), 6) AS avg_health_score,
  round(count(*) / (SELECT count(*) FROM scored)::DOUBLE * 100, 6) AS pct FROM scored GROUP BY segment""")
oracle("encode_codes", BASE, """SELECT c_custkey, ['budget', 'standard', 'premium', 'gold'][c_custkey % 4 + 1] AS tier,
  CASE WHEN c_custkey % 4 < 3 THEN CAST(c_custkey % 4 AS INTEGER) END AS subscription_tier FROM customer""")
oracle("subject_regressions", MKT, """SELECT subject, round(regr_slope(demand_score, supply_score), 4) AS slope, round(regr_intercept(demand_score, supply_score), 4) AS intercept,
  round(regr_r2(demand_score, supply_score), 4) AS r2, count(*) AS n FROM mkt WHERE event_type = 'supply_demand_update' GROUP BY subject""")
oracle("prediction_outcomes", MKT + """,
e AS (SELECT student_id, count(*) FILTER (event_type = 'ib_call_logged' AND (epoch_us(TIMESTAMP '2024-01-16') - epoch_us(ts)) // 86400000000 < 14) AS c FROM mkt
  WHERE ts < TIMESTAMP '2024-01-16' AND event_type IN ('session_completed', 'ib_call_logged', 'customer_health_update') GROUP BY 1),
s AS (SELECT student_id, count(*) AS outcome FROM mkt WHERE ts >= TIMESTAMP '2024-01-16' AND event_type = 'ib_call_logged' GROUP BY 1)""", """
SELECT student_id AS entity_id, round(least(1.0, c / 10.0::DOUBLE), 6) AS churn_risk_14d, outcome, outcome IS NOT NULL AS observed FROM e LEFT JOIN s USING (student_id)""")

# --- streams: the batch result ---------------------------------------------------------------------------------

oracle("stream_entity_fold", MKT + """,
se AS (SELECT *, event_type IN ('session_started', 'session_completed') AS is_s, event_type = 'ib_call_logged' AS is_c FROM mkt
  WHERE event_type IN ('session_started', 'session_completed', 'ib_call_logged', 'customer_health_update')),
cu AS (SELECT *, count(*) FILTER (is_s) OVER w AS cs, count(*) FILTER (is_c) OVER w AS cc,
    last_value(health_score IGNORE NULLS) OVER w AS h FROM se WINDOW w AS (PARTITION BY student_id ORDER BY ts, event_id)),
sn AS (SELECT *, last_value(sessions_last_7_days - cs IGNORE NULLS) OVER w AS d7, last_value(sessions_last_30_days - cs IGNORE NULLS) OVER w AS d30,
    last_value(ib_calls_last_14_days - cc IGNORE NULLS) OVER w AS dc FROM cu WINDOW w AS (PARTITION BY student_id ORDER BY ts, event_id)),
af AS (SELECT *, cs + coalesce(d7, 0) AS s7, cs + coalesce(d30, 0) AS s30, cc + coalesce(dc, 0) AS c14, coalesce(h, 100.0) AS hs FROM sn),
st AS (SELECT tutor_id, row_number() OVER (PARTITION BY tutor_id ORDER BY ts, event_id) AS n,
    CASE WHEN event_type = 'session_completed' THEN rating END AS r FROM mkt WHERE event_type IN ('session_started', 'session_completed')),
f(tutor_id, n, a) AS (
  SELECT DISTINCT tutor_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM st
  UNION ALL SELECT f.tutor_id, st.n, CASE WHEN st.r IS NULL THEN f.a ELSE (f.a * (st.n - 1) + st.r) / st.n END
  FROM f JOIN st ON st.tutor_id = f.tutor_id AND st.n = f.n + 1)""", """
SELECT CAST(student_id AS VARCHAR) AS entity_id, 'student' AS entity_type, count(*) AS events, count(*) FILTER (c14 >= 3) AS call_alerts, count(*) FILTER (hs < 70) AS health_alerts,
  arg_max(s7, ts) AS sessions_7d, arg_max(cs, ts) AS sessions_14d, arg_max(s30, ts) AS sessions_30d, arg_max(cc, ts) AS ib_calls_7d, arg_max(c14, ts) AS ib_calls_14d,
  0.0::DOUBLE AS avg_rating, round(arg_max(hs, ts), 6) AS health_score FROM af GROUP BY student_id
UNION ALL SELECT CAST(tutor_id AS VARCHAR), 'tutor', max(n), 0, 0, max(n), max(n), max(n), 0, 0, round(arg_max(a, n), 6), 100.0 FROM f GROUP BY tutor_id""", recursive=True)
oracle("stream_recent_windows", MKT + """,
dy AS (SELECT *, CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS dn, max(CAST(epoch_us(ts) // 86400000000 AS INTEGER)) OVER (PARTITION BY student_id) AS newest FROM mkt)""",
       "SELECT CAST(student_id AS VARCHAR) AS entity_id, max(newest) AS day, " + ", ".join(
           f"count(*) FILTER (event_type = '{t}' AND dn > newest - {n}) AS {c}_{n}d" for c, t in (("sessions", "session_completed"), ("calls", "ib_call_logged")) for n in (7, 14, 30)
       ) + " FROM dy GROUP BY student_id")
oracle("stream_idle_windows", MKT + """,
dy AS (SELECT *, CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS dn, greatest(max(CAST(epoch_us(ts) // 86400000000 AS INTEGER)) OVER (PARTITION BY student_id),
    CAST((max(epoch_us(ts)) OVER () // 1000 - 3600000) // 86400000 AS INTEGER)) AS newest FROM mkt)""",
       "SELECT CAST(student_id AS VARCHAR) AS entity_id, " + ", ".join(
           f"count(*) FILTER (event_type = '{t}' AND dn > newest - {n}) AS {c}_{n}d" for c, t in (("sessions", "session_completed"), ("calls", "ib_call_logged")) for n in (7, 14, 30)
       ) + " FROM dy GROUP BY student_id")
ORACLES["stream_ingest"] = ORACLES["event_items"]
ORACLES["stream_quarantine"] = ORACLES["quarantine_by_severity"]
ORACLES["stream_malformed_rate"] = ORACLES["malformed_rate_5m"]
ORACLES["stream_alerts_cooldown"] = ORACLES["alerts_dedup_cooldown"]
oracle("stream_alarm_windows", BASE, """SELECT event_type AS metric, time_bucket(INTERVAL 5 MINUTE, ts) AS period, round(sum(value), 6) AS "Sum", round(avg(value), 6) AS "Average",
  max(value) AS "Maximum" FROM ev GROUP BY ALL""")
oracle("stream_daily_counts", MKT, """SELECT student_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'session_completed') AS sessions,
  count(*) FILTER (event_type = 'ib_call_logged') AS calls FROM mkt GROUP BY ALL""")
ARRIVED = BASE + """,
ar AS (SELECT *, least(greatest(CAST(floor((epoch(ts) // 1 + CASE WHEN event_id % 29 = 0 THEN 129600 ELSE 0 END - epoch(TIMESTAMP '2024-01-01')) / 259200) AS INTEGER), 0), 9) AS batch,
  time_bucket(INTERVAL 1 HOUR, ts) AS period FROM ev),
wm AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS watermark FROM ar GROUP BY batch),
ma AS (SELECT ar.*, watermark, coalesce(period + INTERVAL 1 HOUR <= watermark, false) AS late FROM ar JOIN wm USING (batch))"""
oracle("stream_late_rows", ARRIVED, "SELECT event_id, ts, event_type, period, watermark, batch FROM ma WHERE late")
oracle("stream_windows_on_time", ARRIVED, """SELECT period, count(*) AS archived, count(*) FILTER (late) AS late, count(*) FILTER (NOT late) AS total,
  count(*) FILTER (NOT late AND event_type = 'error') AS errors FROM ma GROUP BY 1""")
_SESSIONS = BASE + """,
ga AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOUR, true)::INT AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
nu AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number FROM ga),
se AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases,
  round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0), 6) AS spent FROM nu GROUP BY user_id, number)"""
oracle("activity_sessions", _SESSIONS, "SELECT * FROM se")
oracle("stream_sessions", _SESSIONS, "SELECT * FROM se WHERE last + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ev)")
ORACLES["stream_tutor_state"] = ORACLES["ingest_tutor_state"]

oracle("feature_drift", TEL + ",\nst AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS x, ts < TIMESTAMP '2024-01-16' AS early FROM tel WHERE {f} IS NOT NULL" for f in ("value", "latency", "error_rate")) + """),
rk AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS r, count(*) OVER (PARTITION BY feature) AS n FROM st WHERE early),
ed AS (SELECT feature, list(x ORDER BY i) AS edges FROM rk JOIN range(1, 10) AS t(i) ON r = (n * i + 9) // 10 GROUP BY feature),
bn AS (SELECT feature, early, len(list_filter(edges, lambda e: e < x)) AS bin, x FROM st JOIN ed USING (feature)),
sm AS (SELECT feature, avg(x) FILTER (early) AS me, avg(x) FILTER (NOT early) AS ma, stddev_pop(x) FILTER (early) AS de, stddev_pop(x) FILTER (NOT early) AS da,
  count(*) FILTER (early) AS ne, count(*) FILTER (NOT early) AS na FROM bn GROUP BY feature),
pq AS (SELECT feature, bin, greatest(count(*) FILTER (early) / max(ne)::DOUBLE, 1e-6) AS p, greatest(count(*) FILTER (NOT early) / max(na)::DOUBLE, 1e-6) AS q
  FROM (SELECT feature, b AS bin FROM ed, range(0, 10) AS t(b)) AS every LEFT JOIN bn USING (feature, bin) JOIN sm USING (feature) GROUP BY ALL)""", """
SELECT feature, round(me, 9) AS mean_expected, round(ma, 9) AS mean_actual, round(de, 9) AS std_expected, round(da, 9) AS std_actual,
  (SELECT round(sum((q - p) * ln(q / p)), 9) FROM pq WHERE pq.feature = sm.feature) AS psi FROM sm""")
oracle("horizon_examples", MKT + """,
ao(as_of) AS (VALUES (TIMESTAMP '2024-01-08'), (TIMESTAMP '2024-01-11'), (TIMESTAMP '2024-01-14'), (TIMESTAMP '2024-01-22')),
nr AS (SELECT mkt.* EXCLUDE (age), as_of, ts < as_of AS past, (epoch_us(as_of) - epoch_us(ts)) // 86400000000 AS age,
    event_type = 'session_completed' AS done, event_type = 'ib_call_logged' AS call, event_type = 'customer_health_update' AND health_score IS NOT NULL AS snap, nullif(rating, 0) AS r
  FROM mkt JOIN ao ON ts >= as_of - INTERVAL 14 DAY AND ts < as_of + INTERVAL 7 DAY),
hx AS (SELECT student_id, as_of, count(*) FILTER (done AND past AND age < 7) AS sessions_7d, count(*) FILTER (done AND past) AS sessions_before,
    count(*) FILTER (call AND past AND age < 7) AS calls_7d, count(*) FILTER (call AND past) AS calls_before, coalesce(avg(r) FILTER (done AND past), 0.0) AS avg_rating,
    coalesce(arg_max(health_score, (ts, event_id)) FILTER (snap AND past), 100.0) AS health_before, coalesce(min(age) FILTER (done AND past), 14) AS days_since_last_session,
    coalesce(avg(duration_min) FILTER (done AND past), 0.0) AS avg_duration, arg_min(struct_pack(v := r), (ts, event_id)) FILTER (done AND NOT past) AS f,
    count(*) FILTER (done AND NOT past) AS s1, count(*) FILTER (call AND NOT past) AS c1, arg_max(health_score, (ts, event_id)) FILTER (snap AND NOT past) AS h1, count(*) FILTER (past) AS seen
  FROM nr GROUP BY ALL)""", """
SELECT student_id, as_of, sessions_7d, sessions_before, calls_7d, calls_before, round(avg_rating, 6) AS avg_rating, round(health_before, 6) AS health_before, days_since_last_session,
  round(avg_duration, 6) AS avg_duration, (f.v >= 4)::INT::DOUBLE AS y_first_session_success, round(s1 / 7.0::DOUBLE * 7, 6) AS y_session_velocity,
  (s1 / 7.0::DOUBLE < sessions_before / 14.0::DOUBLE / 2)::INT::DOUBLE AS y_churn_risk_14d, (c1 >= 7)::INT::DOUBLE AS y_churn_risk_30d, round(h1, 6) AS y_health_score FROM hx WHERE seen > 0""")
oracle("model_accuracy_drops", TEL + """,
vs(model, shift) AS (VALUES ('risk-v1', 0), ('risk-v2', 1), ('risk-v3', 12), ('risk-v4', 5)),
ac AS (SELECT model, avg((risk_level = CASE WHEN value >= 150 + shift THEN 'critical' WHEN value >= 80 + shift THEN 'high' WHEN value >= 30 + shift THEN 'medium' ELSE 'low' END)::INT) AS accuracy
  FROM tel, vs WHERE risk_level IS NOT NULL GROUP BY model),
lg AS (SELECT model, accuracy, lag(accuracy) OVER (ORDER BY model) AS accuracy_before FROM ac)""", """
SELECT model, round(accuracy, 6) AS accuracy, round(accuracy_before, 6) AS accuracy_before, round(accuracy_before - accuracy, 6) AS lost, coalesce(accuracy_before - accuracy > 0.02::DOUBLE, false) AS alert FROM lg""")

# --- written and read back; whole texts -----------------------------------------------------------------------

_HOUR = "strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, strftime(ts, '%H') AS hour"
oracle("archive_roundtrip", RAW, f"SELECT body AS value, {_HOUR} FROM raw")
oracle("columnar_archive", BASE, f"SELECT {_HOUR}, count(*) AS n, round(sum(value), 6) AS total FROM ev GROUP BY ALL")
_CUSTOMERS = BASE + """,
cu AS (SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'said "yes", twice' WHEN 2 THEN 'two' || chr(10) || 'lines' WHEN 3 THEN ' spaced ' ELSE 'plain' END AS note,
  CAST(c_custkey % 7 AS INTEGER) AS customer_id, 's' AS segment FROM customer)"""
oracle("csv_roundtrip", _CUSTOMERS, "SELECT * EXCLUDE (customer_id, segment) FROM cu")
oracle("jsonl_roundtrip", _CUSTOMERS, "SELECT * FROM cu")
oracle("json_export", BASE, """SELECT true AS within_limit, count(*) AS rows, round(sum(value), 6) AS total, 'events' AS table_name, 'events/' AS prefix, 'json' AS format, count(*) AS row_count,
  TIMESTAMP '2024-01-31' AS export_date FROM ev""")
oracle("splits_roundtrip", TEL + f""",
rk AS (SELECT insight_id, value, row_number() OVER (PARTITION BY risk_level ORDER BY {_hash('insight_id')}, insight_id) AS r, count(*) OVER (PARTITION BY risk_level) AS n FROM tel WHERE risk_level IS NOT NULL)""",
       f"SELECT {_CUT} AS split, format, count(*) AS n, round(sum(value), 6) AS total FROM rk, (VALUES ('csv'), ('json')) AS f(format) GROUP BY ALL")
oracle("metadata_roundtrip", TEL + """,
st AS (SELECT avg(iops) AS m0, stddev_pop(iops) AS s0, avg(latency) AS m1, stddev_pop(latency) AS s1, avg(error_rate) AS m2, stddev_pop(error_rate) AS s2,
  count(*) FILTER (insight_id % 10 < 7) AS train, count(*) FILTER (insight_id % 10 >= 7) AS test FROM tel)""", """
SELECT 3 AS feature_count, 'iops,latency' AS performance, 'error_rate' AS errors, train, test, i AS "at", round([m0, m1, m2][i + 1], 6) AS mean, round([s0, s1, s2][i + 1], 6) AS scale
FROM st, (VALUES (0), (1), (2)) AS a(i)""")
_INSIGHTS = ORACLES["generate_insights"]
ORACLES["insight_sink"] = _INSIGHTS[:_INSIGHTS.rindex("SELECT entity_id AS related_entity")] + """
SELECT 'insight_' || substr(sha256(concat_ws('|', entity_type, entity_id, t, '1706659200000')), 1, 16) AS entity_id, 'insight' AS entity_type,
  TIMESTAMP '2024-01-31 00:00:00' + (row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY o) - 1) * INTERVAL 100 MILLISECOND AS "timestamp",
  CAST(entity_id AS VARCHAR) AS related_entity, t AS prediction_type, risk AS risk_score, 'r1' AS run FROM items"""
oracle("severity_outputs", ALERTS, "SELECT alert_no, alert_type, entity_id, severity FROM al WHERE severity IN ('critical', 'warning')")
ORACLES["entity_partitions"] = f"SELECT * FROM ({ORACLES['entity_counters']}) WHERE entity_type = 'tutor'"
oracle("time_range_scan", BASE, "SELECT event_id, ts, event_type FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
oracle("bundle_roundtrip", TEL, """SELECT insight_id, device_id, date_trunc('millisecond', ts) AS ts, round(value, 6) AS value, round(iops, 6) AS iops, round(latency, 6) AS latency, round(error_rate, 6) AS error_rate,
  coalesce(risk_level, 'unknown') AS risk_level, round(coalesce(performance_score, -1.0), 6) AS performance_score FROM tel""")
oracle("insight_by_entity", INS, "SELECT * FROM served WHERE entity_id = 7")
oracle("source_confidence", BASE, """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SageMaker-xgb' WHEN 1 THEN 'bedrock/claude' WHEN 2 THEN 'rules' END AS source,
  CASE event_id % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.88 ELSE 0.75 END::DOUBLE AS confidence FROM ev""")
oracle("utc_texts", BASE, "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN date_trunc('millisecond', ts) WHEN event_id % 5 = 3 THEN date_trunc('second', ts) END AS at FROM ev")
# two decimals by the exact value; multiples of an eighth that are ties go up
_TWO = lambda x: f"printf('%.2f', CASE WHEN ({x}) * 8 % 2 = 1 THEN ({x}) + 0.001::DOUBLE ELSE {x} END)"
_BIG = lambda x: f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"
oracle("feature_csv_text", TEL, f"""SELECT insight_id, concat_ws(',', {_BIG('iops * 0.6::DOUBLE')}, {_BIG('iops * 0.4::DOUBLE')}, iops, {_BIG('iops * 0.15::DOUBLE')}, {_TWO('latency')}, {_TWO('latency * 2.5::DOUBLE')}, {_TWO('latency * 5')},
  CASE WHEN latency > 10 THEN 3 ELSE 0 END, throughput, {_BIG('throughput * 0.1::DOUBLE')}, {_TWO('error_rate')}, CASE WHEN error_rate > 1 THEN '0.50' ELSE '-0.20' END, hour(ts), isodow(ts) - 1, 3600, '0.70', '0.30',
  queue_depth, 128, 32, {_TWO('CASE WHEN latency > 0 THEN iops / latency ELSE 0.0 END')}, {_TWO('error_rate * 2 + CASE WHEN latency > 10 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END')},
  printf('%.2f', CASE WHEN iops > 80000 THEN 7.0 ELSE 3.0 END + CASE WHEN latency > 15 THEN 2.0 ELSE 0.0 END), {_TWO('least(iops / 150000, 1.0)')}, CASE WHEN iops > 100000 THEN 2 WHEN latency > 10 THEN 1 ELSE 0 END) AS features_csv FROM tel""")
oracle("validation_messages", RAW, """
SELECT event_id, CASE WHEN bad_json THEN 'raw_data:critical:Parse error: not a JSON event' ELSE concat_ws('; ', CASE WHEN no_type THEN 'event_type:critical:Missing required field: event_type' END,
  CASE WHEN odd_type THEN 'event_type:error:Invalid event_type: ' || et || '. Must be one of: session_started, session_completed, ib_call_logged, tutor_availability_updated, customer_health_update, supply_demand_update' END,
  CASE WHEN no_payload THEN 'payload:critical:Missing or invalid payload field' END, CASE WHEN odd_metrics THEN 'metrics:error:Metrics must be an object' END,
  CASE WHEN bad_iops THEN 'metrics.iops:error:IOPS must be a non-negative number' END, CASE WHEN bad_latency THEN 'metrics.latency:error:Latency must be a non-negative number' END,
  CASE WHEN bad_rate THEN 'metrics.errorRate:error:Error rate must be between 0 and 100' END, CASE WHEN bad_time THEN 'timestamp:warning:Invalid timestamp format' END) END AS errors FROM checks""")
oracle("short_validation_reasons", RAW, """
SELECT event_id, concat_ws('; ', CASE WHEN bad_json OR no_type OR odd_type THEN 'Invalid event_type: ' || coalesce(et, 'undefined') END, CASE WHEN coalesce(tm, '') = '' THEN 'Missing timestamp' END,
  CASE WHEN pk IS NULL THEN 'Missing payload' END, CASE WHEN iv < 0 THEN 'Negative IOPS value' END) AS reasons FROM checks""")
ORACLES["version_feed"] = ORACLES["change_feed"]
oracle("stream_dedup_first", ALERTS, "SELECT DISTINCT alert_type, entity_id FROM al")
