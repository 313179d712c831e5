"""Independent SQL (DuckDB dialect) for the catalog queries.

Written directly from the operator definitions over whole-series windows, so
it shares no code path with the Spark plans (no chunks, no blocks, no halo).
Views ``events`` etc. are expected to be registered.
"""

from __future__ import annotations

from ..config import (ENGINEERED_FEATURES, FEATURE_EXPLANATIONS, DEFAULT_EXPLANATION, PEAK_HOURS,
                      RULE_PEAK, RULE_SUMMER, RULE_WEEKEND, RULE_WINTER, SCALED_FEATURES,
                      SEASONAL_IMPORTANCE, SUMMER_MONTHS, WINTER_MONTHS, Routes)

PT = "2024-02-01T00:00:00"  # the fixed processing time, ISO text
ROUTES = Routes(email=("ops@example.org", "lead@example.org"), sms=("+10000000000",), email_sender="alerts@example.org")


def R(x: str) -> str:
    return f"round(({x}) + 1e-9, 6)"


def F(x: str, d: int) -> str:
    return f"printf('%.{d}f', {x})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _w(order: str = "pos", frame: str = "") -> str:
    return f"(PARTITION BY sensor_id ORDER BY {order} {frame})"


# ---------------------------------------------------------------- inputs
HOURLY = """
h0 AS (SELECT event_type AS sensor_id, date_trunc('hour', ts) AS timestamp, avg(value) AS value
       FROM events GROUP BY 1, 2),
hb AS (SELECT sensor_id, min(timestamp) AS lo, max(timestamp) AS hi FROM h0 GROUP BY 1),
hg AS (SELECT sensor_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM hb),
src AS (SELECT hg.sensor_id, hg.timestamp, h0.value, CAST(NULL AS BIGINT) AS row_id
        FROM hg LEFT JOIN h0 USING (sensor_id, timestamp))"""

RAW = """
src AS (SELECT event_type AS sensor_id, ts AS timestamp, CAST(value AS DOUBLE) AS value, event_id AS row_id
        FROM events)"""

USERS = """
src AS (SELECT CAST(user_id AS VARCHAR) AS sensor_id, ts AS timestamp, CAST(value AS DOUBLE) AS value,
               event_id AS row_id FROM events)"""


def _gappy(key: str) -> str:
    return f"""
src AS (SELECT {key} AS sensor_id, ts AS timestamp,
               CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 10 THEN CAST(value AS DOUBLE) END AS value,
               event_id AS row_id FROM events)"""


GAPPY = _gappy("event_type")
USER_GAPPY = _gappy("CAST(user_id AS VARCHAR)")


# ---------------------------------------------------------------- cleaning
def clean(method: str = "linear") -> str:
    """T1 + W4/W5 + F2 over whole series -> ``kept(sensor_id, timestamp,
    row_id, value, imputed, pos, n)``."""
    order = "timestamp, row_id NULLS FIRST, value NULLS FIRST"
    pv = "struct_pack(v := value, p := p0, us := epoch_us(timestamp))"
    if method == "linear":
        fill = "prv.v + (nxt.v - prv.v) * (CAST(p0 - prv.p AS DOUBLE) / CAST(nxt.p - prv.p AS DOUBLE))"
        fill = f"CASE WHEN nxt IS NULL THEN prv.v ELSE {fill} END"
    elif method == "time":
        frac = ("coalesce(CAST(epoch_us(timestamp) - prv.us AS DOUBLE) / "
                "nullif(CAST(nxt.us - prv.us AS DOUBLE), 0), 0.0)")
        fill = f"CASE WHEN nxt IS NULL THEN prv.v ELSE prv.v + (nxt.v - prv.v) * {frac} END"
    elif method == "ffill":
        fill = "prv.v"
    else:
        fill = "CASE WHEN nxt IS NULL THEN NULL WHEN (p0 - prv.p) <= (nxt.p - p0) THEN prv.v ELSE nxt.v END"
    return f"""
o0 AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY {order}) - 1 AS p0 FROM src),
o1 AS (SELECT *,
         last_value(CASE WHEN value IS NOT NULL THEN {pv} END IGNORE NULLS) OVER
           (PARTITION BY sensor_id ORDER BY p0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv,
         first_value(CASE WHEN value IS NOT NULL THEN {pv} END IGNORE NULLS) OVER
           (PARTITION BY sensor_id ORDER BY p0 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt
       FROM o0),
o2 AS (SELECT sensor_id, timestamp, row_id, p0, value IS NULL AS imputed,
         CASE WHEN value IS NOT NULL THEN value WHEN prv IS NULL THEN NULL ELSE {fill} END AS value
       FROM o1),
kept AS (SELECT sensor_id, timestamp, row_id, value, imputed,
           row_number() OVER (PARTITION BY sensor_id ORDER BY p0) - 1 AS pos,
           count(*) OVER (PARTITION BY sensor_id) AS n
         FROM o2 WHERE value IS NOT NULL)"""


def features(period: int = 24) -> str:
    h = period // 2
    w = _w()
    cols = ["hour(timestamp) AS hour", "isodow(timestamp) - 1 AS day_of_week", "month(timestamp) AS month"]
    for k in (12, 24, 168):
        fr = _w("pos", f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW")
        cols.append(f"avg(value) OVER {fr} AS rolling_mean_{k}")
        cols.append(f"stddev_samp(value) OVER {fr} AS rolling_std_{k}")
    cols.append(f"value - lag(value, 1) OVER {w} AS rate_of_change")
    cols.append(f"abs(value - lag(value, 1) OVER {w}) AS rate_of_change_abs")
    cols.append(f"lag(value, 24) OVER {w} AS lag_24")
    cols.append(f"lag(value, 168) OVER {w} AS lag_168")
    inner = _w("pos", f"ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING")
    cols.append(f"CASE WHEN pos >= {h} AND pos <= n - 1 - {h} THEN (sum(value) OVER {inner} + "
                f"0.5 * lag(value, {h}) OVER {w} + 0.5 * lead(value, {h}) OVER {w}) / {float(period)} END AS trend")
    return f"""
feat AS (SELECT sensor_id, timestamp, row_id, value, imputed, pos, n,
           {', '.join(cols)}
         FROM kept)"""


def stats() -> str:
    """Per-sensor value statistics + scaler + |corr| per feature."""
    aggs = ["max(n) AS n", "avg(value) AS mean", "stddev_pop(value) AS std_pop",
            "stddev_samp(value) AS std_samp", "quantile_cont(value, 0.25) AS q1",
            "quantile_cont(value, 0.75) AS q3"]
    for f in SCALED_FEATURES:
        aggs.append(f"avg({f}) AS {f}__mean")
        aggs.append(f"CASE WHEN stddev_pop({f}) IS NULL OR stddev_pop({f}) = 0 THEN 1.0 "
                    f"ELSE stddev_pop({f}) END AS {f}__scale")
    for f in ENGINEERED_FEATURES:
        x = f"CAST({f} AS DOUBLE)"
        cond = f"{f} IS NOT NULL AND value IS NOT NULL"
        sx = f"stddev_pop({x}) FILTER (WHERE {cond})"
        sy = f"stddev_pop(value) FILTER (WHERE {cond})"
        cv = f"covar_pop({x}, value) FILTER (WHERE {cond})"
        aggs.append(f"coalesce(abs(CASE WHEN {sx} * {sy} = 0 THEN NULL ELSE {cv} / ({sx} * {sy}) END), 0.0) "
                    f"AS corr__{f}")
    return f"""
st AS (SELECT sensor_id, {', '.join(aggs)} FROM feat GROUP BY sensor_id)"""


def seasonal(period: int = 24, threshold: float = 2.0) -> str:
    return f"""
pm0 AS (SELECT sensor_id, pos % {period} AS phase, avg(value - trend) AS phase_mean
        FROM feat WHERE trend IS NOT NULL GROUP BY 1, 2),
pm AS (SELECT *, phase_mean - avg(phase_mean) OVER (PARTITION BY sensor_id) AS seasonal FROM pm0),
dec AS (SELECT feat.*, pm.seasonal, value - trend - pm.seasonal AS resid
        FROM feat LEFT JOIN pm ON feat.sensor_id = pm.sensor_id AND feat.pos % {period} = pm.phase),
rs AS (SELECT sensor_id, stddev_samp(resid) AS resid_std FROM dec GROUP BY 1)"""


def detectors(z: float = 3.0, k: float = 1.5, period: int = 24, thr: float = 2.0) -> str:
    zexpr = "abs((d.value - st.mean) / nullif(st.std_pop, 0))"
    lo = f"(st.q1 - {k} * (st.q3 - st.q1))"
    hi = f"(st.q3 + {k} * (st.q3 - st.q1))"
    bound = f"({thr} * rs.resid_std)"
    return f"""
det AS (SELECT d.*, st.mean, st.std_pop, st.value__mean, st.value__scale,
          {zexpr} AS z,
          CASE WHEN coalesce({zexpr} > {z}, false) OR d.value < {lo} OR d.value > {hi}
               THEN least({zexpr} / {z}, 1.0) END AS conf_statistical,
          CASE WHEN d.n >= {2 * period} AND abs(d.resid) > {bound}
               THEN least(coalesce(abs(d.resid) / nullif({bound}, 0), 1.0), 1.0) END AS conf_seasonal
        FROM dec d JOIN st USING (sensor_id) JOIN rs USING (sensor_id)),
ens AS (SELECT *,
          (CASE WHEN conf_statistical IS NOT NULL THEN 0.3 * conf_statistical ELSE 0.0 END +
           CASE WHEN conf_seasonal IS NOT NULL THEN 0.3 * conf_seasonal ELSE 0.0 END) /
          nullif(CASE WHEN conf_statistical IS NOT NULL THEN 0.3 ELSE 0.0 END +
                 CASE WHEN conf_seasonal IS NOT NULL THEN 0.3 ELSE 0.0 END, 0) AS ensemble_confidence,
          CASE WHEN conf_statistical = greatest(conf_statistical, conf_seasonal) THEN 'statistical'
               WHEN conf_seasonal = greatest(conf_statistical, conf_seasonal) THEN 'seasonal' END
            AS strongest_detector
        FROM det WHERE conf_statistical IS NOT NULL OR conf_seasonal IS NOT NULL),
ens2 AS (SELECT *, CASE strongest_detector WHEN 'statistical' THEN 'statistical_outlier'
                     WHEN 'isolation_forest' THEN 'multi_scale_anomaly'
                     WHEN 'seasonal' THEN 'seasonal_shift' ELSE 'statistical_outlier' END AS anomaly_type
         FROM ens),
alerts AS (SELECT *, CASE WHEN ensemble_confidence > 0.9 THEN 'critical'
                          WHEN ensemble_confidence > 0.7 THEN 'high'
                          WHEN ensemble_confidence > 0.5 THEN 'medium' ELSE 'low' END AS severity
           FROM ens2 WHERE ensemble_confidence > 0.5)"""


def attribution() -> str:
    parts = []
    for i, f in enumerate(ENGINEERED_FEATURES):
        parts.append(f"SELECT sensor_id, '{f}' AS feature, corr__{f} AS importance, {i} AS ordinal FROM st")
    base = len(ENGINEERED_FEATURES)
    for i, (k, v) in enumerate(SEASONAL_IMPORTANCE.items()):
        parts.append(f"SELECT sensor_id, '{k}' AS feature, {float(v)} AS importance, {base + i} AS ordinal FROM st")
    expl = "CASE feature " + " ".join(
        f"WHEN {q(k)} THEN printf({q(t.replace('%s', '%s'))}, {F('importance', 2)})"
        for k, t in FEATURE_EXPLANATIONS.items()) + \
        f" ELSE printf({q(DEFAULT_EXPLANATION)}, feature, {F('importance', 2)}) END"
    return f"""
imp AS ({' UNION ALL '.join(parts)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY abs(importance) DESC, ordinal) AS rnk,
             {expl} AS explanation
           FROM imp),
top AS (SELECT sensor_id,
          string_agg(explanation, '; ' ORDER BY rnk) FILTER (WHERE rnk <= 3) AS top3,
          string_agg(printf('- %s: %s', feature, {F('importance', 3)}), chr(10) ORDER BY rnk)
            FILTER (WHERE rnk <= 5) AS lines
        FROM ranked GROUP BY sensor_id)"""


def rules_expr(ts: str = "timestamp") -> str:
    peak = ", ".join(str(x) for x in PEAK_HOURS)
    summer = ", ".join(str(x) for x in SUMMER_MONTHS)
    winter = ", ".join(str(x) for x in WINTER_MONTHS)
    return (f"concat_ws('; ', CASE WHEN hour({ts}) IN ({peak}) THEN {q(RULE_PEAK)} END, "
            f"CASE WHEN isodow({ts}) - 1 >= 5 THEN {q(RULE_WEEKEND)} END, "
            f"CASE WHEN month({ts}) IN ({summer}) THEN {q(RULE_SUMMER)} "
            f"WHEN month({ts}) IN ({winter}) THEN {q(RULE_WINTER)} END)")


def temporal_expr() -> str:
    parts = []
    for k, label in ((24, "same time yesterday"), (168, "same time last week")):
        ch = f"((value - lag_{k}) / lag_{k} * 100.0)"
        parts.append(f"CASE WHEN lag_{k} IS NOT NULL AND lag_{k} <> 0 AND abs({ch}) > 20.0 "
                     f"THEN printf('Value changed by %s%% compared to %s', {F(ch, 1)}, {q(label)}) END")
    return f"concat_ws('; ', {', '.join(parts)})"


def summary_expr() -> str:
    return f"concat_ws('; ', top.top3, nullif({rules_expr()}, ''), nullif({temporal_expr()}, ''))"


def pipeline_ctes(src: str = HOURLY) -> str:
    return "WITH " + ",".join([src, clean(), features(), stats(), seasonal(), detectors(), attribution()])


def email_body() -> str:
    nl = "chr(10)"
    meta = (f"printf('{{%s  \"processing_time\": \"%s\",%s  \"data_points_used\": %d%s}}', "
            f"{nl}, '{PT}', {nl}, n, {nl})")
    lo = "(mean - 2.0 * std_pop)"
    hi = "(mean + 2.0 * std_pop)"
    pieces = [
        nl, "'Anomaly Detection Alert'", nl, nl,
        "'Timestamp: '", "strftime(timestamp, '%Y-%m-%d %H:%M:%S')", nl,
        "'Sensor ID: '", "sensor_id", nl,
        "'Anomaly Type: '", "anomaly_type", nl,
        "'Severity: '", "upper(severity)", nl,
        "'Confidence: '", F("ensemble_confidence * 100.0", 2), "'%'", nl, nl,
        "'Value: '", F("value", 2), nl,
        "'Expected Range: '", F(lo, 2), "' - '", F(hi, 2), nl, nl,
        "'Root Cause Analysis:'", nl, summary_expr(), nl, nl,
        "'Top Contributing Features:'", nl, "top.lines", nl, nl,
        "'Metadata:'", nl, meta, nl, "'        '",
    ]
    return " || ".join(f"({p})" for p in pieces)


def _sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["interpolate_linear"] = f"""WITH {HOURLY},{clean('linear')}
SELECT sensor_id, timestamp, {R('value')} AS value, imputed, CAST(pos AS BIGINT) AS pos FROM kept"""
    for m in ("time", "ffill", "nearest"):
        out[f"interpolate_{m}"] = f"""WITH {GAPPY},{clean(m)}
SELECT sensor_id, timestamp, row_id, {R('value')} AS value, CAST(pos AS BIGINT) AS pos FROM kept"""
    out["drop_incomplete"] = f"""WITH {USER_GAPPY},{clean('linear')},
a AS (SELECT sensor_id, count(*) AS n_raw FROM src GROUP BY 1),
b AS (SELECT sensor_id, count(*) AS n_kept, min(timestamp) AS first_kept FROM kept GROUP BY 1)
SELECT a.sensor_id, n_raw, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept, first_kept
FROM a LEFT JOIN b USING (sensor_id)"""
    out["min_points_guard"] = f"""WITH {USERS},{clean('linear')}
SELECT sensor_id, count(*) AS n FROM kept GROUP BY 1 HAVING count(*) >= 60"""

    fbase = f"WITH {HOURLY},{clean()},{features()}"
    out["calendar_features"] = f"""{fbase}
SELECT sensor_id, timestamp, CAST(hour AS BIGINT) AS hour, CAST(day_of_week AS BIGINT) AS day_of_week,
       CAST(month AS BIGINT) AS month FROM feat"""
    out["rolling_mean"] = f"""{fbase}
SELECT sensor_id, timestamp, {', '.join(R(f'rolling_mean_{k}') + f' AS rolling_mean_{k}' for k in (12, 24, 168))} FROM feat"""
    out["rolling_std"] = f"""{fbase}
SELECT sensor_id, timestamp, {', '.join(R(f'rolling_std_{k}') + f' AS rolling_std_{k}' for k in (12, 24, 168))} FROM feat"""
    out["rate_of_change"] = f"""{fbase}
SELECT sensor_id, timestamp, {R('rate_of_change')} AS rate_of_change, {R('rate_of_change_abs')} AS rate_of_change_abs FROM feat"""
    wide = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in ("hour", "day_of_week", "month") else f"{R(c)} AS {c}"
                     for c in ENGINEERED_FEATURES)
    out["features_wide"] = f"""{fbase}
SELECT sensor_id, timestamp, {R('value')} AS value, {wide} FROM feat"""
    sc_parts = " UNION ALL ".join(
        f"SELECT sensor_id, '{f}' AS feature, avg({f}) AS mean, "
        f"CASE WHEN stddev_pop({f}) IS NULL OR stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS scale, "
        f"count({f}) AS n FROM feat GROUP BY sensor_id" for f in SCALED_FEATURES)
    out["scaler_fit"] = f"""{fbase}, m AS ({sc_parts})
SELECT sensor_id, feature, {R('mean')} AS mean, {R('scale')} AS scale, n FROM m"""
    out["scaler_apply"] = f"""{fbase},{stats()}
SELECT feat.sensor_id, timestamp, {', '.join(f"{R(f'({f} - st.{f}__mean) / st.{f}__scale')} AS {f}_scaled" for f in SCALED_FEATURES)}
FROM feat JOIN st USING (sensor_id)"""
    out["series_stats"] = f"""WITH {RAW},{clean()}
SELECT sensor_id, count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std_pop,
       {R('stddev_samp(value)')} AS std_samp, {R('quantile_cont(value, 0.25)')} AS q1,
       {R('quantile_cont(value, 0.75)')} AS q3, min(value) AS min, max(value) AS max
FROM kept GROUP BY 1"""
    sbase = f"{fbase},{seasonal()}"
    out["phase_means"] = f"""{sbase}
SELECT sensor_id, CAST(phase AS BIGINT) AS phase, {R('phase_mean')} AS phase_mean, {R('seasonal')} AS seasonal FROM pm"""
    out["expected_range"] = f"""{fbase}
SELECT sensor_id, {R('avg(value) - 2.0 * stddev_pop(value)')} AS lower, {R('avg(value) + 2.0 * stddev_pop(value)')} AS upper
FROM feat GROUP BY 1"""
    corr_rows = " UNION ALL ".join(f"SELECT sensor_id, '{f}' AS feature, corr__{f} AS importance FROM st"
                                   for f in ENGINEERED_FEATURES)
    out["feature_correlation"] = f"""{fbase},{stats()}, c AS ({corr_rows})
SELECT sensor_id, feature, {R('importance')} AS importance FROM c"""

    rbase = f"WITH {RAW},{clean()},{features()},{stats()}"
    zexpr = "abs((value - mean) / nullif(std_pop, 0))"
    out["zscore_outliers"] = f"""{rbase}
SELECT sensor_id, timestamp, row_id, {R(zexpr)} AS z FROM feat JOIN st USING (sensor_id) WHERE {zexpr} > 3.0"""
    out["iqr_fences"] = f"""{rbase}
SELECT sensor_id, {R('min(st.q1)')} AS q1, {R('min(st.q3)')} AS q3,
       {R('min(st.q1 - 1.5 * (st.q3 - st.q1))')} AS lower, {R('min(st.q3 + 1.5 * (st.q3 - st.q1))')} AS upper,
       CAST(sum(CASE WHEN value < st.q1 - 1.5 * (st.q3 - st.q1) OR value > st.q3 + 1.5 * (st.q3 - st.q1)
                     THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged
FROM feat JOIN st USING (sensor_id) GROUP BY 1"""
    ubase = f"WITH {USERS},{clean()},{features()},{stats()}"
    out["statistical_detect"] = f"""{ubase},
d AS (SELECT sensor_id, timestamp, row_id, {zexpr} AS z, value, q1, q3 FROM feat JOIN st USING (sensor_id))
SELECT sensor_id, timestamp, row_id, {R('least(z / 3.0, 1.0)')} AS confidence FROM d
WHERE coalesce(z > 3.0, false) OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
    out["seasonal_trend"] = f"""{fbase}
SELECT sensor_id, timestamp, {R('trend')} AS trend FROM feat WHERE trend IS NOT NULL"""
    out["seasonal_decompose"] = f"""{sbase}
SELECT sensor_id, timestamp, {R('trend')} AS trend, {R('seasonal')} AS seasonal, {R('resid')} AS resid
FROM dec WHERE trend IS NOT NULL"""
    out["seasonal_detect"] = f"""{sbase},
x AS (SELECT dec.*, rs.resid_std FROM dec JOIN rs USING (sensor_id))
SELECT sensor_id, timestamp, {R('least(coalesce(abs(resid) / nullif(2.0 * resid_std, 0), 1.0), 1.0)')} AS confidence
FROM x WHERE n >= 48 AND abs(resid) > 2.0 * resid_std"""

    pbase = pipeline_ctes()
    out["merge_detections"] = f"""{pbase}
SELECT sensor_id, timestamp, {R('conf_statistical')} AS conf_statistical, {R('conf_seasonal')} AS conf_seasonal FROM ens"""
    out["argmax_detector"] = f"""{pbase}
SELECT sensor_id, timestamp, strongest_detector, anomaly_type FROM ens2"""
    out["ensemble_two_detectors"] = f"""{pbase}
SELECT sensor_id, timestamp, {R('ensemble_confidence')} AS confidence, anomaly_type FROM alerts"""
    out["combined_importance"] = f"""{pbase}
SELECT sensor_id, feature, {R('importance')} AS importance FROM imp"""
    out["explain_feature"] = f"""{pbase}
SELECT sensor_id, CAST(rnk AS BIGINT) AS rank, explanation FROM ranked WHERE rnk <= 3"""
    out["domain_rules"] = f"""{pbase}
SELECT sensor_id, timestamp, {rules_expr()} AS insights FROM alerts"""
    out["temporal_context"] = f"""{pbase}
SELECT sensor_id, timestamp, {temporal_expr()} AS context FROM alerts"""
    out["root_cause_summary"] = f"""{pbase}
SELECT alerts.sensor_id, timestamp, {summary_expr()} AS root_cause_summary FROM alerts JOIN top USING (sensor_id)"""
    out["root_cause_series_end"] = f"""{pbase},
ends AS (SELECT sensor_id, max(CASE WHEN pos = n - 24 THEN value END) AS end_24, max(CASE WHEN pos = n - 168 THEN value END) AS end_168 FROM feat GROUP BY 1)
SELECT alerts.sensor_id, timestamp, {summary_expr().replace('lag_', 'end_')} AS root_cause_summary
FROM alerts JOIN top USING (sensor_id) JOIN ends USING (sensor_id)"""
    out["severity"] = f"""{pbase}
SELECT sensor_id, timestamp, {R('ensemble_confidence')} AS confidence_score, severity FROM alerts"""
    out["attribution_top5"] = f"""{pbase}
SELECT sensor_id, lines FROM top"""
    em, sms = q(", ".join(ROUTES.email)), q(", ".join(ROUTES.sms))
    out["alert_routing"] = f"""{pbase}
SELECT sensor_id, timestamp, 'email' AS channel, {em} AS "to" FROM alerts
UNION ALL
SELECT sensor_id, timestamp, 'sms' AS channel, {sms} AS "to" FROM alerts WHERE severity IN ('high', 'critical')"""
    out["email_outbox"] = f"""{pbase}
SELECT alerts.sensor_id, timestamp, 'Anomaly Alert - ' || alerts.sensor_id || ' - ' || upper(severity) AS subject,
       {email_body()} AS body
FROM alerts JOIN top USING (sensor_id)"""
    out["sms_outbox"] = f"""{pbase}
SELECT sensor_id, timestamp,
       printf('ALERT: %s - %s (%s) at %s. Value: %s', sensor_id, anomaly_type, severity,
              strftime(timestamp, '%H:%M'), {F('value', 1)}) AS body
FROM alerts WHERE severity IN ('high', 'critical')"""
    out["alerts_per_sensor"] = f"""{pbase}
SELECT sensor_id, anomaly_type, severity, count(*) AS n_alerts FROM alerts GROUP BY 1, 2, 3"""
    lo, hi = "(mean - 2.0 * std_pop)", "(mean + 2.0 * std_pop)"
    out["alert_values"] = f"""{pbase}
SELECT sensor_id, timestamp, {R('value')} AS value, {R('(value - value__mean) / value__scale')} AS value_scaled,
       {R(lo)} AS lower, {R(hi)} AS upper, {R(f'({lo} - value__mean) / value__scale')} AS lower_scaled,
       {R(f'({hi} - value__mean) / value__scale')} AS upper_scaled, CAST(n AS BIGINT) AS data_points_used
FROM alerts"""
    ratio = "(value / rolling_mean_24)"
    out["ensemble_plugin"] = f"""{pbase},
pl AS (SELECT sensor_id, timestamp, conf_statistical AS a,
         CASE WHEN rolling_mean_24 > 0 AND {ratio} > 3.0 THEN least({ratio} / 6.0, 1.0) END AS b FROM det),
pw AS (SELECT *, (CASE WHEN a IS NOT NULL THEN 0.3 * a ELSE 0.0 END + CASE WHEN b IS NOT NULL THEN 0.7 * b ELSE 0.0 END) /
         (CASE WHEN a IS NOT NULL THEN 0.3 ELSE 0.0 END + CASE WHEN b IS NOT NULL THEN 0.7 ELSE 0.0 END) AS c
       FROM pl WHERE a IS NOT NULL OR b IS NOT NULL)
SELECT sensor_id, timestamp, {R('c')} AS confidence,
       CASE WHEN a = greatest(a, b) THEN 'statistical' ELSE 'surge' END AS strongest_detector,
       CAST((a IS NOT NULL)::INT + (b IS NOT NULL)::INT AS BIGINT) AS n_detectors
FROM pw WHERE c > 0.5"""
    out["seasonal_long_period"] = f"""WITH {RAW},{clean()},{features(400)},{seasonal(400)}
SELECT sensor_id, count(*) AS n_trend,
       count(CASE WHEN n >= 800 AND abs(resid) > 2.0 * resid_std THEN 1 END) AS n_hits, {R('sum(trend)')} AS sum_trend
FROM dec JOIN rs USING (sensor_id) WHERE trend IS NOT NULL GROUP BY sensor_id"""
    out["domain_rules_orders"] = f"""
SELECT o_orderpriority AS sensor_id, o_orderkey AS row_id, {rules_expr('CAST(o_orderdate AS TIMESTAMP)')} AS insights FROM orders"""
    out["quarantine_counts"] = """
SELECT CASE WHEN event_id % 89 = 0 THEN 'unparsable timestamp' WHEN event_id % 83 = 0 THEN 'missing timestamp'
            WHEN event_id % 97 = 0 THEN 'missing sensor' ELSE 'kept' END AS outcome, count(*) AS n
FROM events GROUP BY 1"""
    out["detect_alerts_two"] = f"""{pbase}
SELECT alerts.sensor_id, timestamp, anomaly_type, severity, {R('value')} AS value, {R('ensemble_confidence')} AS confidence_score,
       {summary_expr()} AS root_cause_summary, CAST(n AS BIGINT) AS data_points_used
FROM alerts JOIN top USING (sensor_id)"""
    out["stream_batch_alerts"] = f"""{pbase}
SELECT sensor_id, timestamp, anomaly_type, severity, {R('ensemble_confidence')} AS confidence_score FROM alerts"""
    quantiles = ", ".join(f"{R(f'quantile_cont(value, {q})')} AS {n}" for q, n in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95")))
    out["quantile_selection"] = f"""WITH {RAW}
SELECT sensor_id, {quantiles} FROM src GROUP BY 1"""
    out["statistical_selection"] = f"""{rbase},
d AS (SELECT sensor_id, timestamp, row_id, {zexpr} AS z, value, q1, q3 FROM feat JOIN st USING (sensor_id))
SELECT sensor_id, timestamp, row_id, {R('least(z / 3.0, 1.0)')} AS confidence FROM d
WHERE coalesce(z > 3.0, false) OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""
    out["pandas_detector"] = f"""WITH {RAW},{clean()},
m AS (SELECT sensor_id, timestamp, row_id, value / median(value) OVER (PARTITION BY sensor_id ORDER BY pos ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS ratio
      FROM kept)
SELECT sensor_id, timestamp, row_id, {R('least(ratio / 8.0, 1.0)')} AS confidence FROM m WHERE ratio > 4.0"""
    first = "pos < 10"
    scaled = f"CASE WHEN pos >= 9 THEN (value - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END END"
    out["stream_continuous"] = f"""WITH {GAPPY},{clean()},{features()},
fit AS (SELECT sensor_id, avg(value) AS m, stddev_pop(value) AS s, count(*) AS k FROM feat WHERE {first} GROUP BY 1),
x AS (SELECT feat.*, CASE WHEN k = 10 THEN {scaled} END AS value_scaled FROM feat JOIN fit USING (sensor_id))
SELECT sensor_id, timestamp, row_id, {', '.join(f'{R(c)} AS {c}' for c in ('value', 'rolling_mean_24', 'rolling_std_168', 'rate_of_change', 'value_scaled'))},
       {R('CASE WHEN abs(value_scaled) > 3.0 THEN least(abs(value_scaled) / 3.0, 1.0) END')} AS conf_statistical, false AS late
FROM x"""
    out["stream_detections"] = f"""{pbase}
SELECT sensor_id, timestamp, 'statistical' AS detector, {R('conf_statistical')} AS confidence, CAST(0 AS BIGINT) AS version FROM det WHERE conf_statistical IS NOT NULL
UNION ALL
SELECT sensor_id, timestamp, 'seasonal' AS detector, {R('conf_seasonal')} AS confidence, CAST(0 AS BIGINT) AS version FROM det WHERE conf_seasonal IS NOT NULL"""
    # each micro-batch is a series of its own; the batch number is part of the key
    keyed = HOURLY.replace("src AS", "src0 AS") + """,
src AS (SELECT sensor_id || '#' || CASE WHEN sensor_id <> 'view' AND timestamp < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS sensor_id,
               timestamp, value, row_id FROM src0)"""
    out["stream_scaler_registry"] = f"""{pbase.replace(HOURLY, keyed)},
model AS (SELECT split_part(sensor_id, '#', 1) AS sensor, arg_min(value__mean, sensor_id) AS m, arg_min(value__scale, sensor_id) AS s
          FROM st GROUP BY 1)
SELECT CAST(split_part(alerts.sensor_id, '#', 2) AS BIGINT) AS batch_id, sensor AS sensor_id, timestamp,
       {R('(value - m) / s')} AS value_scaled, severity
FROM alerts JOIN model ON sensor = split_part(alerts.sensor_id, '#', 1)"""
    out["stream_quarantine"] = """
SELECT CASE WHEN event_id % 101 = 0 THEN 'missing timestamp' WHEN event_id % 89 = 0 THEN 'unparsable timestamp'
            WHEN event_id % 83 = 0 THEN 'missing timestamp' WHEN event_id % 97 = 0 THEN 'missing sensor' ELSE 'kept' END AS outcome, count(*) AS n
FROM events GROUP BY 1"""
    out["windowed_stats"] = f"""WITH {RAW}
SELECT sensor_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start,
       time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS window_end,
       count(value) AS n, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS stddev,
       max(value) AS max, min(value) AS min
FROM src GROUP BY 1, 2, 3"""
    return out


ORACLE_SQL = _sql()
