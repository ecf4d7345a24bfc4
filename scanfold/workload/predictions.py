"""Queries over predictions, patterns, summaries and the report.

The test stand-in for a model: prediction is the heuristic label, probability is
score/20 up to 1, and the raw anomaly score is the negative score.
"""

from pyspark.sql import functions as F

from scanfold.functions import host_rules as H
from scanfold.operators import baseline as B
from scanfold.operators import features as FE
from scanfold.operators import hosts as HO
from scanfold.operators import patterns as PA
from scanfold.operators import policy as PY
from scanfold.operators import ports as PO
from scanfold.plans import reports
from scanfold.sinks import tables as SK
from scanfold.sources import driver_tables as D
from scanfold.sources import tables as ST
from scanfold.sources.workspace import new_path, stored
from scanfold.values import rules as R
from scanfold.values.columns import EXPORT_COLUMNS
from scanfold.workload import query
from scanfold.workload.baseline import REPORT
from scanfold.workload.baseline import diff as scan_diff
from scanfold.workload.hosts import EXPLAINED, LABEL
from scanfold.workload.oracle_base import CHANGE, SEVERITY, TRIAGE, case, quote, text_sql, with_views

KEYS = ["scan_id", "ip"]


def labelled(spark, d):
    return HO.add_labels(FE.host_features(D.port_obs(spark, d)))


def with_scores(rows):
    return rows.selectExpr(
        "*", "label AS prediction",
        "least(cast(heuristic_score AS double) / 20D, 1D) AS predicted_probability_suspicious",
        "-cast(heuristic_score AS double) AS raw_score")


def scored(spark, d):
    return with_scores(labelled(spark, d))


def predictions(spark, d, changes=None):
    """The prediction table. Ports and scores are read several times, so they are written once; of the
    scripts only the number counts."""
    ports = D.port_obs(spark, d).drop("extrainfo", "service_source", "service_method", "service_confidence", "service_ostype", "state_reason")
    ports = stored(ports.withColumn("scripts", F.transform("scripts", lambda x: x["id"])), "ports")
    raw = stored(with_scores(HO.add_labels(FE.host_features(ports))), "scores")
    rows = HO.score_anomaly(raw).drop("raw_score", "label", "label_confidence")
    flags = B.change_flags(scan_diff(spark, d, ports)) if changes is None else changes
    built = HO.build_predictions(rows, PO.risky_hosts(ports), flags)
    return PY.override_trusted(built, D.trusted_hosts(spark, d))


def with_predictions(select, extra=""):
    return with_views("predictions", select, extra)


@query("severity", with_views("scores", f"SELECT scan_id, ip, {SEVERITY} AS severity FROM raw"))
def severity(spark, d):
    return scored(spark, d).select(*KEYS, H.severity("predicted_probability_suspicious").alias("severity"))


@query("anomaly_minmax", with_views("scores", "SELECT scan_id, ip, raw_score, anomaly_score FROM anomalies"))
def anomaly_minmax(spark, d):
    return HO.score_anomaly(scored(spark, d)).select(*KEYS, "raw_score", "anomaly_score")


@query("minmax_bounds", with_views("scores", "SELECT scan_id, raw_min, raw_max FROM bounds"))
def minmax_bounds(spark, d):
    return HO.minmax_bounds(scored(spark, d))


@query("baseline_change_score", with_views("features diff", f"""
SELECT scan_id, ip, CAST({CHANGE} AS DOUBLE) AS baseline_score FROM features LEFT JOIN flags USING (scan_id, ip)"""))
def baseline_change_score(spark, d):
    hosts = D.hosts(spark, d).select(*KEYS)
    return hosts.join(B.change_flags(scan_diff(spark, d)), KEYS, "left").select(
        *KEYS, H.baseline_change_score().alias("baseline_score"))


@query("join_baseline_score", with_views("scores diff", """
SELECT scan_id, ip, prediction, coalesce(is_new_host, false) AS is_new_host,
  coalesce(has_opened_port, false) AS has_opened_port, coalesce(has_version_change, false) AS has_version_change
FROM raw LEFT JOIN flags USING (scan_id, ip)"""))
def join_baseline_score(spark, d):
    return scored(spark, d).join(B.change_flags(scan_diff(spark, d)), KEYS, "left").selectExpr(
        *KEYS, "prediction", *[f"coalesce({c}, false) AS {c}" for c, _ in R.CHANGE_SCORES])


@query("risk_score", with_predictions("SELECT scan_id, ip, risk_score, anomaly_score, asset_type FROM pred1"))
def risk_score(spark, d):
    rows = HO.score_anomaly(scored(spark, d))
    joined = rows.join(B.change_flags(scan_diff(spark, d)), KEYS, "left").withColumn(
        "top_risk_ports", F.lit("None"))
    return HO.complete_predictions(joined).select(*KEYS, "risk_score", "anomaly_score", "asset_type")


@query("triage_status", with_views("scores alerts", f"""
SELECT scan_id, ip, {TRIAGE} AS triage_status FROM (
  SELECT r.*, coalesce(s.top, 0.0) AS top FROM raw r LEFT JOIN alert_sums s USING (scan_id, ip))"""))
def triage_status(spark, d):
    return scored(spark, d).withColumn("alert_list", H.host_alerts()).select(*KEYS, F.expr(
        H.triage_status_sql("prediction", "predicted_probability_suspicious", "alert_list")).alias("triage_status"))


GUIDANCE = case([(f"triage_status = {quote(n)}", quote(t)) for n, t in
                 [(n, t) for n, _, _, t in R.TRIAGE_RULES] + [R.TRIAGE_MONITOR]])


@query("triage_guidance", with_predictions(f"SELECT scan_id, ip, triage_status, {GUIDANCE} AS guidance FROM predictions"))
def triage_guidance(spark, d):
    return predictions(spark, d).select(
        *KEYS, "triage_status", H.triage_guidance("triage_status").alias("guidance"))


OVERRIDE = ["prediction", "predicted_probability_suspicious", "risk_score", "severity", "triage_status", "alerts"]


@query("trusted_override", with_predictions(f"SELECT scan_id, ip, asset_type, {', '.join(OVERRIDE)} FROM predictions"))
def trusted_override(spark, d):
    return predictions(spark, d).select(*KEYS, "asset_type", *OVERRIDE)


@query("join_trusted", with_predictions("""
SELECT scan_id, p.ip, prediction, t.ip IS NOT NULL AS is_trusted FROM pred1 p LEFT JOIN trusted t ON p.ip = t.ip"""))
def join_trusted(spark, d):
    return PY.mark_trusted(scored(spark, d).select(*KEYS, "prediction"), D.trusted_hosts(spark, d))


EXPORT = "SELECT scan_id, " + ", ".join(
    "round(predicted_probability_suspicious, 4) AS probability_suspicious" if c == "probability_suspicious" else c
    for c in EXPORT_COLUMNS) + " FROM predictions"


@query("predictions_table", with_predictions(EXPORT))
def predictions_table(spark, d):
    return HO.export_predictions(predictions(spark, d))


@query("predictions_export", with_predictions(EXPORT))
def predictions_export(spark, d):
    path = new_path(spark, "predictions")
    SK.write_predictions(predictions(spark, d), path, "parquet")
    return spark.read.parquet(path)


@query("predictions_source", with_predictions(EXPORT))
def predictions_source(spark, d):
    path = new_path(spark, "predictions")
    SK.write_predictions(predictions(spark, d), path)
    return ST.read_predictions_csv(spark, path)


BASIC = "scan_id, ip, prediction, severity, risk_score"


@query("suspicious_only", with_predictions(f"SELECT {BASIC} FROM predictions WHERE prediction = 'suspicious'"))
def suspicious_only(spark, d):
    return HO.suspicious_only(predictions(spark, d)).select(*BASIC.split(", "))


@query("severity_filter", with_predictions(f"""
SELECT {BASIC} FROM predictions WHERE severity IN ('CRITICAL', 'LOW')"""))
def severity_filter(spark, d):
    return HO.severity_filter(predictions(spark, d), ["CRITICAL", "LOW"], show_all=True).select(*BASIC.split(", "))


@query("triaged_only", with_predictions(f"""
SELECT {BASIC}, triage_status FROM predictions WHERE triage_status NOT IN ({quote(R.TRIAGE_NONE)}, '')"""))
def triaged_only(spark, d):
    return HO.triaged_only(predictions(spark, d)).select(*BASIC.split(", "), "triage_status")


# --- summaries ----------------------------------------------------------------

SUMMARY = """SELECT scan_id, count(*) AS total, count(*) FILTER (WHERE prediction = 'normal') AS normal,
  count(*) FILTER (WHERE prediction = 'suspicious') AS suspicious, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
  count(*) FILTER (WHERE severity = 'HIGH') AS high FROM predictions GROUP BY scan_id"""


@query("report_summary", with_predictions(SUMMARY))
def report_summary(spark, d):
    return HO.report_summary(predictions(spark, d))


@query("dashboard_metrics", with_predictions("""
SELECT count(*) AS total_hosts, count(*) FILTER (WHERE prediction = 'suspicious') AS suspicious,
  count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
  count(*) FILTER (WHERE triage_status = 'Immediate Action') AS immediate_action,
  count(*) FILTER (WHERE triage_status = 'Investigate') AS investigate FROM predictions"""))
def dashboard_metrics(spark, d):
    return HO.dashboard_metrics(predictions(spark, d))


DISTRIBUTION = """
SELECT rank, s.severity, count(p.ip) AS hosts FROM (VALUES (0, 'CRITICAL'), (1, 'HIGH'), (2, 'MEDIUM'), (3, 'LOW')) s(rank, severity)
LEFT JOIN {source} p ON p.severity = s.severity GROUP BY rank, s.severity"""


@query("severity_distribution", with_predictions(DISTRIBUTION.format(source="predictions")))
def severity_distribution(spark, d):
    return HO.severity_distribution(predictions(spark, d))


@query("severity_dim_join", with_predictions(DISTRIBUTION.format(
    source="(SELECT * FROM predictions WHERE prediction = 'normal')")))
def severity_dim_join(spark, d):
    return HO.severity_distribution(predictions(spark, d).filter("prediction = 'normal'"))


@query("triage_distribution", with_predictions(f"""
SELECT triage_status, count(*) AS hosts FROM predictions WHERE triage_status NOT IN ({quote(R.TRIAGE_NONE)}, '') GROUP BY 1"""))
def triage_distribution(spark, d):
    return HO.triage_distribution(predictions(spark, d))


# --- patterns ----------------------------------------------------------------

PATTERN_HITS = "\npattern_hosts AS (" + " UNION ALL ".join(
    f"SELECT scan_id, ip, hostname, {quote(r[0])} AS pattern_id FROM predictions WHERE {r[4]}"
    for r in R.NETWORK_PATTERNS) + ")"
PATTERNS = PATTERN_HITS + """,
patterns AS (""" + " UNION ALL ".join(
    f"SELECT scan_id, {i} AS pattern_order, pattern_id, {quote(r[1])} AS name, {quote(r[2])} AS severity, "
    f"count(*) AS affected_count, {text_sql(r[5], n='count(*)')} AS description, CAST({quote(r[6])} AS VARCHAR) AS mitre, "
    f"{quote(r[7])} AS recommendation FROM pattern_hosts WHERE pattern_id = {quote(r[0])} "
    f"GROUP BY scan_id, pattern_id HAVING count(*) >= {r[3]}" for i, r in enumerate(R.NETWORK_PATTERNS)) + """),
affected AS (SELECT h.* FROM pattern_hosts h SEMI JOIN patterns USING (scan_id, pattern_id))"""


@query("pattern_cross", with_predictions("SELECT * FROM pattern_hosts", PATTERN_HITS))
def pattern_cross(spark, d):
    return PA.pattern_hosts(predictions(spark, d))


@query("network_patterns", with_predictions("SELECT * FROM patterns", PATTERNS))
def network_patterns(spark, d):
    return PA.network_patterns(predictions(spark, d))


@query("pattern_affected_hosts", with_predictions("SELECT scan_id, pattern_id, ip, hostname FROM affected", PATTERNS))
def pattern_affected_hosts(spark, d):
    return PA.affected_hosts(stored(predictions(spark, d), "predictions"))


@query("patterns_sink", with_predictions("SELECT scan_id, pattern_id, affected_count, mitre FROM patterns", PATTERNS))
def patterns_sink(spark, d):
    path = new_path(spark, "patterns")
    SK.write_json(PA.network_patterns(predictions(spark, d)), path)
    return spark.read.schema("scan_id string, pattern_id string, affected_count bigint, mitre string").json(path)


# --- rankings ----------------------------------------------------------------

RANK_COLUMNS = "scan_id, ip, hostname, predicted_probability_suspicious, severity, triage_status"
RANKED = f"""SELECT {RANK_COLUMNS}, row_number() OVER (PARTITION BY scan_id
  ORDER BY predicted_probability_suspicious DESC, ip) AS rank FROM predictions WHERE prediction = 'suspicious'"""


@query("rank_suspicious", with_predictions(RANKED))
def rank_suspicious(spark, d):
    return HO.rank_suspicious(predictions(spark, d))


@query("top3_risks", with_predictions(f"""
SELECT {RANK_COLUMNS} FROM predictions WHERE prediction = 'suspicious'
ORDER BY predicted_probability_suspicious DESC, scan_id, ip LIMIT 3"""))
def top3_risks(spark, d):
    return HO.top_risks(predictions(spark, d))


@query("top3_risks_per_scan", with_predictions(f"SELECT * REPLACE (CAST(rank AS INT) AS rank) FROM ({RANKED}) WHERE rank <= 3"))
def top3_risks_per_scan(spark, d):
    return HO.top_risks_per_scan(predictions(spark, d))


@query("risk_ranking", with_predictions(f"SELECT scan_id, ip, {LABEL} AS host_label, risk_score, severity FROM predictions"))
def risk_ranking(spark, d):
    return HO.risk_ranking(predictions(spark, d))


@query("anomaly_ranking", with_predictions(f"""
SELECT scan_id, ip, {LABEL} AS host_label, anomaly_score, prediction FROM predictions
WHERE (SELECT max(anomaly_score) FROM predictions) > 0.01"""))
def anomaly_ranking(spark, d):
    return HO.anomaly_ranking(stored(predictions(spark, d), "predictions"))


@query("top3_alerts", with_predictions("""
SELECT p.scan_id, p.ip, CAST(coalesce(n, 0) AS INT) AS alert_count, coalesce(tops, '') AS top_alerts FROM predictions p
LEFT JOIN alert_sums USING (scan_id, ip)
LEFT JOIN (SELECT scan_id, ip, string_agg(severity || ' ' || title, '; ' ORDER BY pos) AS tops FROM alerts WHERE pos < 3
  GROUP BY scan_id, ip) USING (scan_id, ip) WHERE prediction = 'suspicious'"""))
def top3_alerts(spark, d):
    return HO.top_alerts(predictions(spark, d)).select(*KEYS, "alert_count", F.expr(
        "array_join(transform(top_alerts, a -> concat(a.severity, ' ', a.title)), '; ') AS top_alerts"))


# --- report ----------------------------------------------------------------

TABLE_LINE = """format('{:<15} {:<20} {:<12} {:.2f}   {:<10} {:<18} {:<16} {:<6} {:<6}', ip, hostname, upper(prediction),
  predicted_probability_suspicious, severity, triage_status, asset_type, open_port_count, risky_port_count)"""


@query("host_table_line", with_predictions(f"SELECT scan_id, ip, {TABLE_LINE} AS line FROM predictions"))
def host_table_line(spark, d):
    return reports.host_table_line(predictions(spark, d))


PATTERN_LINES = PATTERNS + """,
pattern_lines AS (
  SELECT scan_id, pattern_id, 1 AS part, '' AS ip, '[' || severity || '] ' || name AS line FROM patterns
  UNION ALL SELECT scan_id, pattern_id, 2, '', '    Affected hosts (' || affected_count || '):' FROM patterns
  UNION ALL SELECT scan_id, pattern_id, 3, ip, '      - ' || CASE WHEN hostname = '' THEN ip ELSE ip || ' (' || hostname || ')' END FROM affected
  UNION ALL SELECT scan_id, pattern_id, 4, '', '    ' || description FROM patterns
  UNION ALL SELECT scan_id, pattern_id, 5, '', '    MITRE: ' || mitre FROM patterns WHERE mitre IS NOT NULL
  UNION ALL SELECT scan_id, pattern_id, 6, '', '    Recommendation: ' || recommendation FROM patterns)"""


@query("pattern_report", with_predictions("SELECT * FROM pattern_lines", PATTERN_LINES))
def pattern_report(spark, d):
    rows = stored(predictions(spark, d), "predictions")
    return reports.pattern_report(PA.network_patterns(rows), PA.affected_hosts(rows))


DETAILS = EXPLAINED.replace("FROM features)", "FROM predictions WHERE prediction = 'suspicious')") + f""",
alert_lines AS (
  SELECT scan_id, ip, flatten(list(['  [' || severity || '] ' || title, '    ' || message] ORDER BY pos)) AS alert_texts
  FROM alerts GROUP BY scan_id, ip),
detail_lists AS (
  SELECT scan_id, ip, predicted_probability_suspicious, flatten([
    ['IP: ' || ip, 'Hostname  : ' || hostname, 'Asset Type: ' || asset_type, 'Severity  : ' || {SEVERITY},
     'Triage    : ' || triage_status, 'Risk Score: ' || CAST(risk_score AS VARCHAR) || '/100',
     'Confidence: ' || format('{{:.3f}}', predicted_probability_suspicious),
     'Top Risk Ports: ' || top_risk_ports, 'Why flagged:'],
    list_transform(explanation, lambda t: '  ' || t),
    CASE WHEN alert_texts IS NULL THEN [] ELSE list_concat(['Security Alerts:'], alert_texts) END,
    ['Recommendations:'],
    list_transform(CASE WHEN len(recs) = 0 THEN [{quote(R.DEFAULT_RECOMMENDATION)}] ELSE recs END, lambda t: '- ' || t)]) AS texts
  FROM explained LEFT JOIN alert_lines USING (scan_id, ip))"""
DETAIL_ROWS = """SELECT scan_id, ip, predicted_probability_suspicious, CAST(i - 1 AS INT) AS line_no, texts[i] AS line
FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM detail_lists)"""


@query("suspicious_detail", with_predictions(DETAIL_ROWS, DETAILS))
def suspicious_detail(spark, d):
    return reports.suspicious_detail(predictions(spark, d))


REPORT_SQL = DETAILS + "," + PATTERN_LINES + "," + REPORT + f""",
sums AS ({SUMMARY}),
report_lines AS (
  SELECT scan_id, 1 AS section, unnest(['================ NETWORK SECURITY ANALYSIS ================',
    'Total Hosts Scanned: ' || total, 'Normal Hosts: ' || normal, 'Suspicious Hosts: ' || suspicious,
    'Critical: ' || critical || '  |  High: ' || high]) AS line FROM sums
  UNION ALL SELECT scan_id, 2, rank || '. ' || ip || ' (' || hostname || ') — ' || severity ||
    CASE WHEN triage_status IN ('', {quote(R.TRIAGE_NONE)}) THEN '' ELSE ' [' || triage_status || ']' END FROM ({RANKED}) WHERE rank <= 3
  UNION ALL SELECT scan_id, 3, line FROM report
  UNION ALL SELECT scan_id, 4, line FROM pattern_lines
  UNION ALL SELECT scan_id, 5, {TABLE_LINE} FROM predictions
  UNION ALL SELECT scan_id, 6, line FROM ({DETAIL_ROWS}))"""


@query("prediction_report", with_predictions("SELECT scan_id, section, line FROM report_lines", REPORT_SQL))
def prediction_report(spark, d):
    diff = stored(scan_diff(spark, d), "diff")
    rows = stored(predictions(spark, d, B.change_flags(diff)), "predictions")
    return reports.prediction_report(rows, diff).select("scan_id", "section", "line")
