"""Queries over host features and host rules."""

from pyspark.sql import functions as F

from scanfold.functions import host_rules as H
from scanfold.operators import features as FE
from scanfold.operators import hosts as HO
from scanfold.operators import policy as PY
from scanfold.operators import training as TR
from scanfold.sources import driver_tables as D
from scanfold.sources.workspace import stored
from scanfold.values import rules as R
from scanfold.workload import query
from scanfold.workload.oracle_base import (ASSET, FEATURES, FEATURE_NAMES, PROFILED, listed, quote,
                                           text_sql, with_views)

KEYS = ["scan_id", "ip"]


def features(spark, d):
    return FE.host_features(D.port_obs(spark, d))


def labelled(spark, d):
    return HO.add_labels(features(spark, d))


@query("host_overview", with_views("labelled alerts", f"""
SELECT l.scan_id, l.ip, l.hostname, l.heuristic_score, l.label, {ASSET} AS asset_type,
  coalesce(s.summary, 'No alerts') AS alerts
FROM labelled l LEFT JOIN alert_sums s USING (scan_id, ip)"""))
def host_overview(spark, d):
    rows = labelled(spark, d).withColumn("alert_list", H.host_alerts())
    return rows.select(*KEYS, "hostname", "heuristic_score", "label", H.asset_type().alias("asset_type"),
                       H.alerts_summary("alert_list").alias("alerts"))


FEATURE_SELECT = "SELECT scan_id, ip, hostname, " + ", ".join(FEATURE_NAMES) + " FROM features"


@query("host_features", with_views("features", FEATURE_SELECT))
def host_features(spark, d):
    return features(spark, d)


@query("records_to_dataframe", with_views("features", FEATURE_SELECT))
def records_to_dataframe(spark, d):
    return FE.record_features(D.host_records(spark, d))


VISIBLE = f"""
visible AS (SELECT * FROM obs WHERE port NOT IN (SELECT port FROM ignored)),
{PROFILED.replace("FROM obs o", "FROM visible o").strip()},{FEATURES}"""


@query("ignored_port_features", with_views("obs hosts ignored", "SELECT h.scan_id, h.ip, h.hostname, " + ", ".join(
    f"coalesce(f.{n}, 0) AS {n}" for n in FEATURE_NAMES) + " FROM hosts h LEFT JOIN features f USING (scan_id, ip)", VISIBLE))
def ignored_port_features(spark, d):
    visible = PY.ignore_ports(D.port_obs(spark, d), D.ignore_ports(spark, d))
    return FE.host_features(visible, D.hosts(spark, d))


@query("zero_fill_missing", with_views("features", """
SELECT scan_id, ip, open_port_count, 0 AS has_ftp, 0 AS db_count FROM features"""))
def zero_fill_missing(spark, d):
    older = features(spark, d).drop("has_ftp", "db_count")
    return FE.zero_fill(older, FE.feature_columns()).select(*KEYS, "open_port_count", "has_ftp", "db_count")


@query("feature_columns", with_views("features", """
SELECT column_name AS feature, count(*) AS hosts, sum(CAST(value AS DOUBLE)) AS total FROM (
  UNPIVOT (SELECT """ + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in FEATURE_NAMES) + """ FROM features)
  ON COLUMNS(*) INTO NAME column_name VALUE value) GROUP BY column_name"""))
def feature_columns(spark, d):
    names = FE.feature_columns()
    totals = features(spark, d).agg(F.count("*").alias("hosts"), *[
        F.sum(F.col(n).cast("double")).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("total")) for n in names]))
    return totals.select("hosts", pairs.alias("x")).select("x.feature", "hosts", "x.total")


@query("heuristic_score", with_views("labelled", "SELECT scan_id, ip, heuristic_score FROM labelled"))
def heuristic_score(spark, d):
    return features(spark, d).select(*KEYS, H.heuristic_score().alias("heuristic_score"))


@query("heuristic_label", with_views("labelled", "SELECT scan_id, ip, label FROM labelled"))
def heuristic_label(spark, d):
    return labelled(spark, d).select(*KEYS, "label")


@query("label_confidence", with_views("labelled", "SELECT scan_id, ip, label_confidence FROM labelled"))
def label_confidence(spark, d):
    return labelled(spark, d).select(*KEYS, "label_confidence")


@query("asset_type", with_views("features", f"SELECT scan_id, ip, {ASSET} AS asset_type FROM features"))
def asset_type(spark, d):
    return features(spark, d).select(*KEYS, H.asset_type().alias("asset_type"))


CRITICALITY = "SELECT scan_id, ip, CAST(CASE asset_type " + " ".join(
    f"WHEN {quote(a)} THEN {v}" for a, v in R.ASSET_CRITICALITY) + " END AS DOUBLE) AS criticality FROM (SELECT *, "


@query("asset_criticality", with_views("features", CRITICALITY + f"{ASSET} AS asset_type FROM features)"))
def asset_criticality(spark, d):
    return features(spark, d).withColumn("asset", H.asset_type()).select(
        *KEYS, H.asset_criticality("asset").alias("criticality"))


@query("host_alerts", with_views("labelled alerts", """
SELECT scan_id, ip, CAST(pos AS INT) AS pos, code, severity, title, message, ports FROM alerts"""))
def host_alerts(spark, d):
    return HO.explode_alerts(features(spark, d)).withColumn(
        "ports", F.array_join(F.col("ports").cast("array<string>"), ","))


@query("alerts_summary", with_views("labelled alerts", """
SELECT l.scan_id, l.ip, coalesce(s.summary, 'No alerts') AS alerts FROM labelled l LEFT JOIN alert_sums s USING (scan_id, ip)"""))
def alerts_summary(spark, d):
    return features(spark, d).withColumn("alert_list", H.host_alerts()).select(*KEYS, H.alerts_summary("alert_list").alias("alerts"))


@query("max_alert_severity", with_views("labelled alerts", """
SELECT l.scan_id, l.ip, CAST(coalesce(s.top, 0) AS DOUBLE) AS alert_score FROM labelled l LEFT JOIN alert_sums s USING (scan_id, ip)"""))
def max_alert_severity(spark, d):
    return features(spark, d).withColumn("alert_list", H.host_alerts()).select(*KEYS, H.max_alert_score("alert_list").alias("alert_score"))


RECOMMENDED = listed([(quote(t), c) for t, c in R.RECOMMENDATIONS])


@query("recommendations", with_views("features", f"""
SELECT scan_id, ip, CASE WHEN len(recs) = 0 THEN {quote(R.DEFAULT_RECOMMENDATION)}
  ELSE array_to_string(recs, ' ; ') END AS recommendations FROM (SELECT *, {RECOMMENDED} AS recs FROM features)"""))
def recommendations(spark, d):
    return features(spark, d).select(*KEYS, F.array_join(H.recommendations(), " ; ").alias("recommendations"))


TRAINING_PORTS = listed([(quote(t), f"{f} = 1") for t, f in R.TRAINING_PORTS])
REASONS = listed([(quote(t), c) for t, c in R.RISK_REASONS])
TRAINING_TEXTS = f"""
  coalesce(nullif(array_to_string({TRAINING_PORTS}, ';'), ''), 'None') AS top_risk_ports,
  coalesce(nullif(array_to_string({REASONS}, ' ; '), ''), {quote(R.NO_REASON)}) AS risk_summary"""


@query("training_top_ports", with_views("features", f"SELECT scan_id, ip, top_risk_ports FROM (SELECT *, {TRAINING_TEXTS} FROM features)"))
def training_top_ports(spark, d):
    return features(spark, d).select(*KEYS, H.training_top_ports().alias("top_risk_ports"))


@query("risk_summary", with_views("features", f"SELECT scan_id, ip, risk_summary FROM (SELECT *, {TRAINING_TEXTS} FROM features)"))
def risk_summary(spark, d):
    return features(spark, d).select(*KEYS, H.risk_summary().alias("risk_summary"))


# --- explanation ----------------------------------------------------------------

SERVICES = " UNION ALL ".join(
    f"SELECT scan_id, ip, {i} AS rule, {quote(','.join(map(str, ports)))} AS ports, {quote(name)} AS name, "
    f"{quote(text)} AS description FROM features WHERE {flag} = 1"
    for i, (flag, ports, name, text) in enumerate(R.EXPLAINED_SERVICES))


@query("detected_services", with_views("features", f"""
SELECT scan_id, ip, CAST(row_number() OVER (PARTITION BY scan_id, ip ORDER BY rule) - 1 AS INT) AS pos, ports, name, description
FROM ({SERVICES})"""))
def detected_services(spark, d):
    return features(spark, d).select(*KEYS, F.posexplode(H.detected_services()).alias("pos", "s")).select(
        *KEYS, "pos", F.array_join(F.col("s.ports").cast("array<string>"), ",").alias("ports"),
        "s.name", "s.description")


ALL_PORTS = "list_sort(list_distinct(flatten([" + ", ".join(
    f"CASE WHEN {flag} = 1 THEN {ports} ELSE [] END" for flag, ports, _, _ in R.EXPLAINED_SERVICES) + "])))"


def flag_reason_sql():
    from scanfold.values.ports import PORT_GROUPS
    very = "(" + ", ".join(map(str, PORT_GROUPS["very_risky"])) + ")"
    return f"""CASE WHEN len(ps) > 0 THEN 'Flagged because: ' || len(ps) || ' known high-risk port(s) detected ('
      || len(list_filter(ps, lambda p: p IN {very})) || ' critical/very-high): ' || array_to_string(ps[1:7], ', ')
      || CASE WHEN len(ps) > 7 THEN ' (+' || (len(ps) - 7) || ' more)' ELSE '' END
    ELSE 'Flagged because: ' || open_port_count || ' open port(s) with ' || uncommon_open_count
      || ' uncommon/non-standard port(s)' END"""


@query("flag_reason", with_views("features", f"""
SELECT scan_id, ip, {flag_reason_sql()} AS flag_reason FROM (SELECT *, {ALL_PORTS} AS ps FROM features)"""))
def flag_reason(spark, d):
    return features(spark, d).withColumn("found", H.detected_ports()).select(
        *KEYS, H.flag_reason("found").alias("flag_reason"))


def text_list(rules):
    return listed([(text_sql(t), c) for t, c in rules])


def texts_query(rules, name):
    return with_views("features", f"""
SELECT scan_id, ip, array_to_string({text_list(rules)}, ' ; ') AS {name} FROM features""")


@query("dangerous_combos", texts_query(R.DANGEROUS_COMBOS, "combos"))
def dangerous_combos(spark, d):
    return features(spark, d).select(*KEYS, F.array_join(H.dangerous_combos(), " ; ").alias("combos"))


@query("exposure_patterns", texts_query(R.EXPOSURE_PATTERNS, "patterns"))
def exposure_patterns(spark, d):
    return features(spark, d).select(*KEYS, F.array_join(H.exposure_patterns(), " ; ").alias("patterns"))


def technique_services(services):
    return "array_to_string(" + listed([(quote(f"{n} ({p})"), f"{f} = 1") for f, p, n in services]) + ", ', ')"


TECHNIQUES = " UNION ALL ".join(
    f"SELECT scan_id, ip, {i} AS rule, {quote(code)} AS technique_id, {quote(name)} AS technique, "
    f"{quote(text)} AS description, {technique_services(services)} AS services FROM features"
    for i, (name, code, text, services) in enumerate(R.TECHNIQUES))


@query("mitre_mapping", with_views("features", f"""
SELECT scan_id, ip, CAST(row_number() OVER (PARTITION BY scan_id, ip ORDER BY rule) - 1 AS INT) AS pos,
  technique_id, technique, description, services FROM ({TECHNIQUES}) WHERE services <> ''"""))
def mitre_mapping(spark, d):
    return HO.explode_techniques(features(spark, d)).withColumn("services", F.array_join("services", ", "))


SURFACE = """array_to_string(list_filter([
  CASE WHEN open_port_count > 0 THEN open_port_count || ' total open port(s)' END,
  CASE WHEN risky_port_count > 0 THEN risky_port_count || ' rated high/critical risk ('
    || CAST(trunc(CAST(risky_port_count AS DOUBLE) / open_port_count * 100) AS INT) || '%)' END,
  CASE WHEN critical_port_count > 0 THEN critical_port_count || ' classified critical severity' END],
  lambda x: x IS NOT NULL), ' | ')"""


@query("attack_surface", with_views("features", f"SELECT scan_id, ip, {SURFACE} AS attack_surface FROM features"))
def attack_surface(spark, d):
    return features(spark, d).select(*KEYS, H.attack_surface().alias("attack_surface"))


def bulleted(items):
    return f"list_transform({items}, lambda t: '  • ' || t)"


def section(title, items):
    return f"CASE WHEN len({items}) > 0 THEN list_concat(['', {quote(title)}], {items}) ELSE [] END"


SERVICE_LINES = listed([
    (quote(f"  • {name:<18} port {'/'.join(map(str, ports)):<12}  {text}"), f"{flag} = 1")
    for flag, ports, name, text in R.EXPLAINED_SERVICES])
TECHNIQUE_LINES = "flatten([" + ", ".join(
    f"CASE WHEN {technique_services(s)} <> '' THEN [{quote(f'  • [{code}] {name:<20}  ')} || {technique_services(s)}, "
    f"{quote(f'    {chr(32) * 28}  ↳ {text}')}] ELSE [] END" for name, code, text, s in R.TECHNIQUES) + "])"
EXPLAINED = f"""
explained AS (SELECT f.*, flatten([[{flag_reason_sql()}],
    {section('Detected high-risk services:', SERVICE_LINES)},
    {section('Dangerous service combinations:', bulleted(text_list(R.DANGEROUS_COMBOS)))},
    {section('Exposure patterns:', bulleted(text_list(R.EXPOSURE_PATTERNS)))},
    {section('MITRE ATT&CK mapping:', TECHNIQUE_LINES)},
    CASE WHEN {SURFACE} <> '' THEN ['', 'Attack surface: ' || {SURFACE}] ELSE [] END]) AS explanation
  FROM (SELECT *, {ALL_PORTS} AS ps FROM features) f)"""


@query("host_explanation", with_views("features", """
SELECT scan_id, ip, CAST(i - 1 AS INT) AS line_no, explanation[i] AS line
FROM (SELECT *, unnest(range(1, len(explanation) + 1)) AS i FROM explained)""", EXPLAINED))
def host_explanation(spark, d):
    return H.with_explanation(features(spark, d)).select(
        *KEYS, F.posexplode("explanation").alias("line_no", "line"))


LABEL = "CASE WHEN trim(coalesce(hostname, '')) = '' THEN ip ELSE ip || ' (' || hostname || ')' END"


@query("host_label", with_views("features", f"SELECT scan_id, ip, {LABEL} AS host_label FROM features"))
def host_label(spark, d):
    return features(spark, d).select(
        *KEYS, H.host_name_label().alias("host_label"))


@query("mark_trusted", with_views("hosts trusted", """
SELECT scan_id, h.ip, hostname, t.ip IS NOT NULL AS is_trusted FROM hosts h LEFT JOIN trusted t ON h.ip = t.ip"""))
def mark_trusted(spark, d):
    return PY.mark_trusted(D.hosts(spark, d).select(*KEYS, "hostname"), D.trusted_hosts(spark, d))


@query("label_counts", with_views("labelled", "SELECT label, count(*) AS rows FROM labelled GROUP BY label"))
def label_counts(spark, d):
    return HO.label_counts(labelled(spark, d))


TRAINING_SELECT = "SELECT scan_id, ip, hostname, " + ", ".join(FEATURE_NAMES) + ", label, label_confidence FROM labelled"


@query("training_build", with_views("labelled", TRAINING_SELECT))
def training_build(spark, d):
    return TR.build_training(features(spark, d))


@query("augment_training", with_views("labelled", """
SELECT scan_id, ip, heuristic_score, label FROM labelled WHERE label = 'normal'
UNION SELECT scan_id, ip, heuristic_score, label FROM labelled"""))
def augment_training(spark, d):
    rows = stored(labelled(spark, d).select(*KEYS, "heuristic_score", "label"), "labelled")
    return TR.augment_training(rows.filter("label = 'normal'"), rows)


@query("class_weights", with_views("labelled", """
SELECT scan_id, ip, label, class_weight, class_weight * label_confidence AS weight FROM labelled
JOIN (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS class_weight FROM labelled GROUP BY label) USING (label)"""))
def class_weights(spark, d):
    return TR.class_weights(TR.build_training(features(spark, d))).select(
        *KEYS, "label", "class_weight", "weight")


@query("train_gate", with_views("labelled", """
SELECT count(*) AS rows, count(DISTINCT label) AS labels, CAST(NULL AS VARCHAR) AS note FROM labelled"""))
def train_gate(spark, d):
    return TR.train_gate(TR.build_training(features(spark, d)))


METRIC_COUNTS = """
guessed AS (SELECT *, CASE WHEN db_count >= 1 OR has_telnet = 1 THEN 'suspicious' ELSE 'normal' END AS prediction FROM labelled),
grid AS (SELECT scan_id, count(*) AS rows,
  count(*) FILTER (WHERE label = 'normal' AND prediction = 'normal') AS true_normal,
  count(*) FILTER (WHERE label = 'normal' AND prediction = 'suspicious') AS false_suspicious,
  count(*) FILTER (WHERE label = 'suspicious' AND prediction = 'normal') AS false_normal,
  count(*) FILTER (WHERE label = 'suspicious' AND prediction = 'suspicious') AS true_suspicious
  FROM guessed GROUP BY scan_id)"""


def ratio(part, whole):
    return f"coalesce(({part}) / nullif(CAST(({whole}) AS DOUBLE), 0), 0)"


@query("model_metrics", with_views("labelled", f"""
SELECT *, {ratio('true_normal + true_suspicious', 'rows')} AS accuracy,
  {ratio('true_suspicious', 'true_suspicious + false_suspicious')} AS precision_suspicious,
  {ratio('true_suspicious', 'true_suspicious + false_normal')} AS recall_suspicious,
  {ratio('2 * true_suspicious', '2 * true_suspicious + false_suspicious + false_normal')} AS f1_suspicious,
  {ratio('true_normal', 'true_normal + false_normal')} AS precision_normal,
  {ratio('true_normal', 'true_normal + false_suspicious')} AS recall_normal,
  {ratio('2 * true_normal', '2 * true_normal + false_suspicious + false_normal')} AS f1_normal FROM grid""", METRIC_COUNTS))
def model_metrics(spark, d):
    guessed = labelled(spark, d).withColumn("prediction", F.when(
        F.expr("db_count >= 1 OR has_telnet = 1"), "suspicious").otherwise("normal"))
    return TR.binary_metrics(guessed, ["scan_id"])
