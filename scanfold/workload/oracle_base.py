"""DuckDB side of the driver table adapter and of the host features."""

from scanfold.sources import driver_tables as D
from scanfold.values import ports as V
from scanfold.values import rules as R


def quote(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in values) + ")"


def text_sql(text: str, **known: str) -> str:
    """A text with ``{column}`` places as a concatenation."""
    import re
    parts = []
    for piece in re.split(r"(\{\w+\})", text):
        if piece.startswith("{"):
            parts.append(f"CAST({known.get(piece[1:-1], piece[1:-1])} AS VARCHAR)")
        elif piece:
            parts.append(quote(piece))
    return "(" + " || ".join(parts) + ")"


def case(pairs, otherwise=None) -> str:
    """CASE over (condition, SQL value) pairs."""
    body = " ".join(f"WHEN {cond} THEN {value}" for cond, value in pairs)
    return f"CASE {body}" + (f" ELSE {otherwise}" if otherwise is not None else "") + " END"


def listed(pairs) -> str:
    """List of the SQL values whose condition holds, in order."""
    items = ", ".join(f"CASE WHEN {cond} THEN {value} END" for value, cond in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


LINES = f"""
lines AS (
  SELECT 'scan-' || CAST(year(l_shipdate) AS VARCHAR) || 'Q' || CAST(quarter(l_shipdate) AS VARCHAR) AS scan_id,
    l_suppkey AS supp, l_linenumber AS line,
    CASE WHEN l_linenumber <= 3 THEN (l_partkey + l_linenumber * 7) % {len(D.CATALOG_PORTS)}
         ELSE list_extract({sql_list(D.EVERYDAY)}, CAST(l_partkey % {len(D.EVERYDAY)} + 1 AS INT)) END AS idx,
    CASE WHEN l_tax = 0 THEN 'udp' ELSE 'tcp' END AS protocol,
    l_returnflag, l_quantity, l_discount
  FROM lineitem)"""

IP = """CAST(line + 10 + (supp >> 24) * 8 AS VARCHAR) || '.' || CAST((supp >> 16) & 255 AS VARCHAR)
    || '.' || CAST((supp >> 8) & 255 AS VARCHAR) || '.' || CAST(supp & 255 AS VARCHAR)"""

HOSTNAME = f"""CASE WHEN list_extract({sql_list(D.HOST_NAMES)}, line) = '' THEN ''
    ELSE list_extract({sql_list(D.HOST_NAMES)}, line) || '-' || CAST(supp AS VARCHAR) END"""

OBS = f"""
grouped AS (
  SELECT scan_id, supp, line, protocol, idx, min(l_returnflag) AS low_flag,
    CAST(CAST(min(l_quantity) AS INT) AS VARCHAR) AS low_qty, CAST(max(l_quantity) AS INT) AS top_qty,
    min(l_discount) AS low_discount
  FROM lines GROUP BY ALL),
named AS (
  SELECT *, list_extract({sql_list(D.CATALOG_PORTS)}, CAST(idx + 1 AS INT)) AS port,
    list_extract({sql_list(D.CATALOG_SERVICES)}, CAST(idx + 1 AS INT)) AS service FROM grouped),
producted AS (
  SELECT *, CASE WHEN trim(lower(service)) IN ('', 'unknown') THEN '' ELSE service END AS product FROM named),
obs AS (
  SELECT scan_id, {IP} AS ip, {HOSTNAME} AS hostname,
    CAST(idx * 2 + CASE WHEN protocol = 'udp' THEN 1 ELSE 0 END AS INT) AS pos,
    protocol, CAST(port AS INT) AS port, service, 'nmap' AS service_source, product,
    CASE WHEN low_discount = 0 THEN '' ELSE 'v' || low_flag END AS version,
    CASE WHEN low_flag = 'R' THEN 'flag R' ELSE '' END AS extrainfo,
    CASE WHEN product = '' THEN '' ELSE 'probed' END AS service_method,
    CASE WHEN product = '' THEN '' ELSE '10' END AS service_confidence,
    '' AS service_ostype,
    CASE WHEN port IN {in_list(D.SSL_PORTS)} THEN 'ssl' ELSE '' END AS tunnel,
    CASE WHEN protocol = 'udp' THEN 'udp-response' ELSE 'syn-ack' END AS state_reason,
    ([{{'id': 'banner', 'output': ' low ' || chr(9) || ' quantity' || chr(10) || low_qty || '  '}},
     {{'id': 'title', 'output': ''}},
     {{'id': 'notes', 'output': repeat('line of notes, ', top_qty) || service}},
     {{'id': 'extra', 'output': 'Left Out'}}])[1:CASE WHEN top_qty > 45 THEN 4 WHEN top_qty > 35 THEN 3
        WHEN top_qty > 20 THEN 1 ELSE 0 END] AS scripts
  FROM producted)"""

HOSTS = f"""
host_kinds AS (SELECT DISTINCT scan_id, supp, line FROM lines),
hosts AS (
  SELECT scan_id, {IP} AS ip, {HOSTNAME} AS hostname,
    CASE WHEN list_extract({sql_list(D.HOST_VENDORS)}, line) = '' THEN '' ELSE 'mac-' || CAST(supp AS VARCHAR) END AS mac,
    list_extract({sql_list(D.HOST_VENDORS)}, line) AS vendor,
    list_extract({sql_list(D.HOST_SYSTEMS)}, line) AS system
  FROM host_kinds)"""

SERVICE = "lower(coalesce(service, ''))"


def has_any(text, tokens):
    return "(" + " OR ".join(f"contains({text}, {quote(t)})" for t in tokens) + ")"


BUCKET = case([(has_any(SERVICE, tokens), quote(b)) for b, tokens in V.SERVICE_BUCKETS], quote(V.OTHER_BUCKET))
TOKEN_CATEGORY = case([(f"contains({SERVICE}, {quote(t)})", quote(c)) for t, c in V.SERVICE_TOKENS])

DIM = "dim(port, name, category, risk, score, description, recommendation) AS (VALUES " + ", ".join(
    f"({p}, {quote(n)}, {quote(c)}, {quote(r)}, {V.RISK_SCORES[r]}, {quote(d)}, {quote(a)})"
    for p, n, c, r, d, a in V.PORT_PROFILES) + ")"

PROFILED = f"""
{DIM},
profiled0 AS (
  SELECT o.*, coalesce(d.name, nullif({SERVICE}, ''), 'unknown') AS profile_name,
    coalesce(d.category, {TOKEN_CATEGORY}, {quote(V.UNPROFILED_CATEGORY)}) AS category,
    CASE WHEN contains({SERVICE}, {quote(V.CLEARTEXT_TOKEN)}) AND coalesce(d.score, 1) < 3 THEN 3
      ELSE coalesce(d.score, 1) END AS risk_score,
    coalesce(d.description, {quote(V.UNPROFILED_DESCRIPTION)}) AS description,
    coalesce(d.recommendation, {quote(V.UNPROFILED_RECOMMENDATION)}) AS recommendation
  FROM obs o LEFT JOIN dim d ON o.port = d.port),
profiled AS (
  SELECT *, list_extract(['low', 'medium', 'high', 'critical'], risk_score) AS risk_level, {BUCKET} AS bucket
  FROM profiled0)"""


def _feature_list() -> list:
    g = V.PORT_GROUPS

    def group(name):
        return f"port IN {in_list(g[name])}"
    count = [("risky_port_count", group("risky")), ("very_risky_port_count", group("very_risky")),
             ("critical_port_count", "risk_score >= 4"), ("high_detail_risk_port_count", "risk_score >= 3")]
    rest = [("uncommon_open_count", f"port > 1024 AND NOT ({group('common_high')})")]
    rest += [(f"{n}_count", group(n.removesuffix("_port"))) for n in (
        "remote_access", "cleartext", "admin_port", "iot_port", "mail", "db", "fileshare", "web")]
    rest += [("versioned_service_count", "product <> '' OR version <> ''"),
             ("unknown_service_count", "service = '' OR service = 'unknown'"),
             ("encrypted_service_count", f"tunnel = 'ssl' OR {group('encrypted')}")]
    profile = [(f"service_{b}_count", f"bucket = {quote(b)}") for b in
               [b for b, _ in V.SERVICE_BUCKETS] + [V.OTHER_BUCKET]]
    profile += [(f"profile_{c}_count", f"category = {quote(c)}") for c in V.COUNTED_CATEGORIES]

    def as_count(pairs):
        return [(n, f"CAST(count(*) FILTER (WHERE {c}) AS INT)") for n, c in pairs]
    return ([("open_port_count", "CAST(count(port) AS INT)")] + as_count(count)
            + [("max_port_risk_score", "CAST(coalesce(max(risk_score), 0) AS INT)"),
               ("avg_port_risk_score", "CAST(coalesce(avg(risk_score), 0) AS DOUBLE)")]
            + as_count(rest) + [("nse_script_count", "CAST(coalesce(sum(len(scripts)), 0) AS INT)")]
            + as_count(profile)
            + [(f, f"CAST(coalesce(bool_or(port IN {in_list(p)}), false) AS INT)") for f, p in V.HOST_FLAGS])


FEATURE_LIST = _feature_list()
FEATURE_NAMES = [name for name, _ in FEATURE_LIST]
_FEATURE_BODY = ",\n    ".join(f"{sql} AS {name}" for name, sql in FEATURE_LIST)

FEATURES = f"""
features AS (
  SELECT scan_id, ip, max(hostname) AS hostname, {_FEATURE_BODY}
  FROM profiled GROUP BY scan_id, ip)"""

SCORE = " + ".join([f"{flag} * {w}" for flag, w in R.FLAG_WEIGHTS]
                   + [f"CASE WHEN {c} >= {t} THEN {w} ELSE 0 END" for c, t, w in R.COUNT_WEIGHTS])

LABELLED = f"""
scored AS (SELECT *, CAST({SCORE} AS INT) AS heuristic_score FROM features),
labelled AS (
  SELECT *, CASE WHEN heuristic_score >= 5 THEN 'suspicious' ELSE 'normal' END AS label,
    round(0.5 + least(abs(heuristic_score - 5) / 10.0, 0.5), 3) AS label_confidence FROM scored)"""

_ALERT_LABELS = "array_to_string(" + listed([(quote(t), f"{f} = 1") for f, t in R.IOT_ALERT_LABELS]) + ", ' and ')"


def _alert_select(pos, rule):
    code, level, title, message, cond, ports = rule
    port_list = ("CAST([] AS INT[])" if not ports else
                 listed([(str(p), "true" if f is None else f"{f} = 1") for p, f in ports]))
    text = text_sql(message, labels=_ALERT_LABELS, ports=f"array_to_string({port_list}, ', ')")
    return (f"SELECT scan_id, ip, {pos} AS rule, {quote(code)} AS code, {quote(level)} AS severity, "
            f"{quote(title)} AS title, {text} AS message, array_to_string({port_list}, ',') AS ports "
            f"FROM labelled WHERE {cond}")


ALERTS = ("\nalert_hits AS (" + "\n UNION ALL ".join(
    _alert_select(i, rule) for i, rule in enumerate(R.ALERT_RULES)) + """),
alerts AS (SELECT *, row_number() OVER (PARTITION BY scan_id, ip ORDER BY rule) - 1 AS pos FROM alert_hits),
alert_sums AS (
  SELECT scan_id, ip, string_agg('[' || severity || '] ' || title, ' ; ' ORDER BY pos) AS summary,
    max(CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.75 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END) AS top,
    count(*) AS n FROM alerts GROUP BY scan_id, ip)""")

TOP_PORTS = """
top_ports AS (
  SELECT scan_id, ip, coalesce(string_agg(CAST(port AS VARCHAR) || '/' || risk_level, ';' ORDER BY pos)
    FILTER (WHERE risk_score >= 3), 'None') AS top_risk_ports FROM profiled GROUP BY scan_id, ip)"""

PORT_PROFILE = """
prof AS (
  SELECT scan_id, ip, port, max(hostname) AS hostname, arg_max(service, pos) AS service,
    arg_max(product, pos) AS product, arg_max(version, pos) AS version FROM obs GROUP BY scan_id, ip, port),
scans AS (SELECT DISTINCT scan_id FROM lines),
pairs AS (SELECT scan_id, lag(scan_id) OVER (ORDER BY scan_id) AS previous_scan_id FROM scans),
cur AS (SELECT p.* FROM prof p JOIN pairs x ON p.scan_id = x.scan_id WHERE x.previous_scan_id IS NOT NULL),
base AS (SELECT p.* REPLACE (x.scan_id AS scan_id) FROM prof p JOIN pairs x ON p.scan_id = x.previous_scan_id)"""

DIFF = PORT_PROFILE + """,
cur_hosts AS (SELECT DISTINCT scan_id, ip FROM cur),
base_hosts AS (SELECT DISTINCT scan_id, ip FROM base),
new_hosts AS (SELECT * FROM cur_hosts ANTI JOIN base_hosts USING (scan_id, ip)),
gone_hosts AS (SELECT * FROM base_hosts ANTI JOIN cur_hosts USING (scan_id, ip)),
opened AS (SELECT scan_id, ip, port FROM cur SEMI JOIN base_hosts USING (scan_id, ip) ANTI JOIN base USING (scan_id, ip, port)),
closed AS (SELECT scan_id, ip, port FROM base SEMI JOIN cur_hosts USING (scan_id, ip) ANTI JOIN cur USING (scan_id, ip, port)),
versions AS (
  SELECT c.scan_id, c.ip, c.port, c.service, trim(b.product || ' ' || b.version) AS from_version,
    trim(c.product || ' ' || c.version) AS to_version
  FROM cur c JOIN base b USING (scan_id, ip, port)
  WHERE trim(b.product || ' ' || b.version) <> '' AND trim(c.product || ' ' || c.version) <> ''
    AND trim(b.product || ' ' || b.version) <> trim(c.product || ' ' || c.version)),
changes AS (
  SELECT scan_id, ip, 'new_host' AS change_type, CAST(NULL AS INT) AS port, CAST(NULL AS VARCHAR) AS service,
    CAST(NULL AS VARCHAR) AS from_version, CAST(NULL AS VARCHAR) AS to_version FROM new_hosts
  UNION ALL SELECT scan_id, ip, 'gone_host', NULL, NULL, NULL, NULL FROM gone_hosts
  UNION ALL SELECT scan_id, ip, 'opened_port', port, NULL, NULL, NULL FROM opened
  UNION ALL SELECT scan_id, ip, 'closed_port', port, NULL, NULL, NULL FROM closed
  UNION ALL SELECT scan_id, ip, 'version_change', port, service, from_version, to_version FROM versions),
flags AS (
  SELECT h.scan_id, h.ip, n.ip IS NOT NULL AS is_new_host, o.ip IS NOT NULL AS has_opened_port,
    v.ip IS NOT NULL AS has_version_change
  FROM cur_hosts h LEFT JOIN new_hosts n USING (scan_id, ip)
  LEFT JOIN (SELECT DISTINCT scan_id, ip FROM opened) o USING (scan_id, ip)
  LEFT JOIN (SELECT DISTINCT scan_id, ip FROM versions) v USING (scan_id, ip))"""

TRUSTED = f"""
trusted AS (
  SELECT DISTINCT {IP} AS ip FROM (
    SELECT s_suppkey AS supp, unnest(range(1, 8)) AS line FROM supplier WHERE s_acctbal < 0))"""

IGNORED = f"""
ignored AS (
  SELECT DISTINCT list_extract({sql_list(D.CATALOG_PORTS)}, n_nationkey + 1) AS port FROM nation WHERE n_regionkey = 0)"""

SEVERITY = case([(f"p > {limit}", quote(name)) for name, limit in R.SEVERITY_LEVELS], "'LOW'")
ASSET = case([(cond, quote(name)) for name, cond in R.ASSET_RULES], "'unknown'")
CRITICALITY = case([(f"asset_type = {quote(a)}", str(v)) for a, v in R.ASSET_CRITICALITY], "0.5")
CHANGE = case([(f"coalesce({f}, false)", str(s)) for f, s in R.CHANGE_SCORES], "0.0")
TRIAGE = case([("prediction <> 'suspicious'", quote(R.TRIAGE_NONE))] + [
    (f"top >= {score} OR p > {limit}", quote(status))
    for (status, _, limit, _), (_, score) in zip(R.TRIAGE_RULES, R.ALERT_SCORES)], quote(R.TRIAGE_MONITOR[0]))
RECOMMENDED = listed([(quote(t), c) for t, c in R.RECOMMENDATIONS])

SCORES = """
raw AS (SELECT *, label AS prediction, least(CAST(heuristic_score AS DOUBLE) / 20, 1.0) AS p,
    -CAST(heuristic_score AS DOUBLE) AS raw_score FROM labelled),
bounds AS (SELECT scan_id, min(raw_score) AS raw_min, max(raw_score) AS raw_max FROM raw GROUP BY scan_id),
anomalies AS (
  SELECT r.*, CASE WHEN raw_max > raw_min THEN round(1 - (raw_score - raw_min) / (raw_max - raw_min), 4)
    ELSE 0.5 END AS anomaly_score FROM raw r JOIN bounds USING (scan_id))"""

PREDICTIONS = f"""
pred0 AS (
  SELECT a.*, {ASSET} AS asset_type, coalesce(s.top, 0.0) AS top, coalesce(s.summary, 'No alerts') AS alerts,
    {CHANGE} AS change_score, t.top_risk_ports, {RECOMMENDED} AS recs
  FROM anomalies a LEFT JOIN alert_sums s USING (scan_id, ip) LEFT JOIN top_ports t USING (scan_id, ip)
  LEFT JOIN flags USING (scan_id, ip)),
pred1 AS (
  SELECT *, p AS predicted_probability_suspicious, {SEVERITY} AS severity, {TRIAGE} AS triage_status,
    round(least(p * 40 + top * 30 + anomaly_score * 15 + change_score * 10 + ({CRITICALITY}) * 5, 100.0), 1) AS risk_score,
    CASE WHEN len(recs) = 0 THEN {quote(R.DEFAULT_RECOMMENDATION)} ELSE array_to_string(recs, ' ; ') END AS recommendations
  FROM pred0),
predictions AS (
  SELECT x.* REPLACE (
    CASE WHEN t.ip IS NULL THEN prediction ELSE 'normal' END AS prediction,
    CASE WHEN t.ip IS NULL THEN p ELSE 0.0 END AS p,
    CASE WHEN t.ip IS NULL THEN predicted_probability_suspicious ELSE 0.0 END AS predicted_probability_suspicious,
    CASE WHEN t.ip IS NULL THEN risk_score ELSE 0.0 END AS risk_score,
    CASE WHEN t.ip IS NULL THEN severity ELSE 'LOW' END AS severity,
    CASE WHEN t.ip IS NULL THEN triage_status ELSE {quote(R.TRIAGE_NONE)} END AS triage_status,
    CASE WHEN t.ip IS NULL THEN alerts ELSE '' END AS alerts)
  FROM pred1 x LEFT JOIN trusted t ON x.ip = t.ip)"""

# Views by name, each with the views it needs, in order.
PARTS = {
    "lines": ([], LINES), "obs": (["lines"], OBS), "hosts": (["lines"], HOSTS),
    "profiled": (["obs"], PROFILED), "features": (["profiled"], FEATURES),
    "labelled": (["features"], LABELLED), "alerts": (["labelled"], ALERTS),
    "top_ports": (["profiled"], TOP_PORTS), "prof": (["obs"], PORT_PROFILE), "diff": (["obs"], DIFF),
    "trusted": ([], TRUSTED), "ignored": ([], IGNORED), "scores": (["labelled"], SCORES),
    "predictions": (["scores", "alerts", "top_ports", "diff", "trusted"], PREDICTIONS),
}


def with_views(names: str, select: str, extra: str = "") -> str:
    """A query over the named views; ``extra`` holds further common table expressions."""
    order = []

    def add(name):
        for need in PARTS[name][0]:
            add(need)
        if name not in order:
            order.append(name)
    for name in names.split():
        add(name)
    parts = [PARTS[n][1] for n in order] + ([extra] if extra else [])
    return ("WITH " + ",".join(parts) + "\n" if parts else "") + select
