"""Queries over open ports."""

from pyspark.sql import functions as F

from scanfold.functions import port_rules as P
from scanfold.operators import enrichment as E
from scanfold.operators import features as FE
from scanfold.operators import policy as PY
from scanfold.operators import ports as PO
from scanfold.plans import jobs, reports
from scanfold.sinks import tables as SK
from scanfold.sources import driver_tables as D
from scanfold.sources.workspace import new_path, stored
from scanfold.values import ports as V
from scanfold.values import rules as R
from scanfold.workload import query
from scanfold.workload.oracle_base import PROFILED, has_any, in_list, quote, with_views

WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def collapsed(text):
    return f"trim(regexp_replace({text}, {quote(WS)}, ' ', 'g'))"


def short(text):
    return f"CASE WHEN length({text}) > 140 THEN substr({text}, 1, 137) || '...' ELSE {text} END"


SUMMARY = f"""array_to_string(list_transform(scripts[1:3], lambda s: s.id || CASE WHEN {collapsed('s.output')} = '' THEN ''
  ELSE ': ' || {short(collapsed('s.output'))} END), ' | ')"""

PORT_COLUMNS = ["scan_id", "ip", "protocol", "port"]
DETAIL = f"""
detail AS (
  SELECT scan_id, ip, hostname, protocol, port, CASE WHEN service = '' THEN profile_name ELSE service END AS service,
    service_source, '' AS service_guess, '' AS device_guess, CAST(NULL AS DOUBLE) AS guess_confidence,
    '' AS guess_evidence, product, version, extrainfo, tunnel, state_reason, service_method,
    service_confidence, category, risk_level, risk_score, description, recommendation, {SUMMARY} AS script_summary
  FROM profiled)"""


@query("service_bucket", with_views("profiled", "SELECT scan_id, ip, protocol, port, bucket FROM profiled"))
def service_bucket(spark, d):
    return D.port_obs(spark, d).select(*PORT_COLUMNS, P.service_bucket().alias("bucket"))


PROFILE_SELECT = """SELECT scan_id, ip, protocol, port, profile_name AS name, category, risk_level,
  CAST(risk_score AS INT) AS risk_score, description, recommendation FROM profiled"""


@query("port_profile", with_views("profiled", """
SELECT scan_id, ip, protocol, port, category, CAST(risk_score AS INT) AS risk_score, risk_level FROM profiled"""))
def port_profile(spark, d):
    return D.port_obs(spark, d).select(
        *PORT_COLUMNS, P.port_category().alias("category"), P.port_risk_score().alias("risk_score")
    ).withColumn("risk_level", P.risk_level("risk_score"))


@query("join_port_profile", with_views("profiled", PROFILE_SELECT))
def join_port_profile(spark, d):
    return PO.join_port_profile(D.port_obs(spark, d)).select(
        *PORT_COLUMNS, "name", "category", "risk_level", "risk_score", "description", "recommendation")


@query("script_summary", f"""
WITH docs AS (SELECT doc_id, [{{'id': source, 'output': text}}, {{'id': lang, 'output': ''}},
  {{'id': 'size', 'output': CAST(n_chars AS VARCHAR)}}, {{'id': 'extra', 'output': text}}] AS scripts FROM documents)
SELECT doc_id, {SUMMARY} AS script_summary FROM docs""")
def script_summary(spark, d):
    docs = D.table(spark, d, "documents")
    scripts = F.array(*[F.struct(a.alias("id"), b.cast("string").alias("output")) for a, b in (
        (F.col("source"), F.col("text")), (F.col("lang"), F.lit("")),
        (F.lit("size"), F.col("n_chars")), (F.lit("extra"), F.col("text")))])
    return docs.select("doc_id", scripts.alias("scripts")).select("doc_id", P.script_summary().alias("script_summary"))


@query("script_text", with_views("obs", """
SELECT scan_id, ip, protocol, port, lower(array_to_string(flatten(list_transform(scripts, lambda s: [s.id, s.output])), ' ')) AS script_text
FROM obs"""))
def script_text(spark, d):
    return D.port_obs(spark, d).select(*PORT_COLUMNS, P.script_text().alias("script_text"))


@query("enrich_port", with_views("profiled", f"""
SELECT scan_id, ip, protocol, port, service, profile_name AS name, category, risk_level,
  CAST(risk_score AS INT) AS risk_score, {SUMMARY} AS script_summary FROM profiled"""))
def enrich_port(spark, d):
    return PO.enrich_ports(D.port_obs(spark, d)).select(
        *PORT_COLUMNS, "service", "name", "category", "risk_level", "risk_score", "script_summary")


@query("top_risk_ports", with_views("top_ports", "SELECT scan_id, ip, top_risk_ports FROM top_ports"))
def top_risk_ports(spark, d):
    return PO.top_risk_ports(D.port_obs(spark, d))


DETAIL_SELECT = "SELECT * REPLACE (CAST(risk_score AS INT) AS risk_score) FROM detail"


@query("port_detail_rows", with_views("profiled", DETAIL_SELECT, DETAIL))
def port_detail_rows(spark, d):
    return PO.port_details(D.port_obs(spark, d))


@query("port_details_sink", with_views("profiled", DETAIL_SELECT, DETAIL))
def port_details_sink(spark, d):
    path = new_path(spark, "details")
    SK.write_port_details(D.port_obs(spark, d), path)
    return spark.read.parquet(path)


@query("sorted_ports", with_views("obs", """
SELECT scan_id, ip, array_to_string(list_sort(list_distinct(list(port))), ',') AS ports FROM obs GROUP BY scan_id, ip"""))
def sorted_ports(spark, d):
    return PO.sorted_ports(D.port_obs(spark, d)).select(
        "scan_id", "ip", F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports"))


@query("distinct_ports", with_views("obs", "SELECT DISTINCT port FROM obs"))
def distinct_ports(spark, d):
    return PO.distinct_ports(D.port_obs(spark, d))


@query("ignore_ports", with_views("obs ignored", """
SELECT scan_id, ip, protocol, port, service FROM obs WHERE port NOT IN (SELECT port FROM ignored)"""))
def ignore_ports(spark, d):
    return PY.ignore_ports(D.port_obs(spark, d), D.ignore_ports(spark, d)).select(*PORT_COLUMNS, "service")


@query("port_profile_mix", with_views("profiled", """
SELECT scan_id, ip, 'category' AS kind, category AS name, count(*) AS port_count FROM profiled GROUP BY ALL
UNION ALL SELECT scan_id, ip, 'bucket', bucket, count(*) FROM profiled GROUP BY ALL"""))
def port_profile_mix(spark, d):
    return FE.port_mix(D.port_obs(spark, d))


# --- reports ----------------------------------------------------------------

def lined(source, texts):
    """SQL for numbered non-null lines of a row."""
    items = ", ".join(texts)
    return f"""
line_lists AS (SELECT scan_id, ip, port, protocol, list_filter([{items}], lambda x: x IS NOT NULL) AS texts FROM {source})"""


LINE_SELECT = """
SELECT scan_id, ip, port, protocol, CAST(i - 1 AS INT) AS line_no, texts[i] AS line
FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM line_lists)"""

RISK_LINE = """'  Risk: ' || upper(risk_level) || ' | Category: ' || category || ' | Score: ' || CAST(risk_score AS VARCHAR)"""
DETECTION = """CASE WHEN service_method <> '' OR service_confidence <> '' THEN '  Detection: method='
  || CASE WHEN service_method = '' THEN 'unknown' ELSE service_method END || ', confidence='
  || CASE WHEN service_confidence = '' THEN 'unknown' ELSE service_confidence END END"""
SCAN_LINES = DETAIL + "," + lined("detail", [
    """protocol || '/' || CAST(port AS VARCHAR) || '  ' || service || CASE WHEN trim(product || ' ' || version) <> ''
       THEN '  ' || trim(product || ' ' || version) ELSE '' END""",
    RISK_LINE, "'  Detail: ' || description", "'  Action: ' || recommendation",
    "CASE WHEN state_reason <> '' THEN '  Nmap reason: ' || state_reason END", DETECTION,
    "CASE WHEN extrainfo <> '' THEN '  Extra info: ' || extrainfo END",
    "CASE WHEN script_summary <> '' THEN '  NSE: ' || script_summary END"])


@query("scan_report_rows", with_views("profiled", LINE_SELECT, SCAN_LINES))
def scan_report_rows(spark, d):
    return reports.scan_report_rows(D.port_obs(spark, d))


@query("scan_report_job", with_views("profiled", LINE_SELECT, SCAN_LINES))
def scan_report_job(spark, d):
    return jobs.scan_report_job(D.host_records(spark, d), new_path(spark, "scan-report"))


@query("report_sink", with_views("profiled", """
SELECT scan_id, line FROM (SELECT scan_id, unnest(texts) AS line FROM line_lists)""", SCAN_LINES))
def report_sink(spark, d):
    path = new_path(spark, "report")
    SK.write_report(reports.scan_report_rows(D.port_obs(spark, d)), path)
    return spark.read.schema("line string, scan_id string").text(path).withColumnRenamed("value", "line")


# --- unknown ports -------------------------------------------------------------

UNKNOWN = "trim(lower(service)) IN ('', 'unknown')"


@query("unknown_port_flag", with_views("obs", f"SELECT scan_id, ip, protocol, port, {UNKNOWN} AS is_unknown FROM obs"))
def unknown_port_flag(spark, d):
    return D.port_obs(spark, d).select(*PORT_COLUMNS, P.is_unknown_service().alias("is_unknown"))


SECOND = f"""
second AS (
  SELECT * REPLACE ('probed' AS service_method, '7' AS service_confidence, 'second look' AS product,
    CASE WHEN version = '' OR version = 'vN' THEN 'unknown' ELSE 'resolved-' || CAST(port AS VARCHAR) END AS service)
  FROM obs WHERE {UNKNOWN}),
merged AS (
  SELECT o.scan_id, o.ip, o.hostname, o.pos, o.protocol, o.port, coalesce(s.service, o.service) AS service,
    CASE WHEN s.ip IS NULL THEN o.service_source ELSE 'nmap_enriched' END AS service_source,
    coalesce(s.product, o.product) AS product, o.version, o.extrainfo,
    coalesce(s.service_method, o.service_method) AS service_method,
    coalesce(s.service_confidence, o.service_confidence) AS service_confidence, o.tunnel, o.scripts,
    CASE WHEN s.ip IS NOT NULL THEN o.service END AS original_service
  FROM obs o LEFT JOIN (SELECT * FROM second WHERE service <> 'unknown') s USING (scan_id, ip, protocol, port))"""


def merged_ports(spark, d):
    return E.merge_second_pass(D.port_obs(spark, d), D.second_pass(spark, d))


@query("merge_enriched", with_views("obs", """
SELECT scan_id, ip, protocol, port, service, service_source, product, service_method, service_confidence, original_service
FROM merged""", SECOND))
def merge_enriched(spark, d):
    return merged_ports(spark, d).select(*PORT_COLUMNS, "service", "service_source", "product",
                                         "service_method", "service_confidence", "original_service")


@query("has_enrichment", with_views("obs", """
SELECT scan_id, ip, protocol, port, service_source = 'nmap_enriched' AS has_enrichment FROM merged""", SECOND))
def has_enrichment(spark, d):
    return merged_ports(spark, d).select(*PORT_COLUMNS, P.has_enrichment().alias("has_enrichment"))


@query("default_service_source", with_views("obs", f"""
SELECT scan_id, ip, protocol, port, CASE WHEN extrainfo <> '' THEN service_source
  WHEN {UNKNOWN} THEN 'guess' ELSE 'nmap' END AS service_source FROM obs"""))
def default_service_source(spark, d):
    blanked = D.port_obs(spark, d).withColumn("service_source", F.when(
        F.col("extrainfo") != "", F.col("service_source")).otherwise(""))
    return E.set_default_sources(blanked).select(*PORT_COLUMNS, "service_source")


OPEN_QUESTION = f"{UNKNOWN} AND service_source <> 'nmap_enriched'"


@query("unknown_ports_by_host", with_views("obs", f"""
SELECT scan_id, ip, array_to_string(list_sort(list_distinct(list(port))), ',') AS ports
FROM merged WHERE {OPEN_QUESTION} GROUP BY scan_id, ip""", SECOND))
def unknown_ports_by_host(spark, d):
    return E.unknown_ports_by_host(merged_ports(spark, d)).select(
        "scan_id", "ip", F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports"))


@query("needs_enrichment", with_views("obs", f"""
SELECT scan_id, bool_or({OPEN_QUESTION}) AS needs_enrichment FROM merged GROUP BY scan_id""", SECOND))
def needs_enrichment(spark, d):
    return E.needs_enrichment(merged_ports(spark, d))


@query("enrichment_meta", with_views("obs", f"""
SELECT scan_id, count(DISTINCT ip) AS unknown_hosts, count(DISTINCT (ip, port)) AS unknown_ports
FROM obs WHERE {UNKNOWN} GROUP BY scan_id"""))
def enrichment_meta(spark, d):
    return E.enrichment_totals(D.port_obs(spark, d))


def context_sql(source):
    fields = "lower(service || ' ' || product || ' ' || version || ' ' || extrainfo || ' ' || array_to_string(flatten(list_transform(scripts, lambda s: [s.id, s.output])), ' '))"
    return f"""
words AS (
  SELECT scan_id, ip, string_agg({fields}, ' ') AS port_words, list(port) AS open_ports, list(lower(service)) AS services
  FROM {source} GROUP BY scan_id, ip),
context AS (
  SELECT h.scan_id, h.ip,
    lower(h.hostname || ' ' || h.vendor || ' ' || h.system || ' ' || w.port_words) AS text, w.open_ports, w.services
  FROM hosts h JOIN words w USING (scan_id, ip)),
signals AS (
  SELECT scan_id, ip,
    {has_any('text', R.APPLE_TOKENS)} OR list_contains(open_ports, 3031) OR list_contains(services, 'eppc') AS has_apple,
    {has_any('text', R.MEDIA_TOKENS)} AS has_media,
    {has_any('text', R.PRINTER_TOKENS)} OR list_contains(open_ports, 631) AS has_printer_sign,
    len(list_filter(open_ports, lambda p: p IN {in_list(V.PORT_GROUPS['web'])})) > 0 AS has_web_admin
  FROM context)"""


def guess_sql(source):
    """The guess steps, applied one after another."""
    s, v, c, e = R.GUESS_SERVICE, R.GUESS_DEVICE, R.GUESS_CONFIDENCE, R.GUESS_EVIDENCE
    return context_sql(source) + f""",
step1 AS (
  SELECT o.*, g.has_apple, g.has_media, g.has_printer_sign, g.has_web_admin, o.port >= 49152 AS eph,
    CASE WHEN o.port >= 49152 THEN {quote(s['ephemeral'])} ELSE {quote(s['none'])} END AS s1,
    CASE WHEN o.port >= 49152 THEN {c['ephemeral']} ELSE {c['none']} END AS c1
  FROM {source} o JOIN signals g USING (scan_id, ip)),
step2 AS (
  SELECT *, CASE WHEN has_apple AND eph THEN {quote(s['apple_dynamic'])}
      WHEN has_apple AND has_media THEN {quote(s['apple_media'])} ELSE s1 END AS s2,
    CASE WHEN has_apple AND eph THEN greatest(c1, {c['apple_dynamic']})
      WHEN has_apple AND has_media THEN greatest(c1, {c['apple_media']}) ELSE c1 END AS c2,
    CASE WHEN has_apple THEN {quote(v['apple'])} ELSE {quote(v['none'])} END AS d2 FROM step1),
step3 AS (
  SELECT *, CASE WHEN has_media AND NOT has_apple AND port IN {in_list(V.PORT_GROUPS['media'])} THEN {quote(s['media_port'])}
      WHEN has_media AND NOT has_apple AND eph THEN {quote(s['media_dynamic'])} ELSE s2 END AS s3,
    CASE WHEN has_media AND NOT has_apple AND port IN {in_list(V.PORT_GROUPS['media'])} THEN greatest(c2, {c['media_port']})
      WHEN has_media AND NOT has_apple AND eph THEN greatest(c2, {c['media_dynamic']}) ELSE c2 END AS c3,
    CASE WHEN has_media AND NOT has_apple THEN {quote(v['media'])} ELSE d2 END AS d3 FROM step2),
step4 AS (
  SELECT *, has_printer_sign AND NOT has_apple AND NOT has_media AS pr FROM step3),
step5 AS (
  SELECT *, CASE WHEN pr AND port >= 1024 THEN {quote(s['printer'])} ELSE s3 END AS s5,
    CASE WHEN pr THEN greatest(c3, {c['printer']}) ELSE c3 END AS c5,
    CASE WHEN pr THEN {quote(v['printer'])} ELSE d3 END AS d5 FROM step4),
step6 AS (
  SELECT *, d5 = {quote(v['none'])} AND has_web_admin AS wa FROM step5),
guesses AS (
  SELECT scan_id, ip, protocol, port, s5 AS service_guess,
    CASE WHEN wa THEN {quote(v['web_admin'])} ELSE d5 END AS device_guess,
    CAST(round(least(CASE WHEN wa THEN greatest(c5, {c['web_admin']}) ELSE c5 END, {c['max']}), 2) AS DOUBLE) AS guess_confidence,
    coalesce(nullif(concat_ws('; ', CASE WHEN eph THEN {quote(e['ephemeral'])} END,
      CASE WHEN has_apple THEN {quote(e['apple'])} END,
      CASE WHEN has_media AND NOT has_apple THEN {quote(e['media'])} END,
      CASE WHEN pr THEN {quote(e['printer'])} END,
      CASE WHEN wa THEN {quote(e['web_admin'])} END), ''), {quote(e['none'])}) AS guess_evidence
  FROM step6 WHERE {UNKNOWN})"""


@query("host_context", with_views("obs hosts", "SELECT scan_id, ip, has_apple, has_media, has_printer_sign, has_web_admin FROM signals",
                                  context_sql("obs")))
def host_context(spark, d):
    return E.host_context(D.port_obs(spark, d), D.hosts(spark, d))


GUESS_COLUMNS = ["service_guess", "device_guess", "guess_confidence", "guess_evidence"]


@query("guess_unknown_port", with_views("obs hosts", "SELECT * FROM guesses", guess_sql("obs")))
def guess_unknown_port(spark, d):
    return E.guess_unknown_ports(D.port_obs(spark, d), D.hosts(spark, d)).select(
        *PORT_COLUMNS, *GUESS_COLUMNS)


APPLIED = """
SELECT o.scan_id, o.ip, o.protocol, o.port, o.service, CASE WHEN g.ip IS NOT NULL THEN 'guess' ELSE o.service_source END AS service_source,
  g.service_guess, g.device_guess, g.guess_confidence, g.guess_evidence
FROM {source} o LEFT JOIN guesses g USING (scan_id, ip, protocol, port)"""


@query("apply_guesses", with_views("obs hosts", APPLIED.format(source="obs"), guess_sql("obs")))
def apply_guesses(spark, d):
    return E.apply_guesses(D.port_obs(spark, d), D.hosts(spark, d)).select(
        *PORT_COLUMNS, "service", "service_source", *GUESS_COLUMNS)


@query("unknown_enrichment_job", with_views("obs hosts", APPLIED.format(source="merged"),
                                            SECOND + "," + guess_sql("merged")))
def unknown_enrichment_job(spark, d):
    records = stored(D.host_records(spark, d), "records")
    enriched = jobs.enrichment_job(records, D.second_pass(spark, d))
    return enriched.select(*PORT_COLUMNS, "service", "service_source", *GUESS_COLUMNS)


PORT_REPORT = SECOND + "," + guess_sql("merged") + f""",
enriched AS ({APPLIED.format(source="merged").replace("o.service, CASE", "o.service, o.hostname, o.pos, o.product, o.version, o.extrainfo, o.service_method, o.service_confidence, o.tunnel, o.scripts, CASE WHEN o.protocol = 'udp' THEN 'udp-response' ELSE 'syn-ack' END AS state_reason, CASE")}),
{PROFILED.replace("FROM obs o", "FROM enriched o").strip()},
shown AS (SELECT *, CASE WHEN service = '' THEN profile_name ELSE service END AS shown_service, {SUMMARY} AS script_summary FROM profiled),""" + lined(
    "shown", [
        "'- ' || protocol || '/' || CAST(port AS VARCHAR) || ' ' || shown_service", RISK_LINE,
        "CASE WHEN product <> '' OR version <> '' THEN rtrim('  Product: ' || product || ' ' || version) END",
        "CASE WHEN extrainfo <> '' THEN '  Extra: ' || extrainfo END",
        "CASE WHEN state_reason <> '' THEN '  Reason: ' || state_reason END", DETECTION,
        "'  Service source: ' || service_source",
        """CASE WHEN service_guess IS NOT NULL THEN '  Prediction: service=' || service_guess || '; device=' || device_guess
          || ' | confidence=' || CAST(guess_confidence AS VARCHAR) END""",
        "CASE WHEN service_guess IS NOT NULL THEN '  Prediction evidence: ' || guess_evidence END",
        """CASE WHEN service_guess IS NOT NULL THEN
          '  Note: prediction fields are inferred hints, not confirmed Nmap service identification.' END""",
        "'  Detail: ' || description", "'  Action: ' || recommendation",
        "CASE WHEN script_summary <> '' THEN '  NSE: ' || script_summary END"])


@query("port_report_rows", with_views("obs hosts", LINE_SELECT, PORT_REPORT))
def port_report_rows(spark, d):
    return reports.port_report_rows(
        jobs.enrichment_job(D.host_records(spark, d), D.second_pass(spark, d)))
