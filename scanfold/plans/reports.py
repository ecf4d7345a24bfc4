"""Reports as rows of text lines with an explicit order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.functions import host_rules as H
from scanfold.functions import port_rules as P
from scanfold.operators.features import KEYS
from scanfold.operators.ports import enrich_ports, port_details
from scanfold.values import rules as R

PORT_ORDER = ["scan_id", "ip", "port", "protocol"]


def _packed(lines: list):
    """The non-null lines, in order, as one list."""
    return F.array_compact(F.array(*lines))


def _lines(rows: DataFrame, keys: list, lines: list) -> DataFrame:
    """One output row per non-null line. The list is made within the generator: a filter that is
    inferred from a list column would make it a second time."""
    return rows.select(*keys, F.posexplode(_packed(lines)).alias("line_no", "line"))


def _text(name):
    return F.coalesce(F.col(name), F.lit(""))


def _or_unknown(name):
    return F.when(_text(name) == "", "unknown").otherwise(F.col(name))


def scan_report_rows(port_obs: DataFrame) -> DataFrame:
    """Lines of the scan report per host and port."""
    rows, lines = _scan_report(port_obs)
    return _lines(rows, PORT_ORDER, lines)


def scan_report_texts(port_obs: DataFrame) -> DataFrame:
    """The same as one list of lines per port."""
    rows, lines = _scan_report(port_obs)
    return rows.select(*PORT_ORDER, _packed(lines).alias("texts"))


def _scan_report(port_obs: DataFrame) -> tuple:
    rows = enrich_ports(port_obs)
    service = F.when(_text("service") != "", F.col("service")).otherwise(F.col("name"))
    extra = F.expr(P.product_version_sql())
    head = F.concat(F.col("protocol"), F.lit("/"), F.col("port").cast("string"), F.lit("  "), service)
    return rows, [
        F.when(extra != "", F.concat(head, F.lit("  "), extra)).otherwise(head),
        F.concat(F.lit("  Risk: "), F.upper("risk_level"), F.lit(" | Category: "), F.col("category"),
                 F.lit(" | Score: "), F.col("risk_score").cast("string")),
        F.concat(F.lit("  Detail: "), F.col("description")),
        F.concat(F.lit("  Action: "), F.col("recommendation")),
        F.when(_text("state_reason") != "", F.concat(F.lit("  Nmap reason: "), F.col("state_reason"))),
        F.when((_text("service_method") != "") | (_text("service_confidence") != ""), F.concat(
            F.lit("  Detection: method="), _or_unknown("service_method"), F.lit(", confidence="),
            _or_unknown("service_confidence"))),
        F.when(_text("extrainfo") != "", F.concat(F.lit("  Extra info: "), F.col("extrainfo"))),
        F.when(F.col("script_summary") != "", F.concat(F.lit("  NSE: "), F.col("script_summary"))),
    ]


def port_report_rows(port_obs: DataFrame) -> DataFrame:
    """Lines of the detailed port report; optional lines only where they have a value."""
    rows = port_details(port_obs)
    confidence = F.when(F.col("guess_confidence").isNull(), "").otherwise(
        F.concat(F.lit(" | confidence="), F.col("guess_confidence").cast("string")))
    guessed = (_text("service_guess") != "") | (_text("device_guess") != "")
    device = F.when(_text("device_guess") == "", "unknown device").otherwise(F.col("device_guess"))
    return _lines(rows, PORT_ORDER, [
        F.concat(F.lit("- "), F.col("protocol"), F.lit("/"), F.col("port").cast("string"), F.lit(" "),
                 F.col("service")),
        F.concat(F.lit("  Risk: "), F.upper("risk_level"), F.lit(" | Category: "), F.col("category"),
                 F.lit(" | Score: "), F.col("risk_score").cast("string")),
        F.when((_text("product") != "") | (_text("version") != ""), F.rtrim(F.concat(
            F.lit("  Product: "), _text("product"), F.lit(" "), _text("version")))),
        F.when(_text("extrainfo") != "", F.concat(F.lit("  Extra: "), F.col("extrainfo"))),
        F.when(_text("state_reason") != "", F.concat(F.lit("  Reason: "), F.col("state_reason"))),
        F.when((_text("service_method") != "") | (_text("service_confidence") != ""), F.concat(
            F.lit("  Detection: method="), _or_unknown("service_method"), F.lit(", confidence="),
            _or_unknown("service_confidence"))),
        F.when(_text("service_source") != "", F.concat(
            F.lit("  Service source: "), F.col("service_source"))),
        F.when(guessed, F.concat(
            F.lit("  Prediction: service="), _or_unknown("service_guess"), F.lit("; device="), device,
            confidence)),
        F.when(guessed & (_text("guess_evidence") != ""), F.concat(
            F.lit("  Prediction evidence: "), F.col("guess_evidence"))),
        F.when(guessed, F.lit("  Note: prediction fields are inferred hints, not confirmed Nmap "
                              "service identification.")),
        F.concat(F.lit("  Detail: "), F.col("description")),
        F.concat(F.lit("  Action: "), F.col("recommendation")),
        F.when(F.col("script_summary") != "", F.concat(F.lit("  NSE: "), F.col("script_summary"))),
    ])


def host_table_line(predictions: DataFrame) -> DataFrame:
    """One fixed-width line per host."""
    return predictions.select(*KEYS, F.format_string(
        "%-15s %-20s %-12s %.2f   %-10s %-18s %-16s %-6s %-6s",
        "ip", "hostname", F.upper("prediction"), "predicted_probability_suspicious", "severity",
        "triage_status", "asset_type", F.col("open_port_count").cast("string"),
        F.col("risky_port_count").cast("string")).alias("line"))


def baseline_diff_report(diff: DataFrame) -> DataFrame:
    """Change lines per scan: section number, ip, position and text."""
    def per_host(section, cond, text):
        return F.when(cond, F.struct(F.lit(section).alias("section"), F.lit(0).alias("item"),
                                     text.alias("line")))
    ports = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ")
    single = F.array_compact(F.array(
        per_host(1, F.col("is_new_host"), F.concat(F.lit("  + "), F.col("ip"))),
        per_host(2, F.col("is_gone_host"), F.concat(F.lit("  - "), F.col("ip"))),
        per_host(3, F.size("opened") > 0, F.concat(
            F.lit("  "), F.col("ip"), F.lit("  +ports: "), ports("opened"))),
        per_host(4, F.size("closed") > 0, F.concat(
            F.lit("  "), F.col("ip"), F.lit("  -ports: "), ports("closed")))))
    versions = F.transform("version_changes", lambda v: F.struct(
        F.lit(5).alias("section"), v["port"].alias("item"), F.concat(
            F.lit("  "), F.col("ip"), F.lit("  port "), v["port"].cast("string"),
            F.when(F.coalesce(v["service"], F.lit("")) != "", F.concat(
                F.lit(" ["), v["service"], F.lit("]"))).otherwise(""),
            F.lit(": "), v["from_version"], F.lit(" → "), v["to_version"]).alias("line")))
    details = diff.select("scan_id", "ip", F.explode(F.concat(single, versions)).alias("x")).select(
        "scan_id", "x.section", "ip", "x.item", "x.line")

    titles = {"new_hosts": (1, "New hosts appeared (", "):"),
              "gone_hosts": (2, "Hosts no longer reachable (", "):"),
              "hosts_with_opened": (3, "Newly opened ports (", " host(s)):"),
              "hosts_with_closed": (4, "Ports no longer open (", " host(s)):"),
              "hosts_with_version_changes": (5, "Service version changes (", " host(s)):")}
    from scanfold.operators.baseline import diff_summary
    counts = diff_summary(diff)
    any_change = F.greatest(*[F.col(c) for c in titles]) > 0
    heads = [F.when(F.col(c) > 0, F.struct(F.lit(n).alias("section"), F.concat(
        F.lit(a), F.col(c).cast("string"), F.lit(b)).alias("line"))) for c, (n, a, b) in titles.items()]
    heads.append(F.when(~any_change, F.struct(F.lit(0).alias("section"), F.lit(
        "No changes detected — current scan matches the previous baseline.").alias("line"))))
    heads.append(F.when(~any_change | (F.col("unchanged_count") > 0), F.struct(
        F.lit(6).alias("section"), F.concat(
            F.lit("Unchanged hosts: "), F.col("unchanged_count").cast("string")).alias("line"))))
    head = counts.select("scan_id", F.explode(F.array_compact(F.array(*heads))).alias("x")).select(
        "scan_id", "x.section", F.lit("").alias("ip"), F.lit(-1).alias("item"), "x.line")
    return details.unionByName(head)


def pattern_report(patterns: DataFrame, affected: DataFrame) -> DataFrame:
    """Pattern lines per scan; host lines stay rows of their own."""
    name = F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("name"))
    texts = [(1, name),
             (2, F.concat(F.lit("    Affected hosts ("), F.col("affected_count").cast("string"), F.lit("):"))),
             (4, F.concat(F.lit("    "), F.col("description"))),
             (5, F.concat(F.lit("    MITRE: "), F.col("mitre"))),
             (6, F.concat(F.lit("    Recommendation: "), F.col("recommendation")))]
    packed = F.array_compact(F.array(*[F.when(text.isNotNull(), F.struct(
        F.lit(n).alias("part"), text.alias("line"))) for n, text in texts]))
    heads = patterns.select("scan_id", "pattern_id", F.explode(packed).alias("x")).select(
        "scan_id", "pattern_id", "x.part", F.lit("").alias("ip"), "x.line")
    hosts = affected.select(
        "scan_id", "pattern_id", F.lit(3).alias("part"), "ip", F.concat(
            F.lit("      - "), F.when(_text("hostname") == "", F.col("ip")).otherwise(
                F.concat("ip", F.lit(" ("), "hostname", F.lit(")")))).alias("line"))
    return heads.unionByName(hosts)


def suspicious_detail(predictions: DataFrame) -> DataFrame:
    """Detail lines of each suspicious host: identity, scores, reasons, alerts, advice."""
    p = F.col("predicted_probability_suspicious")
    rows = H.with_explanation(predictions.filter(F.col("prediction") == "suspicious")).withColumns(
        {"alert_list": H.host_alerts(), "advice": H.recommendations()})
    explained = F.expr("transform(explanation, t -> concat('  ', t))")
    alerts = F.expr("flatten(transform(alert_list, a -> array("
                    "concat('  [', a.severity, '] ', a.title), concat('    ', a.message))))")
    advice = F.expr("transform(advice, t -> concat('- ', t))")
    head = F.array(
        F.concat(F.lit("IP: "), F.col("ip")), F.concat(F.lit("Hostname  : "), F.col("hostname")),
        F.concat(F.lit("Asset Type: "), F.col("asset_type")),
        F.concat(F.lit("Severity  : "), H.severity("predicted_probability_suspicious")),
        F.concat(F.lit("Triage    : "), F.col("triage_status")),
        F.concat(F.lit("Risk Score: "), F.col("risk_score").cast("string"), F.lit("/100")),
        F.concat(F.lit("Confidence: "), F.format_string("%.3f", p)),
        F.concat(F.lit("Top Risk Ports: "), F.col("top_risk_ports")), F.lit("Why flagged:"))
    none = F.lit([]).cast("array<string>")
    lines = F.concat(head, explained,
                     F.when(F.size(alerts) > 0, F.concat(F.array(F.lit("Security Alerts:")), alerts)
                            ).otherwise(none), F.array(F.lit("Recommendations:")), advice)
    return rows.select(*KEYS, "predicted_probability_suspicious",
                       F.posexplode(lines).alias("line_no", "line"))


def feature_importance_report(importance: DataFrame | None, model_name: str, spark) -> DataFrame:
    """Numbered feature lines, or the message that there is nothing to show."""
    if importance is None:
        return spark.range(1).select(F.lit(0).alias("line_no"), F.lit(
            "No trained model is available, so feature importance could not be calculated.").alias("line"))
    # At most as many rows as there are features.
    rows = importance.orderBy(F.desc("importance"), "feature").collect()
    if not rows:
        texts = ["This model does not expose feature importance values."]
    else:
        texts = ["Top AI factors used by the model", "================================",
                 f"Model: {model_name}", ""]
        texts += [f"{i}. {r.feature}: {r.importance:.6f} ({r.method})" for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(list(enumerate(texts)), "line_no int, line string")


def summary_lines(summary: DataFrame) -> DataFrame:
    """Head lines of the report per scan, from ``report_summary``."""
    packed = F.array(
        F.lit("================ NETWORK SECURITY ANALYSIS ================"),
        H.filled("Total Hosts Scanned: {total}"), H.filled("Normal Hosts: {normal}"),
        H.filled("Suspicious Hosts: {suspicious}"), H.filled("Critical: {critical}  |  High: {high}"))
    return summary.select("scan_id", F.posexplode(packed).alias("line_no", "line"))


def top_risk_lines(top: DataFrame) -> DataFrame:
    """Lines of the highest risks per scan, from ``top_risks_per_scan``."""
    triage = F.when(F.col("triage_status").isin("", R.TRIAGE_NONE), "").otherwise(
        F.concat(F.lit(" ["), F.col("triage_status"), F.lit("]")))
    return top.select("scan_id", F.col("rank").cast("int").alias("line_no"), F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("ip"), F.lit(" ("), F.col("hostname"),
        F.lit(") — "), F.col("severity"), triage).alias("line"))


def prediction_report(predictions: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """The whole report as ordered rows: section, key, line number and line."""
    from scanfold.operators import hosts as HO
    from scanfold.operators import patterns as PA

    def part(section, rows, *keys):
        kinds = dict(rows.dtypes)
        key = F.concat_ws("|", *[
            F.format_string("%012d", F.col(c).cast("long")) if kinds[c] in ("int", "bigint") else _text(c)
            for c in keys])
        return rows.select("scan_id", F.lit(section).alias("section"), key.alias("place"), "line")

    parts = [part(1, summary_lines(HO.report_summary(predictions)), "line_no"),
             part(2, top_risk_lines(HO.top_risks_per_scan(predictions)), "line_no")]
    if diff is not None:
        rows = baseline_diff_report(diff).withColumn("item", F.col("item") + 1)
        parts.append(part(3, rows.withColumnRenamed("section", "kind"), "kind", "ip", "item"))
    patterns = PA.network_patterns(predictions)
    pattern_lines = pattern_report(patterns, PA.affected_hosts(predictions)).withColumn(
        "pattern", PA.pattern_order())
    parts.append(part(4, pattern_lines, "pattern", "part", "ip"))
    parts.append(part(5, host_table_line(predictions), "ip"))
    details = suspicious_detail(predictions).withColumn(
        "place", F.format_string("%.9f", 1 - F.col("predicted_probability_suspicious")))
    parts.append(part(6, details, "place", "ip", "line_no"))
    report = parts[0]
    for rows in parts[1:]:
        report = report.unionByName(rows)
    return report
