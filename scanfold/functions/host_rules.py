"""Column expressions over one row of ``host_features``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanfold.functions.sql_text import case, fill, listed, numbers, quote
from scanfold.values import ports as V
from scanfold.values import rules as R


def _texts_sql(rules) -> str:
    """Array of the texts whose condition holds, in rule order."""
    return listed([(fill(text), cond) for text, cond in rules])


def _joined_sql(texts: str, separator: str, empty: str) -> str:
    return (f"CASE WHEN size({texts}) = 0 THEN {quote(empty)} "
            f"ELSE array_join({texts}, {quote(separator)}) END")


def filled(text: str, **known: str) -> Column:
    """A text whose ``{column}`` places take column values."""
    return F.expr(fill(text, **known))


def heuristic_score_sql() -> str:
    parts = [f"{flag} * {weight}" for flag, weight in R.FLAG_WEIGHTS]
    parts += [f"CASE WHEN {count} >= {least} THEN {weight} ELSE 0 END"
              for count, least, weight in R.COUNT_WEIGHTS]
    return "cast(" + " + ".join(parts) + " AS int)"


def heuristic_score() -> Column:
    return F.expr(heuristic_score_sql())


def heuristic_label(score: str) -> Column:
    return F.expr(f"CASE WHEN {score} >= {R.SUSPICIOUS_MIN_SCORE} THEN 'suspicious' ELSE 'normal' END")


def label_confidence(score: str) -> Column:
    distance = f"cast(abs({score} - {R.SUSPICIOUS_MIN_SCORE}) AS double) / {R.CONFIDENCE_SCALE}D"
    return F.expr(f"round({R.CONFIDENCE_MIDPOINT}D + least({distance}, {R.CONFIDENCE_MAX_BOOST}D), 3)")


def severity_sql(probability: str) -> str:
    return case([(f"{probability} > {limit}D", quote(name)) for name, limit in R.SEVERITY_LEVELS],
                quote(R.LOWEST_SEVERITY))


def severity(probability: str) -> Column:
    return F.expr(severity_sql(probability))


def asset_type_sql() -> str:
    return case([(cond, quote(name)) for name, cond in R.ASSET_RULES], quote(R.UNKNOWN_ASSET))


def asset_type() -> Column:
    return F.expr(asset_type_sql())


def asset_criticality_sql(asset: str) -> str:
    return case([(f"{asset} = {quote(name)}", f"{score}D") for name, score in R.ASSET_CRITICALITY],
                f"{dict(R.ASSET_CRITICALITY)[R.UNKNOWN_ASSET]}D")


def asset_criticality(asset: str) -> Column:
    return F.expr(asset_criticality_sql(asset))


def _flagged_sql(entries, of_type: str) -> str:
    if not entries:
        return f"cast(array() AS array<{of_type}>)"
    return listed([(value, None if flag is None else f"{flag} = 1") for value, flag in entries])


def host_alerts() -> Column:
    """Array of alerts in rule order, which is also severity order."""
    labels = f"array_join({_flagged_sql([(quote(t), f) for f, t in R.IOT_ALERT_LABELS], 'string')}, ' and ')"
    alerts = []
    for code, level, title, message, cond, ports in R.ALERT_RULES:
        port_list = _flagged_sql([(str(p), flag) for p, flag in ports], "int")
        text = fill(message, labels=labels,
                    ports=f"array_join(cast({port_list} AS array<string>), ', ')")
        alerts.append((
            f"named_struct('code', {quote(code)}, 'severity', {quote(level)}, 'title', {quote(title)}, "
            f"'message', {text}, 'ports', {port_list})", cond))
    return F.expr(listed(alerts))


def alerts_summary_sql(alerts: str) -> str:
    lines = f"transform({alerts}, a -> concat('[', a.severity, '] ', a.title))"
    return f"CASE WHEN size({alerts}) = 0 THEN {quote(R.NO_ALERTS)} ELSE array_join({lines}, ' ; ') END"


def alerts_summary(alerts: str) -> Column:
    return F.expr(alerts_summary_sql(alerts))


def max_alert_score_sql(alerts: str) -> str:
    """Highest severity score of the alerts, 0 without alerts."""
    return case([(f"array_contains({alerts}.severity, {quote(name)})", f"{score}D")
                 for name, score in R.ALERT_SCORES], "0D")


def max_alert_score(alerts: str) -> Column:
    return F.expr(max_alert_score_sql(alerts))


def triage_status_sql(prediction: str, probability: str, alerts: str) -> str:
    rules = [(f"{prediction} <> 'suspicious'", quote(R.TRIAGE_NONE))]
    rules += [(f"array_contains({alerts}.severity, {quote(level)}) OR {probability} > {limit}D", quote(status))
              for status, level, limit, _ in R.TRIAGE_RULES]
    return case(rules, quote(R.TRIAGE_MONITOR[0]))


def triage_guidance(status: str) -> Column:
    pairs = [(name, text) for name, _, _, text in R.TRIAGE_RULES] + [R.TRIAGE_MONITOR]
    return F.expr(case([(f"{status} = {quote(name)}", quote(text)) for name, text in pairs]))


def recommendations_sql() -> str:
    found = _texts_sql(R.RECOMMENDATIONS)
    return f"CASE WHEN size({found}) = 0 THEN array({quote(R.DEFAULT_RECOMMENDATION)}) ELSE {found} END"


def recommendations() -> Column:
    return F.expr(recommendations_sql())


def training_top_ports() -> Column:
    found = _flagged_sql([(quote(t), f) for t, f in R.TRAINING_PORTS], "string")
    return F.expr(_joined_sql(found, ";", R.NO_PORTS))


def risk_summary() -> Column:
    return F.expr(_joined_sql(_texts_sql(R.RISK_REASONS), " ; ", R.NO_REASON))


def baseline_change_score() -> Column:
    """Score from the boolean change flags of a host; null flags count as no change."""
    return F.expr(case([(f"coalesce({flag}, false)", f"{score}D") for flag, score in R.CHANGE_SCORES], "0D"))


def composite_risk_sql(probability: str, alert: str, anomaly: str, baseline: str, asset: str) -> str:
    w = R.RISK_WEIGHTS
    total = (f"{probability} * {w['probability']} + {alert} * {w['alert']} + {anomaly} * {w['anomaly']} "
             f"+ {baseline} * {w['baseline']} + {asset} * {w['asset']}")
    return f"round(least({total}, 100D), 1)"


def host_name_label() -> Column:
    return F.expr("CASE WHEN trim(coalesce(hostname, '')) = '' THEN ip ELSE concat(ip, ' (', hostname, ')') END")


# --- explanation -----------------------------------------------------------

def detected_services() -> Column:
    return F.expr(listed([
        (f"named_struct('ports', array({numbers(ports)}), 'name', {quote(name)}, 'description', {quote(text)})",
         f"{flag} = 1") for flag, ports, name, text in R.EXPLAINED_SERVICES]))


def detected_ports() -> Column:
    """Sorted ports of the detected services, from the service table."""
    pairs = [(str(p), f"{flag} = 1") for flag, ports, _, _ in R.EXPLAINED_SERVICES for p in ports]
    return F.expr(f"array_sort(array_distinct({listed(pairs)}))")


def flag_reason_sql(ports: str) -> str:
    """First line of an explanation, from the sorted detected ports."""
    very = f"size(filter({ports}, p -> p IN ({numbers(V.PORT_GROUPS['very_risky'])})))"
    known = fill("Flagged because: {n} known high-risk port(s) detected ({m} critical/very-high): ",
                 n=f"size({ports})", m=very)
    counted = fill("Flagged because: {open_port_count} open port(s) with "
                   "{uncommon_open_count} uncommon/non-standard port(s)")
    preview = f"array_join(cast(slice({ports}, 1, 7) AS array<string>), ', ')"
    more = f"CASE WHEN size({ports}) > 7 THEN concat(' (+', cast(size({ports}) - 7 AS string), ' more)') ELSE '' END"
    return f"CASE WHEN size({ports}) > 0 THEN concat({known}, {preview}, {more}) ELSE {counted} END"


def flag_reason(ports: str) -> Column:
    return F.expr(flag_reason_sql(ports))


def dangerous_combos() -> Column:
    return F.expr(_texts_sql(R.DANGEROUS_COMBOS))


def exposure_patterns() -> Column:
    return F.expr(_texts_sql(R.EXPOSURE_PATTERNS))


def _technique_services_sql(services) -> str:
    return _flagged_sql([(quote(f"{name} ({ports})"), flag) for flag, ports, name in services], "string")


def mitre_mapping() -> Column:
    """Array of the techniques that at least one open service enables."""
    return F.expr(listed([
        (f"named_struct('technique_id', {quote(code)}, 'technique', {quote(name)}, 'description', "
         f"{quote(text)}, 'services', {_technique_services_sql(services)})",
         " OR ".join(f"{flag} = 1" for flag, _, _ in services))
        for name, code, text, services in R.TECHNIQUES]))


def attack_surface_sql() -> str:
    """Summary of counts, empty for a host without open ports."""
    percent = "cast(cast(risky_port_count AS double) / open_port_count * 100 AS int)"
    parts = [("open_port_count > 0", fill("{open_port_count} total open port(s)")),
             ("risky_port_count > 0", fill("{risky_port_count} rated high/critical risk ({pct}%)", pct=percent)),
             ("critical_port_count > 0", fill("{critical_port_count} classified critical severity"))]
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in parts) + ")"


def attack_surface() -> Column:
    return F.expr(attack_surface_sql())


def with_explanation(features):
    """Add ``explanation``: all explanation lines of a host, in order.

    The sections are columns first, so that each is computed once.
    """
    technique_lines = [
        (f"array(concat({quote(f'  • [{code}] {name:<20}  ')}, array_join({_technique_services_sql(services)}, ', ')), "
         f"{quote(f'    {chr(32) * 28}  ↳ {text}')})", " OR ".join(f"{flag} = 1" for flag, _, _ in services))
        for name, code, text, services in R.TECHNIQUES]
    service_lines = [
        (quote(f"  • {name:<18} port {'/'.join(str(p) for p in ports):<12}  {text}"), f"{flag} = 1")
        for flag, ports, name, text in R.EXPLAINED_SERVICES]

    def bullets(rules):
        return f"transform({_texts_sql(rules)}, t -> concat('  • ', t))"

    parts = {"_ports": detected_ports(), "_services": F.expr(listed(service_lines)),
             "_combos": F.expr(bullets(R.DANGEROUS_COMBOS)),
             "_patterns": F.expr(bullets(R.EXPOSURE_PATTERNS)),
             "_techniques": F.expr(f"flatten({listed(technique_lines)})"), "_surface": attack_surface()}
    none = "cast(array() AS array<string>)"

    def section(name, title):
        return f"CASE WHEN size({name}) > 0 THEN concat(array('', {quote(title)}), {name}) ELSE {none} END"

    lines = ", ".join([
        f"array({flag_reason_sql('_ports')})", section("_services", "Detected high-risk services:"),
        section("_combos", "Dangerous service combinations:"), section("_patterns", "Exposure patterns:"),
        section("_techniques", "MITRE ATT&CK mapping:"),
        f"CASE WHEN _surface <> '' THEN array('', concat('Attack surface: ', _surface)) ELSE {none} END"])
    return features.withColumns(parts).withColumn("explanation", F.expr(f"concat({lines})")).drop(*parts)
