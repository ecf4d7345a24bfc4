"""Column lists of the exported tables. All are fixed values."""

# Columns of exported predictions.
EXPORT_COLUMNS = [
    "ip", "hostname", "prediction", "probability_suspicious", "risk_score", "severity",
    "triage_status", "asset_type", "anomaly_score", "open_port_count", "risky_port_count",
    "very_risky_port_count", "critical_port_count", "high_detail_risk_port_count",
    "cleartext_count", "admin_port_count", "db_count", "fileshare_count", "remote_access_count",
    "top_risk_ports", "alerts", "recommendations",
]

# Columns of the readable training table.
READABLE_COLUMNS = [
    "ip", "hostname", "label", "open_port_count", "risky_port_count", "very_risky_port_count",
    "critical_port_count", "high_detail_risk_port_count", "remote_access_count", "cleartext_count",
    "admin_port_count", "db_count", "fileshare_count", "top_risk_ports", "risk_summary",
]

# Columns of the port detail table.
DETAIL_COLUMNS = [
    "ip", "hostname", "protocol", "port", "service", "service_source", "service_guess",
    "device_guess", "guess_confidence", "guess_evidence", "product", "version", "extrainfo",
    "tunnel", "state_reason", "service_method", "service_confidence", "category", "risk_level",
    "risk_score", "description", "recommendation", "script_summary",
]
