"""Host level operators over ``host_features`` and predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.functions import host_rules as H
from scanfold.operators.features import KEYS
from scanfold.operators.shuffle import rank_rows, salted_join
from scanfold.values import rules as R
from scanfold.values.columns import EXPORT_COLUMNS, READABLE_COLUMNS


def add_labels(features: DataFrame) -> DataFrame:
    """Add ``heuristic_score``, ``label`` and ``label_confidence``."""
    return features.withColumn("heuristic_score", H.heuristic_score()).withColumns({
        "label": H.heuristic_label("heuristic_score"),
        "label_confidence": H.label_confidence("heuristic_score")})


def explode_alerts(features: DataFrame) -> DataFrame:
    """One row per host and alert."""
    return features.select(*KEYS, F.posexplode(H.host_alerts()).alias("pos", "a")).select(
        *KEYS, "pos", "a.*")


def explode_techniques(features: DataFrame) -> DataFrame:
    """One row per host and enabled technique."""
    return features.select(*KEYS, F.posexplode(H.mitre_mapping()).alias("pos", "t")).select(
        *KEYS, "pos", "t.*")


def readable_training(training: DataFrame) -> DataFrame:
    return training.withColumns({
        "top_risk_ports": H.training_top_ports(), "risk_summary": H.risk_summary(),
    }).select("scan_id", *READABLE_COLUMNS)


def score_anomaly(raw: DataFrame, column: str = "raw_score") -> DataFrame:
    """Min-max anomaly score per scan; low raw scores are anomalous. Bounds and scores both read
    ``raw``, so give it stored where it is dear to compute."""
    bounds = minmax_bounds(raw, column)
    joined = salted_join(raw, bounds, ["scan_id"], ["ip"])
    span = F.col("raw_max") - F.col("raw_min")
    score = F.when(span > 0, F.round(1 - (F.col(column) - F.col("raw_min")) / span, 4)).otherwise(0.5)
    return joined.withColumn("anomaly_score", score).drop("raw_min", "raw_max")


def minmax_bounds(raw: DataFrame, column: str = "raw_score") -> DataFrame:
    return raw.groupBy("scan_id").agg(F.min(column).alias("raw_min"), F.max(column).alias("raw_max"))


def build_predictions(scored: DataFrame, top_ports: DataFrame,
                      changes: DataFrame | None = None) -> DataFrame:
    """Complete prediction table.

    ``scored`` holds features with prediction, probability and anomaly score, ``changes`` the
    flags of ``change_flags``; without it the baseline part of the risk is zero.
    """
    joined = scored.join(top_ports, KEYS, "left")
    if changes is None:
        joined = joined.withColumns({name: F.lit(False) for name, _ in R.CHANGE_SCORES})
    else:
        joined = joined.join(changes, KEYS, "left")
    return complete_predictions(joined)


def complete_predictions(scored: DataFrame) -> DataFrame:
    """Add asset, alerts, risk, severity, triage and advice to scored feature rows."""
    p = "predicted_probability_suspicious"
    rows = scored.withColumns({"asset_type": H.asset_type(), "alert_list": H.host_alerts(),
                               "baseline_score": H.baseline_change_score()})
    rows = rows.withColumns({
        "alert_score": H.max_alert_score("alert_list"),
        "asset_score": H.asset_criticality("asset_type")})
    rows = rows.withColumns({
        "risk_score": F.expr(H.composite_risk_sql(
            p, "alert_score", "anomaly_score", "baseline_score", "asset_score")),
        "severity": H.severity(p),
        "top_risk_ports": F.coalesce("top_risk_ports", F.lit("None")),
        "recommendations": F.array_join(H.recommendations(), " ; "),
        "alerts": H.alerts_summary("alert_list"),
        "triage_status": F.expr(H.triage_status_sql("prediction", p, "alert_list")),
    })
    return rows.drop("alert_list", "alert_score", "asset_score", "baseline_score",
                     *[name for name, _ in R.CHANGE_SCORES])


def export_predictions(predictions: DataFrame) -> DataFrame:
    """The 22 exported columns; apply the trusted override before."""
    return predictions.withColumn(
        "probability_suspicious", F.round("predicted_probability_suspicious", 4)).select(
        "scan_id", *EXPORT_COLUMNS)


# --- filters ----------------------------------------------------------------

def suspicious_only(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("prediction") == "suspicious")


def severity_filter(predictions: DataFrame, wanted: list, show_all: bool = False) -> DataFrame:
    shown = predictions if show_all else suspicious_only(predictions)
    return shown.filter(F.col("severity").isin(wanted)) if wanted else shown


def triaged_only(predictions: DataFrame) -> DataFrame:
    return predictions.filter(~F.col("triage_status").isin(R.TRIAGE_NONE, ""))


# --- summaries ----------------------------------------------------------------

def report_summary(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("scan_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("prediction") == "normal").alias("normal"),
        F.count_if(F.col("prediction") == "suspicious").alias("suspicious"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"))


def dashboard_metrics(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("*").alias("total_hosts"),
        F.count_if(F.col("prediction") == "suspicious").alias("suspicious"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("triage_status") == "Immediate Action").alias("immediate_action"),
        F.count_if(F.col("triage_status") == "Investigate").alias("investigate"))


def severity_distribution(predictions: DataFrame) -> DataFrame:
    """Hosts per severity in fixed order, zero where none."""
    order = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("severity"))
                                for i, s in enumerate(R.SEVERITY_ORDER)])).alias("s")
    dim = predictions.sparkSession.range(1).select(order).select("s.*")
    counts = predictions.filter(F.col("severity").isin(R.SEVERITY_ORDER)).groupBy("severity").agg(
        F.count("*").alias("hosts"))
    # At most one row per severity on either side.
    return dim.join(F.broadcast(counts), "severity", "left").select(
        "rank", "severity", F.coalesce("hosts", F.lit(0)).alias("hosts"))


def triage_distribution(predictions: DataFrame) -> DataFrame:
    return triaged_only(predictions).groupBy("triage_status").agg(
        F.count("*").alias("hosts")).orderBy(F.desc("hosts"), "triage_status")


def label_counts(training: DataFrame) -> DataFrame:
    return training.groupBy("label").agg(F.count("*").alias("rows"))


# --- rankings ----------------------------------------------------------------

def rank_suspicious(predictions: DataFrame) -> DataFrame:
    """Number suspicious hosts per scan by falling probability, then ip."""
    rows = suspicious_only(predictions).select(
        *KEYS, "hostname", "predicted_probability_suspicious", "severity", "triage_status")
    return rank_rows(rows, ["scan_id"], [F.desc("predicted_probability_suspicious"), "ip"])


def top_risks(predictions: DataFrame, limit: int = 3) -> DataFrame:
    """The suspicious hosts with the highest probability, over all given scans."""
    return suspicious_only(predictions).select(
        *KEYS, "hostname", "predicted_probability_suspicious", "severity", "triage_status").orderBy(
        F.desc("predicted_probability_suspicious"), "scan_id", "ip").limit(limit)


def top_risks_per_scan(predictions: DataFrame, limit: int = 3) -> DataFrame:
    """The same per scan; the rank filter cuts each group before the shuffle."""
    from pyspark.sql import Window as W
    order = W.partitionBy("scan_id").orderBy(F.desc("predicted_probability_suspicious"), "ip")
    return (suspicious_only(predictions).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= limit)
            .select(*KEYS, "hostname", "predicted_probability_suspicious", "severity",
                    "triage_status", "rank"))


def risk_ranking(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        *KEYS, H.host_name_label().alias("host_label"), "risk_score",
        "severity").orderBy(F.desc("risk_score"), "scan_id", "ip")


def anomaly_ranking(predictions: DataFrame) -> DataFrame:
    """Hosts by anomaly score; empty when no host exceeds 0.01."""
    gate = predictions.agg((F.max("anomaly_score") > 0.01).alias("_show"))
    # The gate is one row.
    rows = predictions.withColumn("_one", F.lit(1)).join(
        F.broadcast(gate.withColumn("_one", F.lit(1))), "_one").filter("_show")
    return rows.select(*KEYS, H.host_name_label().alias("host_label"),
                       "anomaly_score", "prediction").orderBy(F.desc("anomaly_score"), "scan_id", "ip")


def top_alerts(predictions: DataFrame, limit: int = 3) -> DataFrame:
    """First alerts and their total per suspicious host."""
    rows = suspicious_only(predictions).withColumn("alert_list", H.host_alerts())
    return rows.select(*KEYS, F.size("alert_list").alias("alert_count"),
                       F.slice("alert_list", 1, limit).alias("top_alerts"))
