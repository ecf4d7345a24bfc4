"""Complete jobs built from the operators.

Each job reads host records, writes its tables below ``out`` and cuts lineage there:
later stages read the tables that earlier ones wrote.

What outlives a run lies below ``state`` (``out`` where none is given): the baseline's ports and
hosts by scan, the catalogue of scans, the memory, the history, the scan cache, the snapshots and
the list of runs. Rows there carry the run's id, so a run that is repeated replaces what it wrote.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.operators import baseline as B
from scanfold.operators import catalogue as C
from scanfold.operators import enrichment as E
from scanfold.operators import hosts as HO
from scanfold.operators import memory as M
from scanfold.operators import models
from scanfold.operators import patterns as PA
from scanfold.operators import policy as PY
from scanfold.operators import training as TR
from scanfold.operators.features import KEYS, host_features, record_features
from scanfold.operators.ports import explode_ports, nest_ports, record_top_risk_ports, risky_hosts
from scanfold.plans import reports
from scanfold.sinks import tables as SK
from scanfold.sources.workspace import stored

HOST_COLUMNS = ["scan_id", "ip", "hostname", "mac", "vendor", "os_matches"]


@dataclass
class Policy:
    """Small lists that steer a run; either may be missing."""

    trusted: DataFrame | None = None
    ignored: DataFrame | None = None


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there; one that is there but can't be read is an error."""
    from scanfold.sources.tables import AnalysisException
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, so that nothing before it is computed twice."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scan_report_job(records: DataFrame, out: str) -> DataFrame:
    """Port details and the scan report; no model."""
    ports = _stored(explode_ports(records), f"{out}/ports")
    SK.write_port_details(ports, f"{out}/port_details")
    SK.write_scan_report(ports, f"{out}/scan_report")
    return reports.scan_report_rows(ports)


def _with_memory(own: DataFrame, learned: DataFrame | None, memory: str | None, run_id: str, stamp, source: str) -> DataFrame | None:
    """A run's records and all that is remembered, without copies; null if there is nothing to add.

    The run's records are added to the memory first; their parts that count are written once.
    """
    own = stored(M.slim_records(own), "run-records")
    remembered = [learned] if learned is not None else []
    if memory is not None:
        SK.append_memory(own, memory, run_id, stamp, source)
        remembered.append(M.read_memory(own.sparkSession, memory).select("record.*"))
    if not remembered:
        return None
    both = M.slim_records(remembered[0])
    for more in remembered[1:]:
        both = both.unionByName(M.slim_records(more))
    return M.union_learned(M.slim_records(own), both)


def build_training_job(records: DataFrame, out: str, learned: DataFrame | None = None, samples: DataFrame | None = None,
                       memory: str | None = None, run_at=None, run_id: str | None = None, source: str = "scan") -> DataFrame:
    """Training tables from records, what was learned and, if needed, samples.

    With the path of a memory, the records are added to it under the run's id and all that it holds
    is used. Leave it out for records that aren't real.
    """
    stamp = F.current_timestamp() if run_at is None else F.lit(run_at).cast("timestamp")
    base = _with_memory(records, learned, memory, run_id or f"build-training-{run_at}", stamp, source)
    features = record_features(records if base is None else base)
    training = TR.build_training(features, record_features(samples) if samples is not None else None)
    SK.write_training(training, f"{out}/training", f"{out}/training_readable")
    return records.sparkSession.read.parquet(f"{out}/training")


def train_job(training: DataFrame, out: str) -> tuple:
    """Models, metrics and importances; returns (bundle, note)."""
    spark = training.sparkSession
    bundle, note = models.train_models(training)
    SK.write_metrics(bundle.metrics if bundle else None, note, f"{out}/metrics", spark)
    importance = models.feature_importance(spark, bundle) if bundle else None
    lines = reports.feature_importance_report(importance, bundle.model_name if bundle else "", spark)
    lines.coalesce(1).sortWithinPartitions("line_no").write.mode("overwrite").parquet(
        f"{out}/feature_importance")
    if bundle is not None:
        models.save_bundle(bundle, f"{out}/model")
        bundle = models.load_bundle(spark, f"{out}/model")
    return bundle, note


def enrichment_job(records: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Default sources, gate, second pass and guesses, as flat rows."""
    return explode_ports(E.enrich_records(records, second))


def recorded_scans(spark: SparkSession, state: str) -> DataFrame | None:
    """The stored catalogue, if there is one."""
    path = f"{state}/catalogue"
    return spark.read.schema(C.SCHEMA).parquet(path) if _exists(spark, path) else None


def scan_diff(ports: DataFrame, hosts: DataFrame, batch: DataFrame, state: str, ignored: DataFrame | None = None) -> DataFrame:
    """Changes of each scan of a batch against the scan before it, stored or in the same batch.

    ``batch`` is the catalogue of the given scans. The stored catalogue says which earlier scans are
    needed, and only these are read. Both sides leave out the ports that are ignored now, so a
    changed list makes no change. A scan that is stored already is replaced by the one given.
    """
    spark = ports.sparkSession
    profile = B.port_profile(ports if B.FIRST[0] in ports.columns else B.remember_first(ports))
    present = B.host_presence(hosts)
    recorded = recorded_scans(spark, state)
    pairs = stored(C.pairs_to_compare(batch, recorded), "scan-pairs")
    if recorded is not None:
        older = pairs.select(F.col("previous_scan_id").alias("scan_id")).join(batch.select("scan_id"), "scan_id", "left_anti")
        kept = C.only_scans(spark.read.schema(profile.schema).parquet(f"{state}/baseline"), older)
        if ignored is not None:
            kept = PY.ignore_ports(kept, ignored)
        profile = profile.unionByName(kept)
        present = present.unionByName(C.only_scans(spark.read.schema(present.schema).parquet(f"{state}/baseline_hosts"), older))
    return B.compare(B.scan_sides(profile, present, pairs))


def store_scans(ports: DataFrame, hosts: DataFrame, batch: DataFrame, state: str) -> None:
    """Make the scans of a batch the baseline of later ones: all ports, ignored ones too."""
    SK.write_baseline(ports, f"{state}/baseline")
    SK.write_baseline_hosts(hosts, f"{state}/baseline_hosts")
    SK.append_catalogue(batch, f"{state}/catalogue")


def enriched_forms(records: DataFrame, hosts: DataFrame, second: DataFrame | None, ignored: DataFrame | None, out: str) -> tuple:
    """All ports after the second pass, each with what the scan itself found, and those not ignored.

    Ignored ports give no guesses to others; they are enriched by themselves, to be stored.
    """
    raw = _stored(B.remember_first(explode_ports(records)), f"{out}/raw_ports")
    if ignored is None:
        everything = visible = _stored(E.enrich_unknown_ports(raw, hosts, second), f"{out}/ports")
        return everything, visible
    shown = PY.ignore_ports(raw, ignored)
    visible = _stored(E.enrich_unknown_ports(shown, hosts, second), f"{out}/ports")
    hidden = PY.only_ignored(raw, ignored)
    return visible.unionByName(E.enrich_unknown_ports(hidden, hosts, second)), visible


def compare_and_store_job(records: DataFrame, out: str, run_at, policy: Policy | None = None, second: DataFrame | None = None,
                          scan_times: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """Only the comparison of the full job: changes of each scan, then the scans become baseline."""
    policy, state = policy or Policy(), state or out
    hosts = _stored(records.select(*HOST_COLUMNS), f"{out}/hosts")
    everything, visible = enriched_forms(records, hosts, second, policy.ignored, out)
    batch = _stored(C.describe(hosts, everything, scan_times, F.lit(run_at).cast("timestamp"), second is not None), f"{out}/batch")
    diff = _stored(scan_diff(visible, hosts, batch, state, policy.ignored), f"{out}/diff")
    store_scans(everything, hosts, batch, state)
    return diff


def predict_stage(ports: DataFrame, hosts: DataFrame, bundle: models.ModelBundle, policy: Policy,
                  diff: DataFrame, out: str) -> DataFrame:
    """Scores, risk, override, export, patterns and report."""
    scored = models.predict_scores(host_features(ports, hosts), bundle)
    predictions = HO.build_predictions(scored, risky_hosts(ports), B.change_flags(diff))
    if policy.trusted is not None:
        predictions = PY.override_trusted(predictions, policy.trusted)
    predictions = _stored(predictions, f"{out}/predictions_full")
    SK.write_predictions(predictions, f"{out}/predictions")
    SK.write_json(PA.network_patterns(predictions), f"{out}/network_patterns")
    SK.write_json(PA.affected_hosts(predictions), f"{out}/pattern_hosts")
    SK.write_report(reports.prediction_report(predictions, diff), f"{out}/report")
    return predictions


def predict_job(records: DataFrame, bundle: models.ModelBundle, out: str, policy: Policy | None = None,
                run_at=None, scan_times: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """Predictions with a saved model; then the scan becomes the new baseline."""
    policy, state = policy or Policy(), state or out
    raw = _stored(explode_ports(records), f"{out}/ports")
    hosts = _stored(records.select(*HOST_COLUMNS), f"{out}/hosts")
    ports = PY.ignore_ports(raw, policy.ignored) if policy.ignored is not None else raw
    SK.write_port_details(ports, f"{out}/port_details")
    stamp = F.current_timestamp() if run_at is None else F.lit(run_at).cast("timestamp")
    batch = _stored(C.describe(hosts, raw, scan_times, stamp), f"{out}/batch")
    diff = _stored(scan_diff(ports, hosts, batch, state, policy.ignored), f"{out}/diff")
    predictions = predict_stage(ports, hosts, bundle, policy, diff, out)
    store_scans(raw, hosts, batch, state)
    return predictions


#: Version of the scan settings that cached scans were made with (fixed value).
PROFILE_VERSION = "deep-port-v2"


def full_job(records: DataFrame, out: str, run_at, mode: str = "real", source: str = "scan",
             policy: Policy | None = None, second: DataFrame | None = None,
             learned: DataFrame | None = None, samples: DataFrame | None = None,
             scan_times: DataFrame | None = None, state: str | None = None, run_id: str | None = None,
             target: str | None = None, profile_version: str = PROFILE_VERSION) -> tuple:
    """All stages for landed scans; returns (predictions or None, note).

    Policy comes before training. The baseline holds all ports as the second pass left them,
    ignored ones too, beside what the scan itself found, so neither the pass nor a changed list makes
    false differences. In mode ``real`` the records are remembered, and training uses all that
    is remembered; ``learned`` adds further records. ``scan_times`` (scan_id, scan_time) orders the
    scans; without it a run's scans have its time. ``run_id`` names the run, its time if not given.
    """
    spark = records.sparkSession
    policy, state = policy or Policy(), state or out
    run_id = run_id or f"{mode}-{run_at}"
    stamp = F.lit(run_at).cast("timestamp")
    hosts = _stored(records.select(*HOST_COLUMNS), f"{out}/hosts")
    everything, ports = enriched_forms(records, hosts, second, policy.ignored, out)
    SK.write_port_details(ports, f"{out}/port_details")
    SK.write_scan_report(ports, f"{out}/scan_report")
    if mode == "real":
        named = hosts.agg(F.count("*").alias("host_count")).select(
            F.lit(profile_version).alias("profile_version"), F.lit(mode).alias("mode"), F.lit(target or source).alias("target"),
            F.lit(source).alias("source"), stamp.alias("saved_at"), "host_count")
        SK.append_scan_cache(named, f"{state}/scan_cache", run_id)

    features = _stored(host_features(ports, hosts), f"{out}/features")
    SK.append_history(M.history_rows(features, stamp, mode, source), f"{state}/history", run_id)
    known = _with_memory(nest_ports(ports), learned, f"{state}/memory" if mode == "real" else None, run_id, stamp, source)
    base = features if known is None else record_features(known)
    training = TR.build_training(base, record_features(samples) if samples is not None else None)
    SK.write_training(training, f"{out}/training", f"{out}/training_readable")
    training = spark.read.parquet(f"{out}/training")

    batch = _stored(C.describe(hosts, everything, scan_times, stamp, second is not None), f"{out}/batch")
    diff = _stored(scan_diff(ports, hosts, batch, state, policy.ignored), f"{out}/diff")
    bundle, note = train_job(training, out)
    predictions = None
    if bundle is not None:
        predictions = predict_stage(ports, hosts, bundle, policy, diff, out)
    store_scans(everything, hosts, batch, state)
    snapshot = records.select(*HOST_COLUMNS, "open_ports")
    if predictions is not None:
        snapshot = snapshot.join(predictions.select(
            *KEYS, "prediction", "predicted_probability_suspicious", "risk_score", "severity"), KEYS, "left")
    about = {"saved_at": stamp, "run_date": stamp.cast("date"), "target": F.lit(target or source), "mode": F.lit(mode)}
    SK.append_snapshot(snapshot.withColumns(about), f"{state}/snapshots", run_id)
    open_questions = E.enrichment_totals(B.as_scanned(ports)).agg(
        F.coalesce(F.sum("unknown_hosts"), F.lit(0)).alias("unknown_hosts"),
        F.coalesce(F.sum("unknown_ports"), F.lit(0)).alias("unknown_ports"))
    SK.write_run(open_questions.withColumns({
        **about, "source": F.lit(source), "profile_version": F.lit(profile_version), "host_count": F.lit(hosts.count()),
        "ran_second_pass": F.lit(second is not None), "training_note": F.lit(note or ""),
        "model": F.lit(bundle.model_name if bundle else "")}), f"{state}/runs", run_id)
    return predictions, note


def analyze_job(records: DataFrame, out: str, run_at, policy: Policy | None = None,
                samples: DataFrame | None = None, scan_times: DataFrame | None = None) -> tuple:
    """Everything for scan files that are already there: no second pass, no learned memory."""
    return full_job(records, out, run_at, "analyze", "offline_xml", policy, samples=samples, scan_times=scan_times)


def fixture_train_job(records: DataFrame, out: str, run_at) -> DataFrame | None:
    """History, training, predictions and their reports over a given host table."""
    ports = _stored(explode_ports(records), f"{out}/ports")
    SK.write_json(records, f"{out}/records")
    SK.write_scan_report(ports, f"{out}/scan_report")
    SK.write_port_details(ports, f"{out}/port_details")
    features = _stored(record_features(records), f"{out}/features")
    stamp = F.lit(run_at).cast("timestamp")
    SK.append_history(M.history_rows(features, stamp, "generate-dataset", "synthetic"), f"{out}/history", f"generate-dataset-{run_at}")
    training = build_training_job(records, out)
    bundle, _ = train_job(training, out)
    if bundle is None:
        return None
    tops = records.select(*KEYS, record_top_risk_ports().alias("top_risk_ports"))
    predictions = _stored(HO.build_predictions(models.predict_scores(features, bundle), tops), f"{out}/predictions_full")
    SK.write_predictions(predictions, f"{out}/predictions")
    SK.write_report(reports.prediction_report(predictions), f"{out}/report")
    return predictions
