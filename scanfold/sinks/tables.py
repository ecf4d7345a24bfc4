"""Writers of the engine tables. All are plain Spark writers to a shared path."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.operators import hosts as HO
from scanfold.operators import memory as M
from scanfold.operators import ports as PO
from scanfold.operators.baseline import FORM, host_presence, port_profile, remember_first
from scanfold.plans import reports


def write_predictions(predictions: DataFrame, path: str, fmt: str = "csv") -> None:
    """The exported prediction columns, written after the trusted override."""
    writer = HO.export_predictions(predictions).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_port_details(port_obs: DataFrame, path: str) -> None:
    """Detail rows in (scan, host, port) order across files."""
    (PO.port_details(PO.in_order(port_obs).sortWithinPartitions("scan_id", "ip", "port", "protocol"))
     .write.mode("overwrite").parquet(path))


def write_training(training: DataFrame, full_path: str, readable_path: str) -> None:
    training.write.mode("overwrite").parquet(full_path)
    # Read back, so that the rows are computed once.
    stored = training.sparkSession.read.schema(training.schema).parquet(full_path)
    HO.readable_training(stored).write.mode("overwrite").option("header", True).option(
        "escape", '"').csv(readable_path)


def _by_run(rows: DataFrame, path: str, run_id: str | None, *parts: str) -> None:
    """Append rows; under a run id they replace what the same run wrote before."""
    if run_id is None:
        writer = rows.write.mode("append")
        (writer.partitionBy(*parts) if parts else writer).parquet(path)
    else:
        (rows.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*parts, "run_id").parquet(path))


def append_history(rows: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Append labelled feature rows by run date; nothing is written without rows. Runs with an id
    and without one belong into different tables."""
    if rows.isEmpty():
        return False
    _by_run(rows, path, run_id, "run_date")
    return True


def _by_scan(rows: DataFrame, path: str) -> None:
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path))


def write_baseline(port_obs: DataFrame, path: str) -> None:
    """Keep the profile of every scan; rewriting a scan replaces only that scan. What the scan
    itself found is kept beside what a second pass put in its place (``remember_first``)."""
    _by_scan(port_profile(port_obs if f"first_{FORM[0]}" in port_obs.columns else remember_first(port_obs)), path)


def write_baseline_hosts(hosts: DataFrame, path: str) -> None:
    """Keep the hosts of every scan, those without open ports too."""
    _by_scan(host_presence(hosts), path)


def append_catalogue(scans: DataFrame, path: str) -> None:
    """Record scans; to be done last, since a scan counts as stored once it is listed."""
    scans.coalesce(1).write.mode("append").parquet(path)


def append_snapshot(records: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append-only run snapshots; the latest one is a view over the table."""
    _by_run(records, path, run_id, "run_date")


def write_run(summary: DataFrame, path: str, run_id: str) -> None:
    """One row on what a run was and did."""
    _by_run(summary.coalesce(1), path, run_id)


def write_json(rows: DataFrame, path: str) -> None:
    """Patterns or records with their nested schema, compressed: names and texts repeat in every row."""
    rows.write.mode("overwrite").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").json(path)


def append_scan_cache(snapshots: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append a scan under its cache key; the latest row per key counts."""
    keyed = snapshots.withColumn("cache_key", M.cache_key(
        F.col("profile_version"), F.col("mode"), F.col("target")))
    _by_run(keyed, path, run_id)


def append_memory(records: DataFrame, path: str, run_id: str, seen_at, source: str) -> None:
    """Add a run's records to the observation log; a run that is repeated replaces its own rows."""
    _by_run(M.observations(records, seen_at, source), f"{path}/log", run_id)


def compact_memory(spark, path: str) -> None:
    """Fold the log's runs into one row per signature. The list of folded runs is written last and
    makes the state count; until then the one before does."""
    runs = spark.read.schema("run_id string").parquet(f"{path}/log").distinct()
    version = M.state_version(spark, path) + 1
    M.read_memory(spark, path).write.mode("overwrite").parquet(f"{path}/states/version={version}")
    runs.coalesce(1).write.mode("overwrite").parquet(f"{path}/folded/version={version}")


def write_metrics(metrics: DataFrame, note: str | None, path: str, spark=None) -> None:
    """Metrics per model, a failed one with its error; or the note that says why there are none."""
    rows = metrics if note is None else spark.createDataFrame([(note,)], "note string")
    rows.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text, one folder per scan, in line order across files.

    Lines are range-partitioned by their order, so a large scan spreads over many files.
    """
    order = [c for c in lines.columns if c not in ("scan_id", "line")]
    (lines.repartitionByRange("scan_id", *order).sortWithinPartitions("scan_id", *order)
     .select("scan_id", "line").write.mode("overwrite").partitionBy("scan_id").text(path))


def write_scan_report(port_obs: DataFrame, path: str) -> None:
    """``write_report`` of the scan report's lines. A port's lines are one text, and the ports are
    moved before the texts are made."""
    (reports.scan_report_texts(PO.in_order(port_obs)).select(*reports.PORT_ORDER, F.array_join("texts", "\n").alias("line"))
     .sortWithinPartitions(*reports.PORT_ORDER).select("scan_id", "line").write.mode("overwrite").partitionBy("scan_id").text(path))


def latest_runs(snapshots: DataFrame) -> DataFrame:
    """Rows of the latest run per target."""
    newest = snapshots.groupBy("target").agg(F.max("saved_at").alias("saved_at"))
    return snapshots.join(newest, ["target", "saved_at"], "left_semi")


