"""The list of scans, which says what to read before any scan is read.

A catalogue has one row per recorded scan: scan_id, scan_time, hosts, ports, enriched (whether a
second pass was merged), recorded_at. It is an append-only log; the newest row of a scan counts.
Scans are ordered by scan_time, then by scan_id with its numbers compared as numbers (scan-9 comes
before scan-10). A scan without a time comes before all that have one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfold.operators.shuffle import latest, rank_rows

SCHEMA = T.StructType([
    T.StructField("scan_id", T.StringType()), T.StructField("scan_time", T.TimestampType()),
    T.StructField("hosts", T.LongType()), T.StructField("ports", T.LongType()),
    T.StructField("enriched", T.BooleanType()), T.StructField("recorded_at", T.TimestampType())])

#: Digits that a number in a scan_id is compared by.
NUMBER_WIDTH = 20
#: So many scan ids are written into a filter as literals; more are joined.
MOST_LITERALS = 1_000


def natural_order(scan_id: str = "scan_id") -> Column:
    """The id with each number padded, so that text order is number order."""
    padded = F.regexp_replace(F.col(scan_id), r"(\d+)", "0" * NUMBER_WIDTH + "$1")
    return F.regexp_replace(padded, rf"\d*(\d{{{NUMBER_WIDTH}}})", "$1")


def describe(hosts: DataFrame, ports: DataFrame, scan_times: DataFrame | None, recorded_at: Column,
             enriched: bool = False) -> DataFrame:
    """Catalogue rows of the scans of a host table; scan_times(scan_id, scan_time) may be missing or incomplete."""
    counts = hosts.groupBy("scan_id").agg(F.count_distinct("ip").alias("hosts")).join(
        ports.groupBy("scan_id").agg(F.count("*").alias("ports")), "scan_id", "left")
    if scan_times is None:
        counts = counts.withColumn("scan_time", recorded_at.cast("timestamp"))
    else:
        counts = counts.join(scan_times.groupBy("scan_id").agg(F.max("scan_time").alias("scan_time")), "scan_id", "left")
    return counts.withColumns({
        "ports": F.coalesce("ports", F.lit(0)), "enriched": F.lit(enriched),
        "recorded_at": recorded_at.cast("timestamp")}).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])


def newest(log: DataFrame) -> DataFrame:
    """One row per scan: the one recorded last."""
    return latest(log, ["scan_id"], F.struct("recorded_at", "scan_time", "hosts", "ports", "enriched"))


def previous_scans(scans: DataFrame) -> DataFrame:
    """scan_id, previous_scan_id, both_enriched of each scan; null for the first one.

    ``scans`` is a catalogue, or has only scan_id.
    """
    columns = set(scans.columns)
    rows = scans.select(
        "scan_id", *[F.col(c) if c in columns else F.lit(None).cast(kind).alias(c)
                     for c, kind in (("scan_time", "timestamp"), ("enriched", "boolean"))]).distinct()
    ranked = rank_rows(rows.withColumn("_order", natural_order()), [], [F.asc_nulls_first("scan_time"), "_order", "scan_id"], "n")
    before = ranked.select((F.col("n") + 1).alias("n"), F.col("scan_id").alias("previous_scan_id"), F.col("enriched").alias("_before"))
    return ranked.join(before, "n", "left").select(
        "scan_id", "previous_scan_id", F.coalesce(F.col("enriched") & F.col("_before"), F.lit(False)).alias("both_enriched"))


def pairs_to_compare(batch: DataFrame, recorded: DataFrame | None) -> DataFrame:
    """``previous_scans`` of a batch's scans, where a scan before may be in the batch or recorded.

    A recorded scan that the batch holds again is the batch's.
    """
    scans = batch
    if recorded is not None:
        scans = batch.unionByName(newest(recorded).join(batch.select("scan_id"), "scan_id", "left_anti").select(*batch.columns))
    found = previous_scans(scans).filter("previous_scan_id IS NOT NULL")
    return found.join(batch.select("scan_id"), "scan_id", "left_semi")


def only_scans(stored: DataFrame, wanted: DataFrame, most: int = MOST_LITERALS) -> DataFrame:
    """The rows of a table, stored by scan, that belong to the wanted scans.

    Few ids become literals, so only their partitions are listed and read; more are joined.
    """
    ids = [r.scan_id for r in wanted.select("scan_id").distinct().limit(most + 1).collect()]
    if len(ids) <= most:
        return stored.filter(F.col("scan_id").isin(ids)) if ids else stored.filter(F.lit(False))
    return stored.join(wanted.select("scan_id").distinct(), "scan_id", "left_semi")
