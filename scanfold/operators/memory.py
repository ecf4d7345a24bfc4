"""Observation log, deduplication, scan cache and history."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfold.operators.shuffle import earliest, latest
from scanfold.schemas import HOST, PORT

#: The parts of a port that a record's signature and features use.
SLIM_PORT = ("protocol", "port", "service", "product", "version", "tunnel", "scripts")


def signature(open_ports: str = "open_ports") -> Column:
    """SHA-256 over ip, hostname and the sorted port entries."""
    entry = ("concat_ws('/', p.protocol, lpad(cast(p.port AS string), 5, '0'), coalesce(p.service, ''), "
             "coalesce(p.product, ''), coalesce(p.version, ''))")
    ports = f"array_join(array_sort(transform({open_ports}, p -> {entry})), ',')"
    return F.expr(f"sha2(concat_ws('|', ip, coalesce(hostname, ''), {ports}), 256)")


def with_signature(records: DataFrame) -> DataFrame:
    return records.withColumn("signature", signature())


def dedupe_records(records: DataFrame, order: str) -> DataFrame:
    """First record per signature; a min-by aggregate, so copies shrink before the shuffle."""
    return earliest(with_signature(records), ["signature"], F.col(order))


def slim_records(records: DataFrame) -> DataFrame:
    """Only the parts of a record that its signature and features use."""
    return records.select("scan_id", "ip", "hostname", F.transform("open_ports", lambda p: F.struct(
        *[p[n].alias(n) for n in SLIM_PORT])).alias("open_ports"))


def union_learned(current: DataFrame, learned: DataFrame) -> DataFrame:
    """Current and learned records without copies; the current ones come first."""
    both = current.withColumn("ingest_order", F.lit(0)).unionByName(
        learned.withColumn("ingest_order", F.lit(1)))
    ordered = both.withColumn("_at", F.struct("ingest_order", "scan_id"))
    return dedupe_records(ordered, "_at").drop("_at")


def learned_memory(log: DataFrame, tie: str) -> DataFrame:
    """State of the append-only log: first and last sighting, count and latest record."""
    rest = [c for c in log.columns if c not in ("signature", "seen_at", tie)]
    return log.groupBy("signature").agg(
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"),
        F.count("*").alias("seen_count"),
        F.max_by(F.struct(*rest), F.struct("seen_at", tie)).alias("r")).select(
        "signature", "first_seen", "last_seen", "seen_count", "r.*")


RECORD = T.StructType([HOST.fields[0], HOST.fields[1], HOST.fields[2], T.StructField("open_ports", T.ArrayType(T.StructType(
    [f for f in PORT.fields if f.name in SLIM_PORT])))])
MEMORY = T.StructType([
    T.StructField("signature", T.StringType()), T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()), T.StructField("seen_count", T.LongType()),
    T.StructField("source", T.StringType()), T.StructField("record", RECORD)])


def observations(records: DataFrame, seen_at: Column, source: str) -> DataFrame:
    """One log row per signature of a run: how often it was seen, and its record."""
    signed = with_signature(slim_records(records))
    return signed.groupBy("signature").agg(
        F.count("*").alias("seen_count"), F.max_by(F.struct("scan_id", "ip", "hostname", "open_ports"), "scan_id").alias("record")).select(
        "signature", seen_at.alias("first_seen"), seen_at.alias("last_seen"), "seen_count", F.lit(source).alias("source"), "record")


def merge_observations(log: DataFrame) -> DataFrame:
    """State per signature of log rows and earlier states: first and last sighting, count, latest source and record."""
    newest = F.max_by(F.struct("source", "record"), F.struct("last_seen", "record.scan_id"))
    return log.groupBy("signature").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("seen_count").alias("seen_count"), newest.alias("r")).select(
        "signature", "first_seen", "last_seen", "seen_count", "r.*")


def _versions(spark: SparkSession, path: str) -> list:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "_SUCCESS").load(
        f"{path}/folded").select(F.regexp_extract("path", r"/version=(\d+)/_SUCCESS$", 1).cast("int").alias("v"))
    return [r.v for r in found.distinct().collect() if r.v is not None]


def state_version(spark: SparkSession, path: str) -> int:
    """The newest complete state of a memory, 0 if none."""
    try:
        return max(_versions(spark, path), default=0)
    except AnalysisException:
        return 0


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    """The memory's state: the newest folded states and the log rows of all runs since."""
    schema = T.StructType([*MEMORY.fields, T.StructField("run_id", T.StringType())])
    log = spark.read.schema(schema).parquet(f"{path}/log")
    version = state_version(spark, path)
    if not version:
        return merge_observations(log.drop("run_id"))
    folded = spark.read.parquet(f"{path}/folded/version={version}").select("run_id")
    states = spark.read.schema(MEMORY).parquet(f"{path}/states/version={version}")
    return merge_observations(states.unionByName(log.join(folded, "run_id", "left_anti").drop("run_id")))


def cache_key(version: Column, mode: Column, target: Column) -> Column:
    return F.sha2(F.concat_ws("|", version, mode, target), 256)


def latest_scan_per_target(snapshots: DataFrame, version: str | None = None) -> DataFrame:
    """Latest snapshot per cache key; another profile version is a miss."""
    rows = snapshots if version is None else snapshots.filter(F.col("profile_version") == version)
    keyed = rows.withColumn("cache_key", cache_key(
        F.col("profile_version"), F.col("mode"), F.col("target")))
    return latest(keyed, ["cache_key"], F.col("saved_at"))


def history_rows(features: DataFrame, run_at: Column, mode: str, source: str) -> DataFrame:
    """Features with label and run columns, as appended to the history table."""
    from scanfold.operators.hosts import add_labels
    labelled = add_labels(features).drop("heuristic_score", "label_confidence")
    return labelled.withColumns({
        "run_at": run_at, "run_date": run_at.cast("date"), "mode": F.lit(mode),
        "source": F.lit(source)})
