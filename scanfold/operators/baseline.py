"""Comparison of a scan with an earlier one.

A profile is the long table (scan_id, ip, hostname, port, service, product,
version) with one row per host and port. Both sides of a comparison carry the
``scan_id`` of the current scan, so one job can compare any number of scans.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.functions import port_rules as P
from scanfold.operators import catalogue as C
from scanfold.operators.shuffle import salted_join

KEYS = ["scan_id", "ip"]
FORM = ["service", "product", "version"]
FIRST = [f"first_{c}" for c in FORM]
#: So many scans are joined by broadcast (one short row each); more by a salted join.
MOST_BROADCAST_SCANS = 100_000


def remember_first(port_obs: DataFrame) -> DataFrame:
    """Keep what the scan itself found beside what a second pass may put in its place."""
    return port_obs.withColumns({f"first_{c}": F.col(c) for c in FORM})


def as_scanned(port_obs: DataFrame) -> DataFrame:
    """The ports of ``remember_first`` as the scan found them, without sources and guesses."""
    dropped = [c for c in ("service_source", "service_guess", "device_guess", "guess_evidence") if c in port_obs.columns]
    return port_obs.withColumns({c: F.col(f"first_{c}") for c in FORM}).withColumns({
        c: F.lit(None).cast("string") for c in dropped})


def port_profile(port_obs: DataFrame) -> DataFrame:
    """One row per host and port; of several protocols the last entry wins. Columns of
    ``remember_first`` are kept."""
    kept = FORM + [c for c in FIRST if c in port_obs.columns]
    return (port_obs.filter(F.col("ip") != "")
            .groupBy(*KEYS, "port").agg(F.max("hostname").alias("hostname"), F.max_by(F.struct(*kept), "pos").alias("s"))
            .select(*KEYS, "hostname", "port", "s.*"))


def host_presence(hosts: DataFrame) -> DataFrame:
    """One row per host that was there, with or without an open port."""
    return hosts.filter(F.col("ip") != "").groupBy(*KEYS).agg(F.max("hostname").alias("hostname"))


def baseline_profile(port_obs: DataFrame) -> DataFrame:
    """Nested form: sorted ports and a map from port to service, per host."""
    entry = F.struct("port", F.struct("service", "product", "version").alias("s"))
    return port_profile(port_obs).groupBy(*KEYS).agg(
        F.max("hostname").alias("hostname"), F.sort_array(F.collect_set("port")).alias("ports"),
        F.map_from_entries(F.collect_list(entry)).alias("services"))


def baseline_hosts(baseline: DataFrame) -> DataFrame:
    """Host list of a nested baseline for display."""
    return baseline.select(
        *KEYS, "hostname", F.size("ports").alias("port_count"),
        F.array_join(F.col("ports").cast("array<string>"), ", ").alias("ports"))


def previous_scans(scans: DataFrame) -> DataFrame:
    """Each scan with the scan before it, by time and then by the id's numbers; null for the first."""
    return C.previous_scans(scans).select("scan_id", "previous_scan_id")


@dataclass
class Sides:
    """Both sides of every comparison, each under the scan_id of the current scan."""

    current: DataFrame
    baseline: DataFrame
    current_hosts: DataFrame
    baseline_hosts: DataFrame


def scan_sides(profile: DataFrame, hosts: DataFrame, pairs: DataFrame) -> Sides:
    """The sides of the pairs (``catalogue.pairs_to_compare``) from tables that hold both.

    Where a profile remembers first findings, they are compared unless both scans had a second
    pass, so a second pass on one side makes no difference.
    """
    compared = pairs.select("scan_id", "previous_scan_id", "both_enriched")
    few = compared.count() <= MOST_BROADCAST_SCANS

    def attach(rows, per_scan, spread):
        return rows.join(F.broadcast(per_scan), "scan_id") if few else salted_join(rows, per_scan, ["scan_id"], spread, "inner")

    now = compared.select("scan_id", F.col("scan_id").alias("_as"), "both_enriched")
    before = compared.select(F.col("previous_scan_id").alias("scan_id"), F.col("scan_id").alias("_as"), "both_enriched")
    form = [F.when(F.col("both_enriched"), F.col(c)).otherwise(F.col(f"first_{c}")).alias(c) if f"first_{c}" in profile.columns
            else F.col(c) for c in FORM]

    def ports(side):
        return attach(profile, side, ["ip", "port"]).select(F.col("_as").alias("scan_id"), "ip", "hostname", "port", *form)

    def present(side):
        return attach(hosts, side, ["ip"]).select(F.col("_as").alias("scan_id"), "ip", "hostname")
    return Sides(ports(now), ports(before), present(now), present(before))


def _hosts(profile: DataFrame) -> DataFrame:
    return profile.select(*KEYS).distinct()


def new_hosts(current: DataFrame, baseline: DataFrame) -> DataFrame:
    return _hosts(current).join(_hosts(baseline), KEYS, "left_anti")


def gone_hosts(current: DataFrame, baseline: DataFrame) -> DataFrame:
    return new_hosts(baseline, current)


def opened_ports(current: DataFrame, baseline: DataFrame, baseline_hosts: DataFrame | None = None) -> DataFrame:
    """Ports of known hosts that were not open before. Without a host table, hosts with ports are known."""
    known = current.select(*KEYS, "port").join(
        _hosts(baseline if baseline_hosts is None else baseline_hosts), KEYS, "left_semi")
    return known.join(baseline.select(*KEYS, "port"), [*KEYS, "port"], "left_anti")


def closed_ports(current: DataFrame, baseline: DataFrame, current_hosts: DataFrame | None = None) -> DataFrame:
    return opened_ports(baseline, current, current_hosts)


def version_changes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Ports open in both whose product and version text differ and are not empty."""
    text = P.product_version_sql()
    now = current.selectExpr(*KEYS, "port", "service", f"{text} AS to_version")
    then = baseline.selectExpr(*KEYS, "port", f"{text} AS from_version")
    return now.join(then, [*KEYS, "port"]).filter(
        (F.col("from_version") != "") & (F.col("to_version") != "")
        & (F.col("from_version") != F.col("to_version"))).select(
        *KEYS, "port", "service", "from_version", "to_version")


def port_set_difference(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Opened and closed ports per known host, from nested profiles."""
    c = current.select(*KEYS, F.col("ports").alias("now"))
    b = baseline.select(*KEYS, F.col("ports").alias("then"))
    return c.join(b, KEYS).select(
        *KEYS, F.array_sort(F.array_except("now", "then")).alias("opened"),
        F.array_sort(F.array_except("then", "now")).alias("closed"))


def host_diff(current: DataFrame, baseline: DataFrame, current_hosts: DataFrame | None = None,
              baseline_hosts: DataFrame | None = None) -> DataFrame:
    """All changes of one comparison: one row per host, one full outer join on the port.

    A host is there when its side's host table lists it or it has an open port. The arrays of a
    host hold at most its ports.
    """
    def text(side):
        return F.expr(P.product_version_sql(f"{side}."))

    def side(frame, name):
        return frame.select(*KEYS, "port", F.struct("service", "product", "version").alias(name))

    both = side(current, "c").join(side(baseline, "b"), [*KEYS, "port"], "full_outer")
    in_both = F.col("c").isNotNull() & F.col("b").isNotNull()
    changed = in_both & (text("b") != "") & (text("c") != "") & (text("b") != text("c"))
    change = F.when(changed, F.struct(
        "port", F.col("c.service").alias("service"), text("b").alias("from_version"),
        text("c").alias("to_version")))
    grouped = both.groupBy(*KEYS).agg(
        (F.count("c") > 0).alias("now"), (F.count("b") > 0).alias("before"),
        F.array_sort(F.collect_list(F.when(F.col("b").isNull(), F.col("port")))).alias("added"),
        F.array_sort(F.collect_list(F.when(F.col("c").isNull(), F.col("port")))).alias("removed"),
        F.array_sort(F.collect_list(change)).alias("version_changes"))
    if current_hosts is not None and baseline_hosts is not None:
        seen = current_hosts.select(*KEYS, F.lit(True).alias("_now"), F.lit(False).alias("_before")).unionByName(
            baseline_hosts.select(*KEYS, F.lit(False).alias("_now"), F.lit(True).alias("_before")))
        seen = seen.groupBy(*KEYS).agg(F.bool_or("_now").alias("_now"), F.bool_or("_before").alias("_before"))
        grouped = grouped.join(seen, KEYS, "full_outer").withColumns({
            name: F.coalesce(name, F.lit(False)) | F.coalesce(f"_{name}", F.lit(False)) for name in ("now", "before")})
        grouped = grouped.withColumn("version_changes", F.coalesce("version_changes", F.expr(
            "cast(array() AS array<struct<port:int,service:string,from_version:string,to_version:string>>)")))
    known = F.col("now") & F.col("before")
    none = F.lit([]).cast("array<int>")
    return grouped.select(
        *KEYS, (~F.col("before")).alias("is_new_host"), (~F.col("now")).alias("is_gone_host"),
        F.when(known, F.coalesce("added", none)).otherwise(none).alias("opened"),
        F.when(known, F.coalesce("removed", none)).otherwise(none).alias("closed"), "version_changes")


def compare(sides: Sides) -> DataFrame:
    """``host_diff`` of the sides."""
    return host_diff(sides.current, sides.baseline, sides.current_hosts, sides.baseline_hosts)


def baseline_changes(diff: DataFrame) -> DataFrame:
    """Long form of ``host_diff``: one row per change."""
    def rows(kind, ports):
        return F.transform(ports, lambda p: F.struct(
            F.lit(kind).alias("change_type"), p.alias("port"), F.lit(None).cast("string").alias("service"),
            F.lit(None).cast("string").alias("from_version"),
            F.lit(None).cast("string").alias("to_version")))
    host = F.lit([None]).cast("array<int>")
    none = F.lit([]).cast("array<int>")
    versions = F.transform("version_changes", lambda v: F.struct(
        F.lit("version_change").alias("change_type"), v["port"].alias("port"),
        v["service"].alias("service"), v["from_version"].alias("from_version"),
        v["to_version"].alias("to_version")))
    changes = F.concat(
        rows("new_host", F.when(F.col("is_new_host"), host).otherwise(none)),
        rows("gone_host", F.when(F.col("is_gone_host"), host).otherwise(none)),
        rows("opened_port", F.col("opened")), rows("closed_port", F.col("closed")), versions)
    return diff.select(*KEYS, F.explode(changes).alias("x")).select(*KEYS, "x.*")


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts per scan; a host whose only change is a version counts as unchanged."""
    known = ~F.col("is_new_host") & ~F.col("is_gone_host")
    return diff.groupBy("scan_id").agg(
        F.count_if("is_new_host").alias("new_hosts"), F.count_if("is_gone_host").alias("gone_hosts"),
        F.count_if(F.size("opened") > 0).alias("hosts_with_opened"),
        F.count_if(F.size("closed") > 0).alias("hosts_with_closed"),
        F.count_if(F.size("version_changes") > 0).alias("hosts_with_version_changes"),
        F.count_if(known & (F.size("opened") == 0) & (F.size("closed") == 0)).alias("unchanged_count"))


def change_flags(diff: DataFrame) -> DataFrame:
    """Per host of the current scan, the flags that the risk score uses."""
    return diff.filter(~F.col("is_gone_host")).select(
        *KEYS, "is_new_host", (F.size("opened") > 0).alias("has_opened_port"),
        (F.size("version_changes") > 0).alias("has_version_change"))
