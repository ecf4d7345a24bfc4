"""Port level operators over ``port_obs``."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions import port_rules as P
from scanfold.functions.sql_text import quote
from scanfold.operators.features import KEYS, port_dimension
from scanfold.values import ports as V
from scanfold.values.columns import DETAIL_COLUMNS


def explode_ports(hosts: DataFrame) -> DataFrame:
    """Nested host records to the flat ``port_obs`` table."""
    return (hosts.select("scan_id", "ip", "hostname", F.posexplode("open_ports").alias("pos", "p"))
            .select("scan_id", "ip", "hostname", "pos", "p.*"))


def nest_ports(port_obs: DataFrame, extra: list | None = None) -> DataFrame:
    """Flat rows back to nested host records.

    A group holds at most one row per (protocol, port), which the table key
    guarantees, so the array stays within the number of ports a host can have.
    """
    fields = [c for c in port_obs.columns if c not in ("scan_id", "ip", "hostname", *(extra or []))]
    packed = F.array_sort(F.collect_list(F.struct("pos", *[c for c in fields if c != "pos"])))
    keep = [F.max("hostname").alias("hostname")] + [F.max(c).alias(c) for c in extra or []]
    return (port_obs.groupBy(*KEYS).agg(*keep, packed.alias("open_ports"))
            .withColumn("open_ports", F.transform("open_ports", lambda p: p.dropFields("pos"))))


def join_port_profile(port_obs: DataFrame) -> DataFrame:
    """Add profile name, category, risk level and score, description and advice."""
    dim = F.broadcast(port_dimension(port_obs.sparkSession).drop("group_bits", "flag_bits"))
    scored = port_obs.join(dim, "port", "left").selectExpr(
        *port_obs.columns, "profile_name", "profile_category", "profile_description",
        "profile_recommendation", f"{P.risk_sql('profile_score')} AS risk_score")
    return scored.selectExpr(
        *port_obs.columns,
        f"coalesce(profile_name, nullif({P.service_sql()}, ''), 'unknown') AS name",
        f"{P.category_sql('profile_category')} AS category",
        f"{P.level_sql('risk_score')} AS risk_level", "risk_score",
        f"coalesce(profile_description, {quote(V.UNPROFILED_DESCRIPTION)}) AS description",
        f"coalesce(profile_recommendation, {quote(V.UNPROFILED_RECOMMENDATION)}) AS recommendation")


def summarised(port_obs: DataFrame) -> DataFrame:
    """The scripts as their summary: all that details and reports use of them, and much shorter."""
    return port_obs.withColumn("script_summary", P.script_summary()).drop("scripts")


def enrich_ports(port_obs: DataFrame) -> DataFrame:
    """Profile columns plus the script summary, which ``summarised`` rows have already."""
    joined = join_port_profile(port_obs)
    return joined if "scripts" not in port_obs.columns else joined.withColumn("script_summary", P.script_summary())


def in_order(port_obs: DataFrame) -> DataFrame:
    """Summarised ports of one range of (scan, host, port) per partition. They are moved before texts
    are joined to them, and the pass that finds the ranges makes no texts either."""
    return summarised(port_obs).repartitionByRange("scan_id", "ip", "port")


def port_details(port_obs: DataFrame) -> DataFrame:
    """The detail table, one row per host and port; sort on write or display."""
    enriched = enrich_ports(port_obs).withColumn("service", F.expr(
        "CASE WHEN coalesce(service, '') = '' THEN name ELSE service END"))
    source = ("coalesce(service_source, CASE WHEN lower(service) IN ('', 'unknown') THEN 'guess' "
              "ELSE 'nmap' END) AS service_source")
    present = set(port_obs.columns)
    absent = {c: f"cast(NULL AS double) AS {c}" if c == "guess_confidence" else f"'' AS {c}"
              for c in ("service_guess", "device_guess", "guess_confidence", "guess_evidence")
              if c not in present}
    return enriched.selectExpr("scan_id", *[
        source if c == "service_source" else absent.get(c, c) for c in DETAIL_COLUMNS])


def top_risk_ports(port_obs: DataFrame) -> DataFrame:
    """Per host, the high and critical ports as ``port/level``, in record order.

    Only risky ports are collected; the table key bounds them per host.
    """
    return (port_obs.withColumn("score", P.port_risk_score()).groupBy(*KEYS)
            .agg(P.risky_port_list("score").alias("t"))
            .select(*KEYS, P.or_none("t").alias("top_risk_ports")))


def risky_hosts(port_obs: DataFrame) -> DataFrame:
    """``top_risk_ports`` of the hosts that have any; other ports never reach the shuffle."""
    risky = port_obs.withColumn("score", P.port_risk_score()).filter(
        F.col("score") >= V.RISK_SCORES["high"])
    return risky.groupBy(*KEYS).agg(P.risky_port_list("score").alias("top_risk_ports"))


def record_top_risk_ports(open_ports: str = "open_ports") -> Column:
    """``top_risk_ports`` of a nested record, without a shuffle."""
    score = P.risk_sql(P.lookup_sql(4, "p.port", str), "p.")
    entries = (f"filter(transform({open_ports}, p -> named_struct('port', p.port, 's', {score})), "
               f"e -> e.s >= {V.RISK_SCORES['high']})")
    text = f"array_join(transform({entries}, e -> concat(cast(e.port AS string), '/', {P.level_sql('e.s')})), ';')"
    return F.expr(f"coalesce(nullif({text}, ''), 'None')")


def distinct_ports(port_obs: DataFrame) -> DataFrame:
    """Distinct port numbers over all hosts."""
    return port_obs.select("port").distinct()


def sorted_ports(port_obs: DataFrame) -> DataFrame:
    """Per host, the distinct ports in ascending order."""
    return port_obs.groupBy(*KEYS).agg(F.sort_array(F.collect_set("port")).alias("ports"))
