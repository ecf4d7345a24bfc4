"""One wide numeric row per host.

``host_features`` works on the flat table and needs one shuffle on
(scan_id, ip); all its aggregates combine map-side. ``record_features`` works on
the nested table and needs no shuffle, since a host is already one row.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions import port_rules as P
from scanfold.functions.sql_text import quote
from scanfold.values import ports as V

KEYS = ["scan_id", "ip"]


def port_dimension(spark: SparkSession) -> DataFrame:
    """The known ports, one row each, so its size is fixed."""
    names = ["port", "profile_name", "profile_category", "profile_risk", "profile_score",
             "profile_description", "profile_recommendation", "group_bits", "flag_bits"]
    columns = dict(zip(names, map(list, zip(*P.port_facts()))))
    for name in ("port", "profile_score"):
        columns[name] = pa.array(columns[name], pa.int32())
    return spark.createDataFrame(pa.table(columns))


def _conditions(at: str = "") -> dict:
    """Count features as SQL conditions over one measured port."""
    def group(name):
        return f"coalesce({at}group_bits & {P.group_bit(name)}, 0) <> 0"
    high, critical = V.RISK_SCORES["high"], V.RISK_SCORES["critical"]
    conditions = {
        "risky_port_count": group("risky"), "very_risky_port_count": group("very_risky"),
        "critical_port_count": f"{at}score >= {critical}",
        "high_detail_risk_port_count": f"{at}score >= {high}",
        "uncommon_open_count": f"{at}port > {V.UNCOMMON_PORT_MIN} AND NOT {group('common_high')}",
    }
    for name in ("remote_access", "cleartext", "admin_port", "iot_port", "mail", "db", "fileshare",
                 "web"):
        conditions[f"{name}_count"] = group(name.removesuffix("_port"))
    conditions["versioned_service_count"] = f"coalesce({at}product, '') <> '' OR coalesce({at}version, '') <> ''"
    conditions["unknown_service_count"] = f"coalesce({at}service, '') IN ('', 'unknown')"
    conditions["encrypted_service_count"] = f"coalesce({at}tunnel, '') = 'ssl' OR {group('encrypted')}"
    for name in [b for b, _ in V.SERVICE_BUCKETS] + [V.OTHER_BUCKET]:
        conditions[f"service_{name}_count"] = f"{at}bucket = {quote(name)}"
    for name in V.COUNTED_CATEGORIES:
        conditions[f"profile_{name}_count"] = f"{at}category = {quote(name)}"
    return conditions


def feature_columns() -> list:
    """The 68 model features, in table order."""
    counts = list(_conditions())
    head, tail = counts[:4], counts[4:]
    at = tail.index("service_web_count")
    return (["open_port_count"] + head + ["max_port_risk_score", "avg_port_risk_score"]
            + tail[:at] + ["nse_script_count"] + tail[at:] + [flag for flag, _ in V.HOST_FLAGS])


def port_measures(port_obs: DataFrame) -> DataFrame:
    """Add group and flag bits, service bucket, category and risk score to each port."""
    dim = port_dimension(port_obs.sparkSession).select(
        "port", "profile_category", "profile_score", "group_bits", "flag_bits")
    return port_obs.join(F.broadcast(dim), "port", "left").selectExpr(
        *port_obs.columns, "group_bits", "flag_bits", f"{P.bucket_sql()} AS bucket",
        f"{P.category_sql('profile_category')} AS category", f"{P.risk_sql('profile_score')} AS score")


def host_features(port_obs: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Features from the flat table.

    With ``hosts`` every listed host is kept, also one without any port left; its
    features are zero. The host name is a grouping key and all aggregates are numbers, so
    Spark can aggregate by hash; a text aggregate would force it to sort all ports.
    """
    aggs = ["count(port) AS open_port_count",
            "max(score) AS max_port_risk_score", "avg(score) AS avg_port_risk_score",
            "sum(greatest(size(scripts), 0)) AS nse_script_count", "bit_or(flag_bits) AS flag_bits"]
    aggs += [f"count_if({cond}) AS {name}" for name, cond in _conditions().items()]
    grouped = port_measures(port_obs).groupBy(*KEYS, "hostname").agg(*[F.expr(a) for a in aggs])
    if hosts is not None:
        grouped = hosts.select(*KEYS, "hostname").join(grouped.drop("hostname"), KEYS, "left")
    return _finish(grouped)


def _finish(grouped: DataFrame) -> DataFrame:
    flags = {flag: i for i, (flag, _) in enumerate(V.HOST_FLAGS)}
    selected = ["scan_id", "ip", "hostname"]
    for name in feature_columns():
        if name in flags:
            selected.append(f"cast(getbit(coalesce(flag_bits, 0L), {flags[name]}) AS int) AS {name}")
        elif name == "avg_port_risk_score":
            selected.append(f"coalesce({name}, 0D) AS {name}")
        else:
            selected.append(f"cast(coalesce({name}, 0) AS int) AS {name}")
    return grouped.selectExpr(*selected)


def record_features(hosts: DataFrame) -> DataFrame:
    """Features from nested host records, without a shuffle."""
    facts = ", ".join(
        f"{port}, named_struct('category', cast({quote(category)} AS string), 'score', cast({score if score else 'NULL'} AS int), "
        f"'groups', {groups}L, 'flags', {flags}L)"
        for port, _, category, _, score, _, _, groups, flags in P.port_facts())
    known = (f"transform(open_ports, p -> named_struct('p', p, 'f', try_element_at(map({facts}), p.port)))")
    measured = f"""transform(known, k -> named_struct('port', k.p.port, 'service', k.p.service,
        'product', k.p.product, 'version', k.p.version, 'tunnel', k.p.tunnel,
        'scripts', greatest(size(k.p.scripts), 0), 'group_bits', k.f.groups, 'flag_bits', coalesce(k.f.flags, 0L),
        'bucket', {P.bucket_sql('k.p.')}, 'category', {P.category_sql('k.f.category', 'k.p.')},
        'score', {P.risk_sql('k.f.score', 'k.p.')}))"""
    special = {
        "open_port_count": "size(m)",
        "max_port_risk_score": "coalesce(array_max(m.score), 0)",
        "avg_port_risk_score": "CASE WHEN size(m) = 0 THEN 0D ELSE cast(aggregate(m.score, 0, (a, s) -> a + s) AS double) / size(m) END",
        "nse_script_count": "aggregate(m.scripts, 0, (a, s) -> a + s)",
    }
    for i, (flag, _) in enumerate(V.HOST_FLAGS):
        special[flag] = f"cast(getbit(flag_bits, {i}) AS int)"
    conditions = _conditions("p.")
    selected = [f"{special.get(name) or f'size(filter(m, p -> {conditions[name]}))'} AS {name}"
                for name in feature_columns()]
    return (hosts.selectExpr(*KEYS, "hostname", f"{known} AS known")
            .selectExpr(*KEYS, "hostname", f"{measured} AS m")
            .selectExpr(*KEYS, "hostname", "m", "aggregate(m.flag_bits, 0L, (a, b) -> a | b) AS flag_bits")
            .selectExpr(*KEYS, "hostname", *selected))


def port_mix(port_obs: DataFrame) -> DataFrame:
    """Per host, ports per profile category and per service bucket, as long rows."""
    kinds = ("explode(array(named_struct('kind', 'category', 'name', category), "
             "named_struct('kind', 'bucket', 'name', bucket))) AS k")
    return (port_measures(port_obs).selectExpr(*KEYS, kinds)
            .groupBy(*KEYS, "k.kind", "k.name").agg(F.count("*").alias("port_count")))


def zero_fill(features: DataFrame, wanted: list) -> DataFrame:
    """Add the wanted columns that are absent, as zero."""
    present = set(features.columns)
    return features.selectExpr("*", *[f"0 AS {name}" for name in wanted if name not in present])
