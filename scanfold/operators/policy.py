"""Trusted hosts and ignored ports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.values import rules as R


def ignore_ports(port_obs: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drop ignored ports. Hosts are kept by joining features back to the host table.

    The list is broadcast: there are at most 65,536 distinct port numbers. A shuffle on the
    port would send a common port to one task.
    """
    return port_obs.join(F.broadcast(_listed(ignored)), "port", "left_anti").select(*port_obs.columns)


def only_ignored(port_obs: DataFrame, ignored: DataFrame) -> DataFrame:
    """The ports that ``ignore_ports`` drops."""
    return port_obs.join(F.broadcast(_listed(ignored)), "port", "left_semi").select(*port_obs.columns)


def _listed(ignored: DataFrame) -> DataFrame:
    return ignored.select(F.col("port").cast("int").alias("port")).filter(F.col("port").between(0, 65535)).distinct()


def mark_trusted(hosts: DataFrame, trusted: DataFrame) -> DataFrame:
    """Add ``is_trusted``; an empty or missing list trusts nobody."""
    listed = trusted.select(F.col("ip").cast("string").alias("ip")).distinct().withColumn(
        "_listed", F.lit(True))
    return hosts.join(listed, "ip", "left").select(
        *hosts.columns, F.col("_listed").isNotNull().alias("is_trusted"))


def override_trusted(predictions: DataFrame, trusted: DataFrame) -> DataFrame:
    """Trusted hosts become normal with zero risk; the other columns stay."""
    values = {
        "prediction": "normal", "predicted_probability_suspicious": 0.0, "risk_score": 0.0,
        "severity": R.LOWEST_SEVERITY, "triage_status": R.TRIAGE_NONE, "alerts": "",
    }
    marked = mark_trusted(predictions, trusted)
    changed = {c: F.when(F.col("is_trusted"), F.lit(v)).otherwise(F.col(c))
               for c, v in values.items() if c in predictions.columns}
    return marked.withColumns(changed).select(*predictions.columns)
