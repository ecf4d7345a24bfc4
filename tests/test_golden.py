"""Known results of the static fixtures."""

import pytest
from pyspark.sql import functions as F

from scanfold.functions import host_rules as H
from scanfold.operators import features as FE
from scanfold.operators import hosts as HO
from scanfold.operators import patterns as PA
from scanfold.operators import ports as PO
from tests.fixtures import SYNTHETIC

CAFE = {
    "120": (2, "unknown", (1, 0, 0, 0)), "130": (9, "file_server", (1, 1, 0, 1)),
    "140": (2, "server", (0, 1, 0, 1)), "201": (12, "unknown", (1, 3, 0, 0)),
    "202": (18, "file_server", (2, 2, 0, 0)), "203": (22, "workstation", (3, 4, 0, 0)),
    "204": (20, "workstation", (4, 2, 0, 0)), "205": (26, "file_server", (3, 5, 0, 0)),
    "206": (18, "workstation", (3, 2, 0, 0)), "207": (25, "workstation", (4, 4, 0, 0)),
    "208": (24, "file_server", (4, 3, 0, 0)), "209": (22, "workstation", (3, 4, 0, 0)),
    "210": (18, "workstation", (4, 2, 0, 0)), "220": (2, "unknown", (0, 1, 0, 1)),
    "250": (14, "server", (3, 2, 0, 1)),
}


def overview(hosts):
    rows = HO.add_labels(FE.host_features(PO.explode_ports(hosts)))
    rows = rows.withColumns({"asset": H.asset_type(), "alerts": H.host_alerts()})
    return {r.ip: r for r in rows.select("ip", "heuristic_score", "label", "label_confidence", "asset",
                                         F.col("alerts.severity").alias("levels")).collect()}


def levels(row):
    return tuple(row.levels.count(name) for name in ("CRITICAL", "HIGH", "MEDIUM", "LOW"))


def test_synthetic_hosts(synthetic):
    found = overview(synthetic)
    assert len(found) == len(SYNTHETIC)
    for ip, _, score, label, confidence, asset, alerts in SYNTHETIC:
        row = found[ip]
        assert (row.heuristic_score, row.label, row.label_confidence, row.asset, levels(row)) == (
            score, label, confidence, asset, alerts), ip


def test_cafe_hosts(cafe):
    found = overview(cafe)
    assert len(found) == 60
    assert PO.explode_ports(cafe).count() == 149
    labels = [r.label for r in found.values()]
    assert (labels.count("normal"), labels.count("suspicious")) == (48, 12)
    assets = [r.asset for r in found.values()]
    assert {a: assets.count(a) for a in set(assets)} == {
        "server": 29, "unknown": 11, "workstation": 6, "printer": 5, "iot_camera": 5, "file_server": 4}
    for part, (score, asset, alerts) in CAFE.items():
        row = found[f"10.10.0.{part}"]
        assert (row.heuristic_score, row.asset, levels(row)) == (score, asset, alerts), part


def test_cafe_patterns(cafe):
    rows = HO.add_labels(FE.host_features(PO.explode_ports(cafe))).withColumn("severity", F.lit("LOW"))
    counts = {r.pattern_id: r.affected_count for r in PA.network_patterns(rows).collect()}
    assert counts == {
        "lateral_movement_campaign": 9, "smb_worm_propagation_conditions": 11,
        "cleartext_credential_spray_surface": 11, "database_exposure_cluster": 5,
        "remote_access_vector_cluster": 10}
    assert PA.affected_hosts(rows).count() == sum(counts.values())


def test_nested_and_flat_features_agree(cafe, synthetic):
    both = cafe.union(synthetic)
    flat = FE.host_features(PO.explode_ports(both))
    nested = FE.record_features(both)
    assert flat.columns == nested.columns
    assert flat.exceptAll(nested).count() == 0 and nested.exceptAll(flat).count() == 0


def test_top_risk_ports(cafe):
    flat = {r.ip: r.top_risk_ports for r in PO.top_risk_ports(PO.explode_ports(cafe)).collect()}
    nested = {r.ip: r.t for r in cafe.select("ip", PO.record_top_risk_ports().alias("t")).collect()}
    assert flat == nested
    assert flat["10.10.0.203"] == "21/high;23/critical;445/critical;3389/critical"
    assert flat["10.10.0.3"] == "None"


@pytest.mark.parametrize("p,expected", [(0.99, "CRITICAL"), (0.98, "HIGH"), (0.95, "MEDIUM"), (0.85, "LOW")])
def test_severity_limits_are_strict(spark, p, expected):
    assert spark.range(1).select(F.lit(p).alias("p")).select(H.severity("p")).first()[0] == expected
