"""Properties of the operators, with hot keys among them."""

from pyspark.sql import functions as F

from scanfold.operators import baseline as B
from scanfold.operators import catalogue as C
from scanfold.operators import enrichment as E
from scanfold.operators import features as FE
from scanfold.operators import hosts as HO
from scanfold.operators import memory as M
from scanfold.operators import policy as PY
from scanfold.operators import ports as PO
from scanfold.operators import training as TR
from scanfold.operators.shuffle import rank_rows, salted_join
from tests.fixtures import host, host_frame, port


def test_rank_matches_brute_force_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 37 % 11, i) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, v int, id int")
    got = {(r.k, r.id): r.n for r in rank_rows(frame, ["k"], [F.desc("v"), "id"], "n").collect()}
    expected = {}
    for key in {k for k, _, _ in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        expected |= {(key, r[2]): i for i, r in enumerate(ordered, 1)}
    assert got == expected


def test_salted_join_keeps_every_row(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    sizes = rows.groupBy("k").count()
    joined = salted_join(rows, sizes, ["k"], ["id"])
    assert joined.count() == 1000
    assert joined.filter("k = 0").select("count").distinct().collect()[0][0] == 700


def profile(spark, entries):
    return spark.createDataFrame(
        entries, "scan_id string, ip string, hostname string, port int, service string, product string, version string")


def test_diff_of_equal_scans_is_empty(cafe):
    p = B.port_profile(PO.explode_ports(cafe))
    diff = B.host_diff(p, p)
    assert B.baseline_changes(diff).count() == 0
    assert B.diff_summary(diff).first().unchanged_count == 60


def test_diff_kinds(spark):
    then = profile(spark, [("s", "a", "", 22, "ssh", "P", "1"), ("s", "a", "", 80, "http", "", ""),
                           ("s", "gone", "", 22, "ssh", "", ""), ("s", "v", "", 22, "ssh", "P", "1")])
    now = profile(spark, [("s", "a", "", 22, "ssh", "P", "1"), ("s", "a", "", 81, "http", "", ""),
                          ("s", "new", "", 22, "ssh", "", ""), ("s", "v", "", 22, "ssh", "P", "2")])
    found = {(r.ip, r.change_type, r.port) for r in B.baseline_changes(B.host_diff(now, then)).collect()}
    assert found == {("a", "opened_port", 81), ("a", "closed_port", 80), ("new", "new_host", None),
                     ("gone", "gone_host", None), ("v", "version_change", 22)}
    assert B.diff_summary(B.host_diff(now, then)).first().unchanged_count == 1
    opened = {tuple(r) for r in B.opened_ports(now, then).collect()}
    assert opened == {tuple(r) for r in B.closed_ports(then, now).collect()}


def test_first_scan_has_no_changes(spark, cafe):
    pairs = C.pairs_to_compare(C.describe(cafe, PO.explode_ports(cafe), None, F.lit("2024-01-01")), None)
    sides = B.scan_sides(B.port_profile(PO.explode_ports(cafe)), B.host_presence(cafe), pairs)
    assert pairs.count() == 0 and B.compare(sides).count() == 0


def test_hosts_without_ports_are_there(spark):
    ports = profile(spark, [("s", "a", "", 22, "ssh", "P", "1")])
    nobody = ports.filter("false")
    hosts = spark.createDataFrame([("s", "a", ""), ("s", "b", "")], "scan_id string, ip string, hostname string")
    diff = B.host_diff(ports, nobody, hosts, hosts)
    assert {(r.ip, r.change_type, r.port) for r in B.baseline_changes(diff).collect()} == {("a", "opened_port", 22)}
    assert {r.ip for r in diff.collect()} == {"a", "b"}
    lost = B.host_diff(nobody, ports, hosts.filter("ip = 'b'"), hosts)
    assert {(r.ip, r.change_type, r.port) for r in B.baseline_changes(lost).collect()} == {("a", "gone_host", None)}
    assert B.opened_ports(ports, nobody, hosts).count() == 1 and B.opened_ports(ports, nobody).count() == 0


def test_last_protocol_wins(spark):
    hosts = host_frame(spark, [host("a", "", [port(53, "x"), port(53, "y", protocol="udp")])])
    assert [r.service for r in B.port_profile(PO.explode_ports(hosts)).collect()] == ["y"]
    row = FE.record_features(hosts).first()
    assert (row.open_port_count, row.cleartext_count, row.has_dns) == (2, 0, 1)


def test_ignored_ports_keep_the_host(spark):
    hosts = host_frame(spark, [host("a", "n", [port(23, "telnet")])])
    ignored = spark.createDataFrame([(23,)], "port int")
    left = FE.host_features(PY.ignore_ports(PO.explode_ports(hosts), ignored), hosts).first()
    assert (left.ip, left.open_port_count, left.has_telnet, left.avg_port_risk_score) == ("a", 0, 0, 0.0)


def test_label_never_falls_when_a_risky_port_opens(spark, cafe):
    base = HO.add_labels(FE.host_features(PO.explode_ports(cafe)))
    more = PO.explode_ports(cafe).unionByName(PO.explode_ports(
        cafe.withColumn("open_ports", F.array(F.element_at("open_ports", 1).withField("port", F.lit(9200))))))
    scores = base.select("ip", F.col("heuristic_score").alias("a")).join(
        HO.add_labels(FE.host_features(more)).select("ip", F.col("heuristic_score").alias("b")), "ip")
    assert scores.filter("b < a").count() == 0


def test_trusted_override(spark):
    rows = spark.createDataFrame(
        [("s", "a", "suspicious", 0.9, 80.0, "MEDIUM", "Urgent", "x", "keep"),
         ("s", "b", "suspicious", 0.9, 80.0, "MEDIUM", "Urgent", "x", "keep")],
        "scan_id string, ip string, prediction string, predicted_probability_suspicious double, risk_score double, "
        "severity string, triage_status string, alerts string, recommendations string")
    got = {r.ip: r for r in PY.override_trusted(rows, spark.createDataFrame([("a",)], "ip string")).collect()}
    assert tuple(got["a"])[2:] == ("normal", 0.0, 0.0, "LOW", "—", "", "keep")
    assert tuple(got["b"])[2:4] == ("suspicious", 0.9)


def guesses(spark, *hosts):
    frame = host_frame(spark, list(hosts))
    return {(r.ip, r.port): r for r in E.apply_guesses(PO.explode_ports(frame), frame).collect()}


def test_guesses(spark):
    got = guesses(
        spark,
        host("apple", "macbook-1", [port(50000, ""), port(7000, "airplay"), port(4000, "unknown")]),
        host("media", "", [port(554, "rtsp"), port(5000, "")]),
        host("print", "", [port(631, "ipp"), port(9100, "")]),
        host("web", "", [port(80, "http"), port(4000, " Unknown ")]),
        host("none", "", [port(4000, "")]))

    def key(row):
        return row.service_guess, row.device_guess, row.guess_confidence
    assert key(got["apple", 50000]) == ("macos-dynamic-service", "Apple/macOS device", 0.7)
    assert key(got["apple", 4000]) == ("apple-continuity", "Apple/macOS device", 0.65)
    assert key(got["media", 5000]) == ("media-streaming-service", "camera/IoT/media device", 0.6)
    assert key(got["print", 9100]) == ("printer-related-service", "printer", 0.55)
    assert key(got["web", 4000]) == ("unknown-service", "network appliance or web-managed device", 0.3)
    assert key(got["none", 4000]) == ("unknown-service", "unknown device", 0.15)
    assert got["apple", 7000].service_guess is None and got["apple", 7000].service_source == "nmap"


def test_no_open_question_leaves_rows_alone(spark):
    frame = host_frame(spark, [host("a", "", [port(22, "ssh")])])
    row = E.enrich_unknown_ports(PO.explode_ports(frame), frame).first()
    assert (row.service_source, row.service_guess) == ("nmap", None)


def test_dedupe_with_many_copies(spark, cafe):
    copies = cafe.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(20))))
    kept = M.dedupe_records(copies, "n")
    assert kept.count() == 60 and kept.filter("n > 1").count() == 0


def test_learned_memory_counts_every_row(spark):
    rows = [("s1", f"2024-01-0{i}", "scan", i) for i in (1, 3, 2)]
    log = spark.createDataFrame(rows, "signature string, seen_at string, source string, event_id int")
    row = M.learned_memory(log, "event_id").first()
    assert (row.first_seen, row.last_seen, row.seen_count) == ("2024-01-01", "2024-01-03", 3)


def test_augment_only_when_needed(spark, cafe):
    full = TR.build_training(FE.record_features(cafe))
    assert TR.augment_training(full, full).count() == 60
    normal = full.filter("label = 'normal'")
    assert TR.augment_training(normal, full).count() == 60


def test_equal_scores_give_half(spark):
    rows = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 1.0), ("t", "a", 0.0), ("t", "b", 4.0)],
                                 "scan_id string, ip string, raw_score double")
    got = {(r.scan_id, r.ip): r.anomaly_score for r in HO.score_anomaly(rows).collect()}
    assert got == {("s", "a"): 0.5, ("s", "b"): 0.5, ("t", "a"): 1.0, ("t", "b"): 0.0}


def test_nested_enrichment_agrees_with_the_flat_one(spark):
    records = host_frame(spark, [
        host("apple", "macbook-1", [port(50000, ""), port(7000, "airplay"), port(4000, "unknown")]),
        host("media", "", [port(554, "rtsp"), port(5000, "")]), host("print", "", [port(631, "ipp"), port(9100, "")]),
        host("web", "", [port(80, "http"), port(4000, " Unknown "), port(53, "", protocol="udp"), port(53, "")]), host("none", "", [])])
    quiet = host_frame(spark, [host("a", "", [port(22, "ssh")])]).withColumn("scan_id", F.lit("quiet"))
    records = records.unionByName(quiet)
    flat = PO.explode_ports(records)
    second = flat.filter("port IN (4000, 53)").withColumns({
        "service": F.when(F.col("protocol") == "udp", "unknown").otherwise(F.lit("named")), "product": F.lit("found")})
    again = second.filter("ip = 'web'").withColumns({"pos": F.col("pos") + 10, "product": F.lit("last")})
    for looks in (None, second, second.unionByName(again)):
        want = E.enrich_unknown_ports(flat, records, looks)
        got = PO.explode_ports(E.enrich_records(records, looks)).select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_nested_enrichment_shuffles_little(spark, cafe, monkeypatch):
    plans, write = [], E.stored

    def recorded(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return write(rows, name)
    monkeypatch.setattr(E, "stored", recorded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        E.enrich_records(cafe, PO.explode_ports(cafe).filter("service = ''"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 2 and 2 <= sum(p.count("Exchange hashpartitioning") for p in plans) <= 6
