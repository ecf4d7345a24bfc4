"""Order of scans, what a comparison reads, and scans that land as files."""

import pytest
from pyspark.sql import functions as F

from scanfold.operators import baseline as B
from scanfold.operators import catalogue as C
from scanfold.operators import ports as PO
from scanfold.plans import jobs
from scanfold.sinks import tables as SK
from scanfold.streaming import landing as L
from scanfold.streaming import monitor as ST
from tests.fixtures import host, host_frame, port


def catalogue(spark, rows, recorded="2024-02-01"):
    frame = spark.createDataFrame(rows, "scan_id string, scan_time string")
    return frame.select("scan_id", F.to_timestamp("scan_time").alias("scan_time"), F.lit(1).cast("long").alias("hosts"),
                        F.lit(1).cast("long").alias("ports"), F.lit(False).alias("enriched"), F.lit(recorded).cast("timestamp").alias("recorded_at"))


def before(frame):
    return {r.scan_id: r.previous_scan_id for r in frame.collect()}


def test_numbers_in_ids_are_compared_as_numbers(spark):
    ids = ["scan-9", "scan-10", "scan-1", "a2b10", "a2b9", "scan-007"]
    got = before(B.previous_scans(spark.createDataFrame([(i,) for i in ids], "scan_id string")))
    assert got == {"a2b9": None, "a2b10": "a2b9", "scan-1": "a2b10", "scan-007": "scan-1", "scan-9": "scan-007", "scan-10": "scan-9"}


def test_batch_between_recorded_scans(spark):
    recorded = catalogue(spark, [("scan-9", "2024-01-09"), ("scan-10", "2024-01-10"), ("x", "2024-01-12"), ("again", "2024-01-01")])
    moved = catalogue(spark, [("x", "2024-01-20")], "2024-03-01")
    batch = catalogue(spark, [("new", "2024-01-11"), ("late", "2024-01-10"), ("again", "2024-01-30"), ("first", None)])
    got = before(C.pairs_to_compare(batch, recorded.unionByName(moved)))
    assert got == {"late": "scan-9", "new": "scan-10", "again": "x"}


def test_only_the_scan_before_is_read(spark, tmp_path):
    state = str(tmp_path)
    for n in range(20):
        hosts = host_frame(spark, [host("a", "", [port(22, "ssh")]), host(f"h{n}", "", [port(80 + n, "http")])]).withColumn("scan_id", F.lit(f"scan-{n}"))
        ports = B.remember_first(PO.explode_ports(hosts))
        jobs.store_scans(ports, hosts, C.describe(hosts, ports, None, F.lit(f"2024-01-{n + 1:02d}").cast("timestamp")), state)
    new = host_frame(spark, [host("a", "", [port(22, "ssh"), port(23, "telnet")])]).withColumn("scan_id", F.lit("scan-20"))
    ports = PO.explode_ports(new)
    batch = C.describe(new, ports, None, F.lit("2024-02-01").cast("timestamp"))
    diff = jobs.scan_diff(ports, new, batch, state)
    assert {(r.ip, r.change_type, r.port) for r in B.baseline_changes(diff).collect()} == {("a", "opened_port", 23), ("h19", "gone_host", None)}
    plan = diff._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: [")[1].split("]")[0] for line in plan.splitlines() if "PartitionFilters: [" in line]
    stored = [text for text in filters if "scan_id" in text]
    # The ports once and the hosts once for each side; each scan of a stored table reads the one folder.
    assert stored and all("scan-19" in text for text in stored)
    kept = C.only_scans(spark.read.parquet(f"{state}/baseline"), spark.createDataFrame([("scan-19",)], "scan_id string"))
    assert kept.count() == 2
    many = C.only_scans(spark.read.parquet(f"{state}/baseline"), spark.createDataFrame([("scan-19",), ("scan-3",)], "scan_id string"), most=1)
    assert many.count() == 4


def test_second_pass_on_one_side_only(spark, tmp_path):
    records = host_frame(spark, [host("a", "", [port(22, "ssh", product="P", version="1"), port(4000, "", product="raw", version="1")])])
    second = PO.explode_ports(records).filter("port = 4000").withColumns({
        "service": F.lit("named"), "product": F.lit("second look"), "version": F.lit("2")})

    def run(name, day, second=None):
        found = jobs.compare_and_store_job(records.withColumn("scan_id", F.lit(name)), str(tmp_path / name), f"2024-01-{day} 00:00:00",
                                           second=second and second.withColumn("scan_id", F.lit(name)), state=str(tmp_path / "state"))
        return {(r.change_type, r.port, r.from_version, r.to_version) for r in B.baseline_changes(found).collect()}
    assert run("s1", "01") == set()
    assert run("s2", "02", second) == set()
    assert run("s3", "03", second.withColumn("version", F.lit("3"))) == {("version_change", 4000, "second look 2", "second look 3")}
    assert run("s4", "04") == set()


@pytest.fixture
def records(spark):
    def make(scan_id, *hosts):
        return host_frame(spark, list(hosts)).withColumn("scan_id", F.lit(scan_id))
    return make


def times(spark, *rows):
    return spark.createDataFrame(rows, "scan_id string, scan_time string").withColumn("scan_time", F.to_timestamp("scan_time"))


def collected(spark, folder, log, got):
    run = (L.read_drops(spark, folder, log, 1).writeStream.foreachBatch(
        lambda batch, epoch: got.append(sorted((r.scan_id, r.ip, str(r.scan_time)) for r in batch.collect())))
        .option("checkpointLocation", f"{log}-check").trigger(processingTime="0 seconds").start())
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def test_scans_are_taken_whole(spark, records, tmp_path):
    folder, log, got = str(tmp_path / "drops"), str(tmp_path / "log"), []
    odd = "s=1/a: +é%"
    L.write_scan_files(records("s2", host("a", "", [port(22, "ssh")])), folder)
    L.write_scan_files(records(odd, host("x", "", [])), folder)
    L.finish_scans(spark, folder, times(spark, (odd, "2024-01-01 10:00:00")))
    collected(spark, folder, log, got)
    assert [b for b in got if b] == [[(odd, "x", "2024-01-01 10:00:00")]]
    L.write_scan_files(records("s2", host("b", "", [port(22, "ssh")])), folder)
    collected(spark, folder, log, got)
    assert len([b for b in got if b]) == 1
    L.finish_scans(spark, folder, times(spark, ("s2", "2024-01-02"), ("none", "2024-01-03")))
    collected(spark, folder, log, got)
    assert [b for b in got if b][1:] == [[("s2", "a", "2024-01-02 00:00:00"), ("s2", "b", "2024-01-02 00:00:00")]]


def test_failing_cycle_is_set_aside(spark, records, tmp_path):
    folder, out, seen = str(tmp_path / "drops"), str(tmp_path / "out"), []
    for name in ("s1", "s2"):
        L.write_scan_files(records(name, host("a", "", [port(22, "ssh")])), folder)
    L.finish_scans(spark, folder, times(spark, ("s1", "2024-01-01"), ("s2", "2024-01-02")))

    def cycle(landed, scan_times, own, state, run_id):
        names = {r.scan_id for r in landed.collect()}
        if "s1" in names:
            raise ValueError("broken scan")
        seen.append((names, scan_times.count()))
    run = ST.monitor_stream(L.read_drops(spark, folder, f"{out}-log", 1), out, None, cycle)
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert seen == [({"s2"}, 1)]
    assert ["broken scan" in r.error for r in spark.read.parquet(f"{out}/dead_letter").collect()] == [True]


def test_baseline_sink_keeps_hosts_apart(spark, records, tmp_path):
    hosts = records("s1", host("a", "n", [port(22, "ssh")]), host("b", "", []))
    SK.write_baseline(PO.explode_ports(hosts), str(tmp_path / "ports"))
    SK.write_baseline_hosts(hosts, str(tmp_path / "hosts"))
    assert [(r.ip, r.port) for r in spark.read.parquet(str(tmp_path / "ports")).collect()] == [("a", 22)]
    assert {(r.ip, r.hostname) for r in spark.read.parquet(str(tmp_path / "hosts")).collect()} == {("a", "n"), ("b", "")}
