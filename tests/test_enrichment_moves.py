"""The flat enrichment moves ports by host only, and its window gives what the host context gives."""

import contextlib
import io

from pyspark.sql import functions as F

from scanfold.operators import enrichment as E
from scanfold.operators import policy as PY
from scanfold.operators import ports as PO
from tests.fixtures import host, host_frame, port


def records(spark):
    return host_frame(spark, [
        host("10.0.0.1", "mac-a", [port(22, "ssh", "OpenSSH"), port(50000, "unknown"), port(80, "http")]),
        host("10.0.0.2", "", [port(50001, "", scripts=[("t", "AirPlay device")]), port(7000, "airplay")]),
        host("10.0.0.3", "printer-b", [port(9100, "unknown"), port(9100, "", protocol="udp")])])


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def test_window_and_join_give_one_context(spark):
    rows = records(spark)
    ports = E.with_guess_columns(PO.explode_ports(rows))
    # One host is listed twice, one isn't listed.
    hosts = rows.filter("ip <> '10.0.0.2'").unionByName(rows.filter("ip = '10.0.0.1'"))
    want = ports.join(E.host_context(ports, hosts), E.KEYS, "left")
    got = E._with_host_context(ports, hosts).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 10


def test_second_pass_joins_by_host(spark):
    ports = PO.explode_ports(records(spark))
    second = ports.filter("port = 9100 AND protocol = 'tcp'").withColumn("service", F.lit("jetdirect"))
    merged = E.merge_second_pass(ports, second.unionByName(second.withColumns({"pos": F.col("pos") + 1, "service": F.lit("last")})))
    assert {(r.protocol, r.port): r.service for r in merged.filter("port = 9100").collect()} == {("tcp", 9100): "last", ("udp", 9100): ""}
    assert merged.count() == ports.count()
    for text in plan(merged).splitlines():
        assert "Join [scan_id" not in text or "protocol" not in text.split("], [")[0]


def test_only_ignored_is_the_rest(spark):
    ports = PO.explode_ports(records(spark))
    ignored = spark.createDataFrame([(9100,), (22,), (22,)], "port int")
    rest = PY.only_ignored(ports, ignored)
    assert rest.count() == 3 and PY.ignore_ports(ports, ignored).unionByName(rest).exceptAll(ports).isEmpty()
