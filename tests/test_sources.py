"""Scan files with their edge cases, and the stored tables."""

from pyspark.sql import functions as F

from scanfold import schemas
from scanfold.operators import ports as PO
from scanfold.sinks import tables as SK
from scanfold.sources import scan_xml as X
from scanfold.sources import tables as ST

LONG = "a" * 200
FILE = f"""<?xml version="1.0"?>
<nmaprun>
<host><status state="up"/><address addr="02:00" addrtype="mac" vendor="Maker"/>
 <address addr="10.0.0.1" addrtype="ipv4"/><address addr="10.0.0.9" addrtype="ipv4"/>
 <hostnames><hostname name="first"/><hostname name="second"/></hostnames>
 <ports><port protocol="tcp" portid="22"><state state="open" reason="syn-ack"/>
  <service name="ssh" product="OpenSSH" version="9.0" method="probed" conf="10"/>
  <script id="banner" output="two&#10;lines   here"/><script id="long" output="{LONG}"/>
  <script id="empty" output=""/><script id="fourth" output="x"/></port>
  <port protocol="tcp" portid="23"><state state="closed"/></port>
  <port protocol="udp" portid="161"><state state="open|filtered"/></port>
  <port protocol="tcp" portid="9999"><state state="open"/></port></ports>
 <os><osmatch name="Linux" accuracy="98"/></os></host>
<host><status state="down"/><address addr="10.0.0.2" addrtype="ipv4"/>
 <ports><port protocol="tcp" portid="80"><state state="open"/></port></ports></host>
<host><status state="up"/><address addr="10.0.0.3" addrtype="ipv4"/></host>
<host><status state="up"/><address addr="fe80::1" addrtype="ipv6"/>
 <ports><port protocol="tcp" portid="80"><state state="open"/></port></ports></host>
<host><status state="up"/><address addr="10.0.0.5" addrtype="ipv4"/>
 <ports><port protocol="tcp" portid="80"><state state="closed"/></port></ports></host>
</nmaprun>
"""


def test_scan_file(spark, tmp_path):
    (tmp_path / "night.xml").write_text(FILE)
    raw = X.read_scan_xml(spark, str(tmp_path / "night.xml"))
    records = X.host_records(raw).collect()
    assert [(r.scan_id, r.ip, r.hostname, r.mac, r.vendor) for r in records] == [
        ("night", "10.0.0.1", "first", "02:00", "Maker")]
    first, second = records[0].open_ports
    assert (first.port, first.service, first.product, first.service_confidence) == (22, "ssh", "OpenSSH", "10")
    assert (second.port, second.service, second.service_source, second.scripts) == (9999, "", "nmap", [])
    assert [m.name for m in records[0].os_matches] == ["Linux"]
    assert sorted(r.ip for r in X.live_hosts(raw).collect()) == ["10.0.0.1", "10.0.0.3", "10.0.0.5"]
    assert sorted(r.port for r in X.open_port_list(raw).collect()) == [22, 80, 9999]
    summary = PO.enrich_ports(PO.explode_ports(X.host_records(raw))).filter("port = 22").first()
    assert summary.script_summary == f"banner: two lines here | long: {'a' * 137}... | empty"


GOOD = '<host start="1"><status state="up"/><address addr="10.0.0.{}" addrtype="ipv4"/><hostnames><hostname name="h"/></hostnames>' \
       '<ports><port protocol="tcp" portid="80"><state state="open"/><script id="a" output="&lt;host&gt; &lt;/host&gt;"/></port></ports></host>'
DAMAGED = {
    "attribute": GOOD.format(99).replace('addrtype="ipv4"', "addrtype=ipv4"), "tags": '<host><status state="up"></address></host>',
    "entity": "<host>&nope;</host>", "number": GOOD.format(99).replace('"80"', '"x80"'), "end": GOOD.format(99).replace("</host>", ""),
    "cut": GOOD.format(99)[:60], "nothing": "<host>", "hint": None}


def test_a_damaged_host_costs_only_itself(spark, tmp_path):
    for name, text in DAMAGED.items():
        (tmp_path / f"s {name}+1.xml").write_text(
            '<?xml version="1.0"?>\n<nmaprun><hosthint><status state="up"/></hosthint>' + GOOD.format(1) + "\n" + (text or "") + GOOD.format(2)
            + "\n\n" + GOOD.format(3) + "<runstats/></nmaprun>")
    dead = str(tmp_path / "dead")
    hosts = X.host_records(X.read_scan_xml(spark, str(tmp_path / "*.xml"), dead_letter=dead)).collect()
    assert sorted((r.scan_id, r.ip) for r in hosts) == sorted((f"s {n}+1", f"10.0.0.{i}") for n in DAMAGED for i in (1, 2, 3))
    assert {r.open_ports[0].scripts[0].output for r in hosts} == {"<host> </host>"}
    told = {r.scan_id: r.reason for r in spark.read.parquet(dead).collect()}
    assert told == {"s attribute+1": "not well-formed", "s tags+1": "not well-formed", "s entity+1": "not well-formed", "s number+1": "not well-formed",
                    "s end+1": "not closed", "s cut+1": "not closed", "s nothing+1": "not closed"}


def test_cut_files(spark, tmp_path):
    text = "<nmaprun>" + GOOD.format(1) + GOOD.format(2)
    for n in range(len(text)):
        if n % 23 == 0 or n > len(text) - 9:
            (tmp_path / f"{n}.xml").write_text(text[:n])
    elements = X.parse_elements(X.host_elements(spark, str(tmp_path / "*.xml")))
    read = {}
    for r in X.host_records(X.raw_hosts(elements)).collect():
        read.setdefault(int(r.scan_id), set()).add(r.ip[-1])
    first = len("<nmaprun>" + GOOD.format(1))
    for path in tmp_path.glob("*.xml"):
        n = int(path.stem)
        # Cut inside the last mark, a host is whole.
        want = {"1"} if first - 6 <= n else set()
        want |= {"2"} if n >= len(text) else set()
        assert read.get(n, set()) in (want, {"1"} if n >= first - 6 else set(), want | {"2"} if n >= len(text) - 6 else want)


def test_missing_json_is_empty(spark, tmp_path):
    rows = ST.read_json_or_empty(spark, str(tmp_path / "none"), schemas.HOST)
    assert rows.count() == 0 and rows.schema == schemas.HOST


def test_baseline_keeps_other_scans(spark, cafe, tmp_path):
    ports = PO.explode_ports(cafe)
    path = str(tmp_path / "baseline")
    SK.write_baseline(ports, path)
    SK.write_baseline(ports.withColumn("scan_id", F.lit("s2")).filter("port = 22"), path)
    SK.write_baseline(ports.withColumn("scan_id", F.lit("s2")).filter("port = 23"), path)
    stored = spark.read.parquet(path)
    assert stored.filter("scan_id = 's1'").count() == 149
    assert {r.port for r in stored.filter("scan_id = 's2'").select("port").collect()} == {23}


def test_history_skips_empty(spark, tmp_path):
    empty = spark.createDataFrame([], "a int, run_date date")
    assert SK.append_history(empty, str(tmp_path / "history")) is False
    assert not (tmp_path / "history").exists()
