"""Queries that compare each scan with the scan before it."""

from pyspark.sql import functions as F

from scanfold.operators import baseline as B
from scanfold.operators import catalogue as C
from scanfold.plans import jobs, reports
from scanfold.sinks import tables as SK
from scanfold.sources import driver_tables as D
from scanfold.sources.workspace import new_path, stored
from scanfold.workload import query
from scanfold.workload.oracle_base import with_views

KEYS = ["scan_id", "ip"]


def scans(spark, d):
    return D.scan_list(spark, d)


def pairs(spark, d):
    return C.previous_scans(scans(spark, d)).filter("previous_scan_id IS NOT NULL")


def sides(spark, d):
    return B.scan_sides(B.port_profile(D.port_obs(spark, d)), B.host_presence(D.hosts(spark, d)), pairs(spark, d))


def diff(spark, d, ports=None):
    """All changes; what both sides of a comparison read is written once."""
    profile = stored(B.port_profile(D.port_obs(spark, d) if ports is None else ports), "profile")
    present = stored(B.host_presence(D.hosts(spark, d)), "presence")
    return B.compare(B.scan_sides(profile, present, pairs(spark, d)))


PROFILE_SELECT = "SELECT scan_id, ip, hostname, port, service, product, version FROM prof"


@query("baseline_sink", with_views("obs prof", PROFILE_SELECT))
def baseline_sink(spark, d):
    path = new_path(spark, "baseline")
    SK.write_baseline(D.port_obs(spark, d), path)
    return spark.read.parquet(path).select(*KEYS, "hostname", "port", "service", "product", "version")


HOSTS_SELECT = "SELECT scan_id, ip, hostname FROM hosts"


@query("baseline_hosts_sink", with_views("hosts", HOSTS_SELECT))
def baseline_hosts_sink(spark, d):
    path = new_path(spark, "baseline-hosts")
    SK.write_baseline_hosts(D.hosts(spark, d), path)
    return spark.read.parquet(path).select(*KEYS, "hostname")


@query("baseline_profile", with_views("obs prof", """
SELECT scan_id, ip, max(hostname) AS hostname, string_agg(CAST(port AS VARCHAR), ',' ORDER BY port) AS ports,
  string_agg(port || ':' || service || ':' || product || ':' || version, ',' ORDER BY port) AS services
FROM prof GROUP BY scan_id, ip"""))
def baseline_profile(spark, d):
    nested = B.baseline_profile(D.port_obs(spark, d))
    services = F.transform("ports", lambda p: F.concat_ws(":", p.cast("string"), *[
        F.element_at("services", p)[c] for c in ("service", "product", "version")]))
    return nested.select(*KEYS, "hostname", F.array_join(F.col("ports").cast("array<string>"), ",").alias("ports"),
                         F.array_join(services, ",").alias("services"))


@query("baseline_hosts", with_views("obs prof", """
SELECT scan_id, ip, max(hostname) AS hostname, CAST(count(*) AS INT) AS port_count,
  string_agg(CAST(port AS VARCHAR), ', ' ORDER BY port) AS ports FROM prof GROUP BY scan_id, ip"""))
def baseline_hosts(spark, d):
    return B.baseline_hosts(B.baseline_profile(D.port_obs(spark, d)))


@query("previous_scan", with_views("obs prof", "SELECT scan_id, previous_scan_id FROM pairs"))
def previous_scan(spark, d):
    return B.previous_scans(scans(spark, d))


#: The scans by number of quarter, with a time for the even ones only; recorded are those before 1996.
TIMED = """
numbered AS (SELECT scan_id, CAST(substr(scan_id, 6, 4) AS INT) * 4 + CAST(substr(scan_id, 11, 1) AS INT) - 7968 AS n FROM (SELECT DISTINCT scan_id FROM lines)),
timed AS (SELECT 'scan-' || n AS scan_id, n, CASE WHEN n % 2 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(n % 7 AS INT)) END AS scan_time FROM numbered),
in_order AS (SELECT scan_id, n, lag(scan_id) OVER (ORDER BY scan_time NULLS FIRST, n) AS previous_scan_id FROM timed)"""


@query("previous_scan_by_time", with_views("lines", "SELECT scan_id, previous_scan_id FROM in_order WHERE n >= 16 AND previous_scan_id IS NOT NULL", TIMED))
def previous_scan_by_time(spark, d):
    """The scan before each scan of a batch, by time, where earlier scans are recorded and ids are numbers."""
    number = F.expr("cast(substr(scan_id, 6, 4) AS int) * 4 + cast(substr(scan_id, 11, 1) AS int) - 7968").alias("n")
    timed = scans(spark, d).select(number).select(
        F.concat(F.lit("scan-"), F.col("n").cast("string")).alias("scan_id"), "n",
        F.expr("CASE WHEN n % 2 = 0 THEN timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, n % 7, 0, 0) END").alias("scan_time"))
    listed = stored(timed.selectExpr("scan_id", "scan_time", "n AS hosts", "n AS ports", "false AS enriched", "timestamp'2024-02-01' AS recorded_at"), "timed")
    path = new_path(spark, "catalogue")
    SK.append_catalogue(listed.filter("hosts < 16"), path)
    return C.pairs_to_compare(listed.filter("hosts >= 16"), spark.read.parquet(path)).select("scan_id", "previous_scan_id")


@query("new_hosts", with_views("obs diff", "SELECT scan_id, ip FROM new_hosts"))
def new_hosts(spark, d):
    both = sides(spark, d)
    return B.new_hosts(both.current_hosts, both.baseline_hosts)


@query("gone_hosts", with_views("obs diff", "SELECT scan_id, ip FROM gone_hosts"))
def gone_hosts(spark, d):
    both = sides(spark, d)
    return B.gone_hosts(both.current_hosts, both.baseline_hosts)


@query("opened_ports", with_views("obs diff", "SELECT scan_id, ip, port FROM opened"))
def opened_ports(spark, d):
    both = sides(spark, d)
    return B.opened_ports(both.current, both.baseline, both.baseline_hosts)


@query("closed_ports", with_views("obs diff", "SELECT scan_id, ip, port FROM closed"))
def closed_ports(spark, d):
    both = sides(spark, d)
    return B.closed_ports(both.current, both.baseline, both.current_hosts)


@query("version_changes", with_views("obs diff", "SELECT * FROM versions"))
def version_changes(spark, d):
    both = sides(spark, d)
    return B.version_changes(both.current, both.baseline)


@query("port_set_difference", with_views("obs diff", """
SELECT c.scan_id, c.ip, array_to_string(list_sort(list_filter(c.ps, lambda p: NOT list_contains(b.ps, p))), ',') AS opened,
  array_to_string(list_sort(list_filter(b.ps, lambda p: NOT list_contains(c.ps, p))), ',') AS closed
FROM (SELECT scan_id, ip, list(port) AS ps FROM cur GROUP BY ALL) c
JOIN (SELECT scan_id, ip, list(port) AS ps FROM base GROUP BY ALL) b USING (scan_id, ip)"""))
def port_set_difference(spark, d):
    def nested(side):
        return side.groupBy(*KEYS).agg(F.collect_set("port").alias("ports"))
    both = sides(spark, d)
    return B.port_set_difference(nested(both.current), nested(both.baseline)).select(
        *KEYS, *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("opened", "closed")])


@query("full_baseline_diff", with_views("obs diff", "SELECT * FROM changes"))
def full_baseline_diff(spark, d):
    return B.baseline_changes(diff(spark, d))


SUMMARY = """
touched AS (SELECT scan_id, ip, change_type FROM changes WHERE change_type IN ('opened_port', 'closed_port') GROUP BY ALL),
summary AS (
  SELECT p.scan_id, (SELECT count(*) FROM new_hosts n WHERE n.scan_id = p.scan_id) AS new_hosts,
    (SELECT count(*) FROM gone_hosts g WHERE g.scan_id = p.scan_id) AS gone_hosts,
    (SELECT count(*) FROM touched t WHERE t.scan_id = p.scan_id AND change_type = 'opened_port') AS hosts_with_opened,
    (SELECT count(*) FROM touched t WHERE t.scan_id = p.scan_id AND change_type = 'closed_port') AS hosts_with_closed,
    (SELECT count(DISTINCT ip) FROM versions v WHERE v.scan_id = p.scan_id) AS hosts_with_version_changes,
    (SELECT count(*) FROM cur_hosts c SEMI JOIN base_hosts USING (scan_id, ip) ANTI JOIN touched USING (scan_id, ip)
      WHERE c.scan_id = p.scan_id) AS unchanged_count
  FROM pairs p WHERE p.previous_scan_id IS NOT NULL)"""


@query("unchanged_hosts", with_views("obs diff", "SELECT * FROM summary", SUMMARY))
def unchanged_hosts(spark, d):
    return B.diff_summary(diff(spark, d))


REPORT = SUMMARY + """,
report AS (
  SELECT scan_id, 1 AS section, ip, 0 AS item, '  + ' || ip AS line FROM new_hosts
  UNION ALL SELECT scan_id, 2, ip, 0, '  - ' || ip FROM gone_hosts
  UNION ALL SELECT scan_id, 3, ip, 0, '  ' || ip || '  +ports: ' || string_agg(CAST(port AS VARCHAR), ', ' ORDER BY port) FROM opened GROUP BY scan_id, ip
  UNION ALL SELECT scan_id, 4, ip, 0, '  ' || ip || '  -ports: ' || string_agg(CAST(port AS VARCHAR), ', ' ORDER BY port) FROM closed GROUP BY scan_id, ip
  UNION ALL SELECT scan_id, 5, ip, port, '  ' || ip || '  port ' || port || CASE WHEN service <> '' THEN ' [' || service || ']' ELSE '' END
    || ': ' || from_version || ' → ' || to_version FROM versions
  UNION ALL SELECT scan_id, 1, '', -1, 'New hosts appeared (' || new_hosts || '):' FROM summary WHERE new_hosts > 0
  UNION ALL SELECT scan_id, 2, '', -1, 'Hosts no longer reachable (' || gone_hosts || '):' FROM summary WHERE gone_hosts > 0
  UNION ALL SELECT scan_id, 3, '', -1, 'Newly opened ports (' || hosts_with_opened || ' host(s)):' FROM summary WHERE hosts_with_opened > 0
  UNION ALL SELECT scan_id, 4, '', -1, 'Ports no longer open (' || hosts_with_closed || ' host(s)):' FROM summary WHERE hosts_with_closed > 0
  UNION ALL SELECT scan_id, 5, '', -1, 'Service version changes (' || hosts_with_version_changes || ' host(s)):' FROM summary WHERE hosts_with_version_changes > 0
  UNION ALL SELECT scan_id, 0, '', -1, 'No changes detected — current scan matches the previous baseline.' FROM summary
    WHERE new_hosts + gone_hosts + hosts_with_opened + hosts_with_closed + hosts_with_version_changes = 0
  UNION ALL SELECT scan_id, 6, '', -1, 'Unchanged hosts: ' || unchanged_count FROM summary
    WHERE unchanged_count > 0 OR new_hosts + gone_hosts + hosts_with_opened + hosts_with_closed + hosts_with_version_changes = 0)"""


@query("baseline_diff_report", with_views("obs diff", "SELECT * FROM report", REPORT))
def baseline_diff_report(spark, d):
    return reports.baseline_diff_report(diff(spark, d))


@query("change_flags", with_views("obs diff", "SELECT * FROM flags"))
def change_flags(spark, d):
    return B.change_flags(diff(spark, d))


# --- the comparison of the jobs, over two batches of all scans -------------------------

FIRST_BATCH = "scan_id < 'scan-1996'"


def two_batches(spark, d, records, second=(None, None), ignored=(None, None)):
    """Changes that the job finds in both batches; the second one is compared with what the first one stored."""
    state = new_path(spark, "two-batches")
    found = []
    for n, part in enumerate([FIRST_BATCH, f"NOT {FIRST_BATCH}"]):
        found.append(jobs.compare_and_store_job(
            records.filter(part), f"{state}/run-{n}", f"2024-01-0{n + 1} 12:00:00", jobs.Policy(ignored=ignored[n]), second[n], state=state))
    return B.baseline_changes(found[0].unionByName(found[1]))


def job_changes(profile: str, now: str = "true") -> str:
    """DuckDB text of the changes: ``profile`` gives now_rows and then_rows from obs and seen_pairs s; presence is from hosts."""
    return f"""
seen_pairs AS (
  SELECT * FROM (SELECT scan_id, lag(scan_id) OVER (ORDER BY scan_id) AS previous_scan_id FROM (SELECT DISTINCT scan_id FROM lines))
  WHERE previous_scan_id IS NOT NULL),
{profile},
now AS (SELECT p.* FROM p JOIN seen_pairs s ON p.scan_id = s.scan_id WHERE {now}),
earlier AS (SELECT p.* REPLACE (s.scan_id AS scan_id) FROM p JOIN seen_pairs s ON p.scan_id = s.previous_scan_id WHERE {now}),
now_hosts AS (SELECT h.scan_id, h.ip FROM hosts h JOIN seen_pairs s ON h.scan_id = s.scan_id),
then_hosts AS (SELECT s.scan_id, h.ip FROM hosts h JOIN seen_pairs s ON h.scan_id = s.previous_scan_id),
found AS (
  SELECT scan_id, ip, 'new_host' AS change_type, CAST(NULL AS INT) AS port, CAST(NULL AS VARCHAR) AS service,
    CAST(NULL AS VARCHAR) AS from_version, CAST(NULL AS VARCHAR) AS to_version FROM now_hosts ANTI JOIN then_hosts USING (scan_id, ip)
  UNION ALL SELECT scan_id, ip, 'gone_host', NULL, NULL, NULL, NULL FROM then_hosts ANTI JOIN now_hosts USING (scan_id, ip)
  UNION ALL SELECT scan_id, ip, 'opened_port', port, NULL, NULL, NULL FROM now SEMI JOIN then_hosts USING (scan_id, ip) ANTI JOIN earlier USING (scan_id, ip, port)
  UNION ALL SELECT scan_id, ip, 'closed_port', port, NULL, NULL, NULL FROM earlier SEMI JOIN now_hosts USING (scan_id, ip) ANTI JOIN now USING (scan_id, ip, port)
  UNION ALL SELECT n.scan_id, n.ip, 'version_change', n.port, n.service, trim(t.product || ' ' || t.version), trim(n.product || ' ' || n.version)
  FROM now n JOIN earlier t USING (scan_id, ip, port)
  WHERE trim(t.product || ' ' || t.version) <> '' AND trim(n.product || ' ' || n.version) <> ''
    AND trim(t.product || ' ' || t.version) <> trim(n.product || ' ' || n.version))"""


LAST = "arg_max({0}, pos) AS {0}"
PLAIN_PROFILE = "p AS (SELECT scan_id, ip, port, " + ", ".join(LAST.format(c) for c in ("service", "product", "version")) + " FROM {rows} GROUP BY scan_id, ip, port)"


@query("job_diff_ignored_ports", with_views("obs hosts ignored", "SELECT * FROM found", job_changes(
    PLAIN_PROFILE.format(rows="obs"), "s.scan_id < 'scan-1996' OR port NOT IN (SELECT port FROM ignored)")))
def job_diff_ignored_ports(spark, d):
    """The second batch ignores ports: they make no change in it, also against scans that were stored with them."""
    return two_batches(spark, d, D.host_records(spark, d), ignored=(None, D.ignore_ports(spark, d)))


@query("job_diff_second_pass", with_views("obs hosts", "SELECT * FROM found", job_changes("""
looked AS (
  SELECT *, trim(lower(service)) IN ('', 'unknown') AND version NOT IN ('', 'vN') AS looked_at FROM obs),
both_forms AS (
  SELECT scan_id, ip, port, pos, false AS enriched, service, product, version FROM looked
  UNION ALL SELECT scan_id, ip, port, pos, true, CASE WHEN looked_at THEN 'resolved-' || port ELSE service END,
    CASE WHEN looked_at THEN 'second look' ELSE product END, version FROM looked),
p AS (SELECT scan_id, ip, port, enriched, arg_max(service, pos) AS service, arg_max(product, pos) AS product,
  arg_max(version, pos) AS version FROM both_forms GROUP BY scan_id, ip, port, enriched)""", "enriched = (s.previous_scan_id >= 'scan-1996')")))
def job_diff_second_pass(spark, d):
    """Only the second batch has a second pass: its names count between its own scans and make no change against the first batch."""
    return two_batches(spark, d, D.host_records(spark, d), second=(None, D.second_pass(spark, d).filter(f"NOT {FIRST_BATCH}")))


@query("job_diff_empty_hosts", with_views("obs hosts", "SELECT * FROM found", job_changes(
    PLAIN_PROFILE.format(rows="(SELECT * FROM obs WHERE port > 1000)"))))
def job_diff_empty_hosts(spark, d):
    """Hosts without a port above 1000 have none here, and still are there."""
    records = D.host_records(spark, d).withColumn("open_ports", F.filter("open_ports", lambda p: p["port"] > 1000))
    return two_batches(spark, d, records)
