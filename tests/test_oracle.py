"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
CHOSEN = [
    "host_overview", "host_features", "records_to_dataframe", "ignored_port_features", "scan_xml_source",
    "drop_empty_hosts", "port_detail_rows", "script_summary", "port_report_rows", "unknown_enrichment_job",
    "host_alerts", "host_explanation", "full_baseline_diff", "baseline_diff_report", "predictions_table",
    "network_patterns", "rank_suspicious", "prediction_report", "dedupe_records", "learned_memory",
    "scan_cache_sink", "model_metrics", "split", "monitor_stream", "stateful_baseline",
    "stateful_late_scan", "history_stream", "previous_scan_by_time", "scan_xml_dead_letter", "remembered_records",
    "build_training_job", "job_diff_ignored_ports", "job_diff_second_pass", "job_diff_empty_hosts", "forest_samples",
    "isolation_forest_fit", "isolation_forest_score", "decision_tree", "model_selection", "fixture_train_job", "full_job",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def test_every_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", CHOSEN)
def test_query(spark, duck, key):
    frame = entry.queries()[key](spark, SF)
    columns = sorted(frame.columns)
    got = ordered(tuple(plain(v) for v in row) for row in frame.select(*columns).collect())
    result = duck.execute(entry.oracle_sql()[key])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert got == ordered(tuple(plain(row[i]) for i in places) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
