"""Records built from the test tables, on rows of their own."""

import datetime

from pyspark.sql import functions as F

from scanfold.operators import ports as PO
from scanfold.sinks import tables as SK
from scanfold.sources import driver_tables as D
from scanfold.sources import scan_xml as X

LINES = "l_shipdate date, l_suppkey long, l_linenumber int, l_partkey long, l_tax double, l_returnflag string, l_quantity double, l_discount double"


def lines(spark, folder):
    day, later = datetime.date(1995, 2, 1), datetime.date(1995, 5, 1)
    rows = [(day, 5, 1, 7, 0.0, "A", 48.0, 0.0), (day, 5, 1, 7, 0.0, "R", 20.0, 0.1), (day, 5, 1, 9, 0.1, "N", 40.0, 0.1),
            (later, 5, 1, 7, 0.1, "A", 30.0, 0.0), (day, 5, 4, 3, 0.1, None, 10.0, 0.1), (None, 5, 2, 3, 0.1, "A", 10.0, 0.1),
            (day, None, 2, 3, 0.1, "A", 10.0, 0.1), (day, None, 3, 3, 0.1, "A", 10.0, 0.1), (day, None, None, 4, 0.1, "A", 10.0, 0.1),
            (day, 6, None, 4, 0.1, "A", 10.0, 0.1), (day, 6, 2, None, 0.1, "A", 46.0, 0.1), (day, 70000, 7, 1, 0.1, "R", 36.0, None)]
    spark.createDataFrame(rows, LINES).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def texts(rows):
    return sorted(r.t for r in rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("t")).collect())


def test_records_are_those_of_the_flat_tables(spark, tmp_path):
    d = lines(spark, tmp_path)
    nested = PO.nest_ports(D.port_obs(spark, d))
    assert texts(D.nested_ports(spark, d)) == texts(nested)
    joined = D.hosts(spark, d).drop("hostname").join(nested, ["scan_id", "ip"])
    assert texts(D.host_records(spark, d)) == texts(joined)
    assert D.host_records(spark, d).count() == 9


def test_line_items_of_a_host_are_sent_once(spark, tmp_path):
    rows = D._plain_records(D._line_ports(D.table(spark, lines(spark, tmp_path), "lineitem")))
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_host_is_parsed_once(spark, tmp_path):
    raw = X.parse_host_column(X.to_host_xml(D.host_records(spark, lines(spark, tmp_path))), "xml")
    for rows in (X.live_hosts(raw), X.host_records(raw)):
        # The union has two sides.
        assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("from_xml(") == 1


def test_training_rows_are_computed_once(spark, synthetic, tmp_path):
    from scanfold.operators.features import record_features
    from scanfold.operators.training import build_training
    training = build_training(record_features(synthetic)).withColumn("hostname", F.expr("uuid()"))
    SK.write_training(training, f"{tmp_path}/full", f"{tmp_path}/readable")
    readable = spark.read.option("header", True).csv(f"{tmp_path}/readable")
    assert {r.hostname for r in readable.collect()} == {r.hostname for r in spark.read.parquet(f"{tmp_path}/full").collect()}


def test_json_is_compressed(spark, tmp_path):
    records = D.host_records(spark, lines(spark, tmp_path))
    SK.write_json(records, f"{tmp_path}/records")
    assert list((tmp_path / "records").glob("*.json.gz")) and not list((tmp_path / "records").glob("*.json"))
    assert texts(spark.read.schema(records.schema).json(f"{tmp_path}/records")) == texts(records)
