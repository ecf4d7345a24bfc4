"""Texts of ports: summaries from the start of long outputs, and files written from narrow rows."""

import glob
import re

from pyspark.sql import functions as F

from scanfold.functions import port_rules as P
from scanfold.operators import ports as PO
from scanfold.plans import reports
from scanfold.sinks import tables as SK
from scanfold.values import rules as R

OUTPUTS = ["", None, " \t ", "a" * 500, "word  and\tmore\n" * 40, "x" + " " * 400 + "tail", " " * 300 + "late",
           " " * 900, "ab " * 50, "é ß " * 90, "y" * R.SCRIPT_MAX_LENGTH, "y" * (R.SCRIPT_MAX_LENGTH + 1),
           "z" * R.SCRIPT_MAX_LENGTH + " " * 200, "z" * (R.SCRIPT_MAX_LENGTH - 1) + " " * 200 + "q"]


def summary(output):
    text = re.sub(P.WHITESPACE.replace(r"\x{", r"\u").replace("}", ""), " ", output or "").strip(" ")
    if not text:
        return "id"
    return "id: " + (text if len(text) <= R.SCRIPT_MAX_LENGTH else text[:R.SCRIPT_MAX_LENGTH - 3] + "...")


def test_summary_of_long_and_blank_outputs(spark):
    rows = spark.createDataFrame([(i, [("id", t)]) for i, t in enumerate(OUTPUTS)], "i int, scripts array<struct<id:string,output:string>>")
    got = {r.i: r.s for r in rows.select("i", P.script_summary().alias("s")).collect()}
    assert got == {i: summary(t) for i, t in enumerate(OUTPUTS)}


def test_details_and_reports_are_made_from_narrow_rows(spark, synthetic, tmp_path):
    ports = PO.explode_ports(synthetic)
    moved = PO.in_order(ports)
    assert "scripts" not in moved.columns and "description" not in moved.columns
    # What is sent holds neither scripts nor texts.
    SK.write_port_details(ports, f"{tmp_path}/details")
    want = PO.port_details(ports)
    found = spark.read.parquet(f"{tmp_path}/details").select(*want.columns)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()

    SK.write_report(reports.scan_report_rows(ports), f"{tmp_path}/lines")
    SK.write_scan_report(ports, f"{tmp_path}/texts")

    def text(path):
        files = sorted(glob.glob(f"{tmp_path}/{path}/scan_id=*/part-*"), key=lambda f: (f.split("/")[-2], f.split("/")[-1]))
        return [(f.split("/")[-2], line) for f in files for line in open(f).read().splitlines()]
    assert text("lines") == text("texts") and text("texts")
    assert spark.read.text(f"{tmp_path}/texts").count() == reports.scan_report_rows(ports).agg(F.count("*")).first()[0]
