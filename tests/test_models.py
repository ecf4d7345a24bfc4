"""Training, forest and the complete jobs."""

import math

from pyspark.sql import functions as F

from scanfold.operators import enrichment as EN
from scanfold.operators import features as FE
from scanfold.operators import forest
from scanfold.operators import memory as M
from scanfold.operators import models as MO
from scanfold.operators import ports as PO
from scanfold.operators import training as TR
from scanfold.plans import jobs
from scanfold.sources.workspace import stored
from scanfold.values import rules as R


def test_gate(spark, cafe):
    training = TR.build_training(FE.record_features(cafe))
    assert MO.train_models(training.limit(1))[1] == R.NOTE_FEW_ROWS
    assert MO.train_models(training.filter("label = 'normal'"))[1] == R.NOTE_ONE_CLASS
    assert MO.train_models(training.drop("label"))[1] == R.NOTE_NO_LABEL


def test_split_is_stratified_and_repeatable(cafe):
    training = stored(TR.build_training(FE.record_features(cafe)), "training")
    first = {r.ip: r.is_test for r in MO.split_rows(training).collect()}
    assert first == {r.ip: r.is_test for r in MO.split_rows(training).collect()}
    counts = {r.label: r.n for r in MO.split_rows(training).filter("is_test").groupBy("label").agg(
        F.count("*").alias("n")).collect()}
    assert counts == {"normal": 15, "suspicious": 4}


def test_forest_ranks_an_outlier_first(spark, cafe):
    rows = FE.record_features(cafe)
    odd = rows.select("scan_id", "ip", *[
        F.when(F.col("ip") == "10.10.0.1", 500).otherwise(F.col(c)).alias(c) for c in FE.feature_columns()])
    scored = forest.score_forest(odd, forest.fit_forest(odd)).collect()
    assert all(-1 <= r.raw_score < 0 for r in scored)
    assert min(scored, key=lambda r: r.raw_score).ip == "10.10.0.1"


def test_tree_samples_stay_bounded(spark):
    def sizes(rows):
        drawn = forest.tree_samples(rows, ["id"], R.FOREST_TREES, R.FOREST_SAMPLE, R.SEED)
        return [r["count"] for r in drawn.groupBy("tree_id").count().collect()]

    many = sizes(spark.range(400_000))
    assert len(many) == R.FOREST_TREES and min(many) >= R.FOREST_SAMPLE and max(many) < 4 * R.FOREST_SAMPLE
    some = sizes(spark.range(20_000))
    assert len(some) == R.FOREST_TREES and min(some) >= R.FOREST_SAMPLE and max(some) < 4 * R.FOREST_SAMPLE
    assert sizes(spark.range(300)) == [300] * R.FOREST_TREES


def test_forest_scores_match_a_plain_walk(spark, cafe):
    rows = FE.record_features(cafe)
    nodes = forest.fit_forest(rows)
    table = {(n.tree_id, n.node_id): n for n in nodes.collect()}
    assert len({tree for tree, _ in table}) == R.FOREST_TREES
    assert forest.fit_forest(rows).exceptAll(nodes).count() == 0

    def average(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    names = FE.feature_columns()
    for row in forest.score_forest(rows, nodes).collect():
        lengths = []
        for tree in range(R.FOREST_TREES):
            node, depth = 0, 0
            while table[tree, node].feature >= 0:
                n = table[tree, node]
                node = 2 * node + (1 if row[names[n.feature]] <= n.threshold else 2)
                depth += 1
            lengths.append(depth + average(table[tree, node].size))
        expected = -2 ** (-(sum(lengths) / len(lengths)) / average(60))
        assert abs(row.raw_score - expected) < 1e-9


def test_full_job(spark, cafe, tmp_path):
    trusted = spark.createDataFrame([("10.10.0.203",)], "ip string")
    out = str(tmp_path / "full")
    predictions, note = jobs.full_job(cafe, out, "2024-01-31 12:00:00", policy=jobs.Policy(trusted))
    assert note is None
    rows = {r.ip: r for r in predictions.collect()}
    assert len(rows) == 60
    assert all(0 <= r.risk_score <= 100 and 0 <= r.anomaly_score <= 1 for r in rows.values())
    assert rows["10.10.0.203"].prediction == "normal" and rows["10.10.0.203"].risk_score == 0.0
    agree = sum(r.prediction == ("suspicious" if 201 <= int(r.ip.split(".")[3]) <= 210 or r.ip.endswith(
        (".130", ".250")) else "normal") for r in rows.values())
    assert agree >= 55
    assert spark.read.parquet(f"{out}/baseline").count() == 149
    assert spark.read.parquet(f"{out}/diff").count() == 0
    assert spark.read.parquet(f"{out}/history").count() == 60
    assert spark.read.parquet(f"{out}/baseline_hosts").count() == 60
    assert spark.read.parquet(f"{out}/catalogue").first().ports == 149
    assert spark.read.parquet(f"{out}/scan_cache").first().host_count == 60
    run = spark.read.parquet(f"{out}/runs").first()
    asked = EN.enrichment_totals(PO.explode_ports(cafe)).first()
    assert (run.host_count, run.training_note, run.ran_second_pass) == (60, "", False)
    assert (run.unknown_hosts, run.unknown_ports) == (asked.unknown_hosts, asked.unknown_ports) and asked.unknown_hosts > 0
    known = M.read_memory(spark, f"{out}/memory")
    assert known.count() == 60 and {r.seen_count for r in known.collect()} == {1}
    lines = [r.value for r in spark.read.text(f"{out}/report/*").collect()]
    assert "Total Hosts Scanned: 60" in lines

    later = cafe.withColumn("scan_id", F.lit("s2")).filter("ip <> '10.10.0.1'")
    bundle = MO.load_bundle(spark, f"{out}/model")
    jobs.predict_job(later, bundle, out)
    diff = spark.read.parquet(f"{out}/diff").filter("is_gone_host").collect()
    assert [(r.scan_id, r.ip) for r in diff] == [("s2", "10.10.0.1")]


def test_training_skipped_still_saves_the_baseline(spark, cafe, tmp_path):
    out = str(tmp_path / "quiet")
    calm = cafe.filter("ip IN ('10.10.0.1', '10.10.0.2')")
    predictions, note = jobs.full_job(calm, out, "2024-01-31 12:00:00")
    assert predictions is None and note == R.NOTE_ONE_CLASS
    assert spark.read.parquet(f"{out}/baseline").count() == PO.explode_ports(calm).count()


def test_repeated_run_replaces_its_rows(spark, cafe, tmp_path):
    out = str(tmp_path / "again")
    calm = cafe.filter("ip IN ('10.10.0.1', '10.10.0.2')")
    for _ in range(2):
        jobs.full_job(calm, out, "2024-01-31 12:00:00")
    counts = [spark.read.parquet(f"{out}/{name}").count() for name in ("history", "snapshots", "runs", "scan_cache", "baseline_hosts")]
    assert counts == [2, 2, 1, 1, 2]
    assert {r.seen_count for r in M.read_memory(spark, f"{out}/memory").collect()} == {1}
    jobs.full_job(calm, out, "2024-02-01 12:00:00")
    assert {r.seen_count for r in M.read_memory(spark, f"{out}/memory").collect()} == {2}


def test_failed_candidates_are_reported(spark, cafe, tmp_path, monkeypatch):
    training = TR.build_training(FE.record_features(cafe))

    def fit(model, train, own=MO.fit_candidate):
        if "Logistic" in type(model).__name__:
            raise ValueError("no solver")
        return own(model, train)
    monkeypatch.setattr(MO, "fit_candidate", fit)
    bundle, note = jobs.train_job(training, str(tmp_path / "train"))
    told = {r.model_name: r.error for r in spark.read.json(str(tmp_path / "train" / "metrics")).collect()}
    assert note is None and bundle.model_name == "decision_tree" and "no solver" in told["logistic_regression"]
    assert bundle.metrics.filter("error IS NOT NULL").count() == 1


def test_fixture_job_writes_its_reports(spark, synthetic, tmp_path):
    out = str(tmp_path / "fixture")
    assert jobs.fixture_train_job(synthetic, out, "2024-01-31 12:00:00").count() == 20
    assert spark.read.parquet(f"{out}/port_details").count() == PO.explode_ports(synthetic).count()
    assert spark.read.text(f"{out}/scan_report").count() > 20 and spark.read.json(f"{out}/records").count() == 20
    assert "Total Hosts Scanned: 20" in [r.value for r in spark.read.text(f"{out}/report").collect()]
