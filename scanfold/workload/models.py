"""Queries over trained models."""

from pyspark.sql import functions as F

from scanfold.functions import hashing
from scanfold.operators import features as FE
from scanfold.operators import forest
from scanfold.operators import hosts as HO
from scanfold.operators import models as MO
from scanfold.operators import policy as PY
from scanfold.operators import training as TR
from scanfold.plans import jobs, reports
from scanfold.sinks import tables as SK
from scanfold.sources import driver_tables as D
from scanfold.sources.workspace import new_path, stored
from scanfold.workload import query
from scanfold.values import rules as R
from scanfold.workload.memory import SIGNED
from scanfold.workload.oracle_base import (ALERTS, ASSET, FEATURE_NAMES, FEATURES, LABELLED, PROFILED, RECOMMENDED, quote,
                                           with_views)

KEYS = ["scan_id", "ip"]
RUN_AT = "2024-01-31 12:00:00"


def features(spark, d):
    return stored(FE.host_features(D.port_obs(spark, d)), "features")


def training(spark, d):
    """The training table, written once and read back."""
    return stored(TR.build_training(FE.host_features(D.port_obs(spark, d))), "training")


def trained(spark, d, with_forest=False):
    return MO.train_models(training(spark, d), with_forest)[0]


#: The test side of every label: the share with the smallest hashes.
SPLIT = f"""
mixed AS (SELECT *, {hashing.draw_sql(hashing.duck_row_hash(["scan_id", "ip"]), R.SEED)} AS mix FROM labelled),
parted AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY mix, scan_id, ip)
    <= ceil(round(count(*) OVER (PARTITION BY label) * {R.TEST_SHARE}, 6)) AS is_test FROM mixed)"""


@query("split", with_views("labelled", "SELECT scan_id, ip, label, is_test FROM parted", SPLIT))
def split(spark, d):
    return MO.split_rows(training(spark, d)).select(*KEYS, "label", "is_test")


# Fitted numbers differ from engine to engine, so what a fit gives is held against a second way to
# get it: a model's probabilities against its own coefficients or nodes as plain SQL, metrics against
# their counts. Everything that doesn't depend on a fit is compared as it is.

def scored_alike(rows, model):
    """Whether a row's probability and prediction are those of the model's SQL text."""
    p = F.col("predicted_probability_suspicious")
    return rows.withColumn("_p", F.expr(MO.scoring_sql(model))).withColumn(
        "agrees", (F.abs(p - F.col("_p")) < 1e-9) & p.between(0, 1) & ((F.col("prediction") == "suspicious") == (p > 0.5))).drop("_p")


def fitted_scores(spark, d, wanted):
    """Test rows scored by one candidate, and whether its SQL text gives the same."""
    rows = MO.split_rows(training(spark, d))
    train = TR.class_weights(rows.filter("NOT is_test")).withColumn("label_index", MO.label_index())
    state = train.agg(F.count("*").alias("rows"), F.sum("weight").alias("weight")).first()
    model = MO.fit_candidate(dict(MO.candidates(state.rows, state.weight))[wanted], train)
    return scored_alike(MO.score_rows(rows.filter("is_test"), model), model).select(*KEYS, "label", "agrees")


FITTED = "SELECT scan_id, ip, label, true AS agrees FROM parted WHERE is_test"


@query("logistic_regression", with_views("labelled", FITTED, SPLIT))
def logistic_regression(spark, d):
    return fitted_scores(spark, d, "logistic_regression")


@query("decision_tree", with_views("labelled", FITTED, SPLIT))
def decision_tree(spark, d):
    return fitted_scores(spark, d, "decision_tree")


def checked_metrics(metrics):
    """Per candidate: test rows, suspicious ones, and whether its metrics follow from its counts and the best one was kept."""
    def near(name, part, whole):
        return F.abs(F.col(name) - F.coalesce(F.try_divide(F.col(part) * F.lit(1.0), whole), F.lit(0.0))) < 1e-9
    tp, fp, fn, tn = (F.col(c) for c in ("true_suspicious", "false_suspicious", "false_normal", "true_normal"))
    best = metrics.agg(F.max("f1_suspicious").alias("f"), F.max_by("f1_suspicious", F.col("is_best").cast("int")).alias("kept")).first()
    return metrics.select(
        "model_name", "rows", (fn + tp).alias("suspicious"),
        (near("precision_suspicious", "true_suspicious", tp + fp) & near("recall_suspicious", "true_suspicious", tp + fn)
         & (F.abs(F.col("accuracy") - (tp + tn) / F.col("rows")) < 1e-9) & (F.col("rows") == tp + fp + fn + tn)
         & (F.abs(F.col("f1_suspicious") - F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))) < 1e-9)
         & F.lit(best.f == best.kept)).alias("agrees"))


METRICS = """
SELECT model_name, count(*) AS rows, count(*) FILTER (label = 'suspicious') AS suspicious, true AS agrees
FROM parted CROSS JOIN (VALUES ('logistic_regression'), ('decision_tree')) AS m(model_name) WHERE is_test GROUP BY model_name"""


@query("model_selection", with_views("labelled", METRICS, SPLIT))
def model_selection(spark, d):
    return checked_metrics(trained(spark, d).metrics)


@query("metrics_sink", with_views("labelled", METRICS, SPLIT))
def metrics_sink(spark, d):
    path = new_path(spark, "metrics")
    SK.write_metrics(trained(spark, d).metrics, None, path, spark)
    return checked_metrics(spark.read.schema(MO.METRICS_SCHEMA).json(path))


def ranked_importance(importance, bundle):
    """Rank, and whether the row is the one that the model's own numbers put there."""
    last = bundle.model.stages[-1]
    own = abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else last.featureImportances.toArray()
    want = sorted(zip(bundle.features, own.tolist()), key=lambda x: (-x[1], x[0]))
    found = [(r.feature, r.importance) for r in importance.collect()]  # one row per feature at most
    return importance.sparkSession.createDataFrame(
        [(n, want[n - 1] == row) for n, row in enumerate(found, 1)], "rank int, agrees boolean")


@query("feature_importance_topn", "SELECT CAST(n AS INT) AS rank, true AS agrees FROM range(1, 21) AS r(n)")
def feature_importance_topn(spark, d):
    bundle = trained(spark, d)
    return ranked_importance(MO.feature_importance(spark, bundle), bundle)


@query("feature_importance_report", "SELECT CAST(n AS INT) AS line_no, true AS agrees FROM range(0, 24) AS r(n)")
def feature_importance_report(spark, d):
    """Four head lines and one line for each of the 20 first features, each as the importances have it."""
    bundle = trained(spark, d)
    importance = MO.feature_importance(spark, bundle)
    want = ["Top AI factors used by the model", "=" * 32, f"Model: {bundle.model_name}", ""] + [
        f"{n}. {r.feature}: {r.importance:.6f} ({r.method})" for n, r in enumerate(importance.collect(), 1)]
    lines = reports.feature_importance_report(importance, bundle.model_name, spark)
    expected = spark.createDataFrame(list(enumerate(want)), "line_no int, want string")
    return lines.join(expected, "line_no", "full").select("line_no", F.col("line").eqNullSafe(F.col("want")).alias("agrees"))


#: The draws of each tree over all hosts, and the rows it grows on.
DRAWS = f"""
trees(tree_id, factor, shift) AS (VALUES {", ".join(str((t, *hashing.multipliers(R.SEED, t))) for t in range(R.FOREST_TREES))}),
drawn AS (
  SELECT tree_id, f.*, (({hashing.duck_row_hash(["scan_id", "ip"])}) * factor + shift) % {hashing.PRIME} AS draw FROM labelled f CROSS JOIN trees),
samples AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY draw, scan_id, ip) <= {R.FOREST_SAMPLE})"""


@query("forest_samples", with_views("labelled", """
SELECT tree_id, count(*) AS rows, max(draw) AS last_draw, CAST(sum(open_port_count) AS BIGINT) AS open_ports, min(scan_id || ' ' || ip) AS first_host
FROM samples GROUP BY tree_id""", DRAWS))
def forest_samples(spark, d):
    """What each tree grows on."""
    keys = ["scan_id", "ip"]
    rows = features(spark, d).select(*keys, "open_port_count")
    drawn = forest.smallest_draws(forest.tree_samples(rows, keys, R.FOREST_TREES, R.FOREST_SAMPLE, R.SEED), keys, R.FOREST_SAMPLE)
    return drawn.groupBy("tree_id").agg(
        F.count("*").alias("rows"), F.max("draw").alias("last_draw"), F.sum("open_port_count").alias("open_ports"),
        F.min(F.concat_ws(" ", "scan_id", "ip")).alias("first_host"))


DEPTH = 8  # 2 ** 8 rows to a tree


def _level(n: int) -> str:
    """DuckDB text of one level of all trees: the rows' nodes, and where each goes on."""
    def share(part):
        return f"(CAST('0x' || substr(md5('{R.SEED}|' || tree_id || '|' || node || '|{part}'), 1, 8) AS BIGINT) / 4294967296.0)"
    before = "SELECT tree_id, rid, 0 AS node FROM picked" if n == 0 else (
        f"SELECT r.tree_id, r.rid, 2 * r.node + CASE WHEN v.v <= s.threshold THEN 1 ELSE 2 END AS node FROM rows{n - 1} r "
        f"JOIN split{n - 1} s USING (tree_id, node) JOIN cells v ON v.rid = r.rid AND v.feature = s.feature")
    text = f"rows{n} AS ({before})"
    if n == DEPTH:
        return text
    return text + f""",
spread{n} AS (
  SELECT tree_id, node, feature, min(v) AS low, max(v) AS high, row_number() OVER (PARTITION BY tree_id, node ORDER BY feature) - 1 AS place,
    count(*) OVER (PARTITION BY tree_id, node) AS usable
  FROM rows{n} JOIN cells USING (rid) GROUP BY tree_id, node, feature HAVING max(v) > min(v)),
split{n} AS (
  SELECT tree_id, node, feature, low + (high - low) * {share("threshold")} AS threshold FROM spread{n}
  WHERE place = CAST(floor({share("feature")} * usable) AS BIGINT))"""


def forest_views(rows: str = "labelled") -> str:
    """DuckDB text of the forest over a feature table: samples, nodes."""
    values = ", ".join(f"CAST({name} AS DOUBLE)" for name in FEATURE_NAMES)
    sizes = " UNION ALL ".join(
        f"SELECT r.tree_id, r.node AS node_id, coalesce(s.feature, -1) AS feature, coalesce(s.threshold, 0.0) AS threshold, count(*) AS size "
        f"FROM rows{n} r LEFT JOIN {f'split{n}' if n < DEPTH else '(SELECT NULL AS tree_id, NULL AS node, NULL AS feature, NULL AS threshold)'} s "
        f"ON s.tree_id = r.tree_id AND s.node = r.node GROUP BY ALL" for n in range(DEPTH + 1))
    return DRAWS.replace("labelled", rows) + f""",
wide AS (SELECT scan_id || ' ' || ip AS rid, [{values}] AS vs FROM {rows}),
picked AS (SELECT tree_id, scan_id || ' ' || ip AS rid FROM samples),
cells AS MATERIALIZED (
  SELECT rid, unnest(range(0, {len(FEATURE_NAMES)})) AS feature, unnest(vs) AS v FROM wide SEMI JOIN picked USING (rid)),
""" + ",\n".join(_level(n) for n in range(DEPTH + 1)) + f""",
nodes AS MATERIALIZED ({sizes})"""


NODES = "SELECT tree_id, node_id, CAST(feature AS INT) AS feature, threshold, CAST(size AS INT) AS size FROM nodes"


def _path(n: str) -> str:
    return (f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1.0) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n} "
            f"WHEN {n} = 2 THEN 1.0 ELSE 0.0 END")


def score_views(rows: str = "labelled", scored: str = "wide") -> str:
    """DuckDB text of the raw and anomaly scores: every row walks down every tree."""
    steps = []
    for n in range(DEPTH):
        before = f"SELECT w.rid, t.tree_id, 0 AS node FROM {scored} w CROSS JOIN trees t" if n == 0 else f"FROM walk{n - 1}"
        steps.append(f"""walk{n} AS (
  SELECT w.rid, w.tree_id, CASE WHEN k.feature < 0 OR k.feature IS NULL THEN w.node
    ELSE 2 * w.node + CASE WHEN x.vs[k.feature + 1] > k.threshold THEN 2 ELSE 1 END END AS node
  FROM ({before}) w LEFT JOIN nodes k ON k.tree_id = w.tree_id AND k.node_id = w.node JOIN {scored} x ON x.rid = w.rid)""")
    return ",\n".join(steps) + f""",
lengths AS (
  SELECT w.rid, sum(floor(log2(w.node + 1)) + {_path("k.size")}) / {R.FOREST_TREES} AS average FROM walk{DEPTH - 1} w
  JOIN nodes k ON k.tree_id = w.tree_id AND k.node_id = w.node GROUP BY w.rid),
norm AS (SELECT {_path("m")} AS norm FROM (SELECT CAST(max(size) AS DOUBLE) AS m FROM nodes WHERE node_id = 0)),
scores AS (SELECT rid, -pow(2, -average / norm) AS raw_score FROM lengths CROSS JOIN norm),
with_keys AS (SELECT split_part(rid, ' ', 1) AS scan_id, split_part(rid, ' ', 2) AS ip, raw_score FROM scores),
ends AS (SELECT scan_id, min(raw_score) AS low, max(raw_score) AS high FROM with_keys GROUP BY scan_id),
anomalies_of AS (
  SELECT scan_id, ip, round(raw_score, 9) AS raw_score,
    CASE WHEN high > low THEN round(1 - (raw_score - low) / (high - low), 4) ELSE 0.5 END AS anomaly_score FROM with_keys JOIN ends USING (scan_id))"""


@query("isolation_forest_fit", with_views("labelled", NODES, forest_views()))
def isolation_forest_fit(spark, d):
    return forest.fit_forest(features(spark, d))


@query("isolation_forest_score", with_views("labelled", "SELECT * FROM anomalies_of", forest_views() + ",\n" + score_views()))
def isolation_forest_score(spark, d):
    rows = features(spark, d)
    scored = stored(forest.score_forest(rows, forest.fit_forest(rows)).select(*KEYS, "raw_score"), "raw-scores")
    return HO.score_anomaly(scored).select(*KEYS, F.round("raw_score", 9).alias("raw_score"), "anomaly_score")


def stored_bundle(spark, d):
    path = new_path(spark, "model")
    MO.save_bundle(trained(spark, d, with_forest=True), path)
    return path


@query("model_sink", with_views("labelled", NODES, forest_views()))
def model_sink(spark, d):
    return spark.read.parquet(f"{stored_bundle(spark, d)}/forest")


@query("model_load", f"SELECT CAST(n AS INT) AS rank, true AS agrees FROM range(1, {len(FEATURE_NAMES) + 1}) AS r(n)")
def model_load(spark, d):
    bundle = MO.load_bundle(spark, stored_bundle(spark, d))
    return ranked_importance(MO.feature_importance(spark, bundle, len(bundle.features)), bundle)


@query("predict", with_views("labelled", "SELECT scan_id, ip, anomaly_score, true AS agrees FROM anomalies_of", forest_views() + ",\n" + score_views()))
def predict(spark, d):
    bundle = MO.load_bundle(spark, stored_bundle(spark, d))
    return scored_alike(MO.predict_scores(features(spark, d), bundle), bundle.model).select(*KEYS, "anomaly_score", "agrees")


def policy(spark, d):
    return jobs.Policy(D.trusted_hosts(spark, d), D.ignore_ports(spark, d))


def checked_predictions(predictions, model, trusted=None):
    """Predictions of a job: what doesn't depend on the fit, and whether the rest follows from the model's SQL text."""
    rows = scored_alike(predictions, model)
    p, w = "predicted_probability_suspicious", R.RISK_WEIGHTS

    def level(found):
        return F.coalesce(*[F.when(F.contains("alerts", F.lit(f"[{name}]")), F.lit(value)) for name, value in found], F.lit(0.0))
    asset = F.coalesce(*[F.when(F.col("asset_type") == name, F.lit(value)) for name, value in R.ASSET_CRITICALITY])
    known = F.col(p) * w["probability"] + level(R.ALERT_SCORES) * w["alert"] + F.col("anomaly_score") * w["anomaly"] + asset * w["asset"]
    rest = F.col("risk_score") - known
    risk = F.coalesce(*[F.when(F.abs(rest - change * w["baseline"]) < 0.051, True) for change in (0.0, 0.5, 1.0)],
                      (F.col("risk_score") == 100) & (known > 89.9))
    severity = F.coalesce(*[F.when(F.col(p) > limit, F.lit(name)) for name, limit in R.SEVERITY_LEVELS], F.lit(R.LOWEST_SEVERITY))
    triage = F.coalesce(F.when(F.col("prediction") != "suspicious", F.lit(R.TRIAGE_NONE)), *[
        F.when(F.contains("alerts", F.lit(f"[{name}]")) | (F.col(p) > limit), F.lit(status)) for status, name, limit, _ in R.TRIAGE_RULES],
        F.lit(R.TRIAGE_MONITOR[0]))
    agrees = F.col("agrees") & risk & (F.col("severity") == severity) & (F.col("triage_status") == triage)
    if trusted is not None:
        rows = rows.join(trusted.select("ip", F.lit(True).alias("_trusted")), "ip", "left")
        quiet = ((F.col("prediction") == "normal") & (F.col(p) == 0) & (F.col("risk_score") == 0) & (F.col("severity") == R.LOWEST_SEVERITY)
                 & (F.col("triage_status") == R.TRIAGE_NONE))
        agrees = F.when(F.col("_trusted"), quiet).otherwise(agrees)
    return rows.select(*KEYS, "asset_type", "alerts", "open_port_count", "anomaly_score", "recommendations", agrees.alias("agrees"))


def job_rows(rows: str) -> str:
    """DuckDB text of the checked columns over a feature table with its alerts."""
    return f"""
SELECT l.scan_id, l.ip, {ASSET} AS asset_type, CASE WHEN t.ip IS NULL THEN coalesce(s.summary, 'No alerts') ELSE '' END AS alerts,
  open_port_count, anomaly_score,
  CASE WHEN len({RECOMMENDED}) = 0 THEN {quote(R.DEFAULT_RECOMMENDATION)} ELSE array_to_string({RECOMMENDED}, ' ; ') END AS recommendations, true AS agrees
FROM {rows} l JOIN anomalies_of USING (scan_id, ip) LEFT JOIN alert_sums s USING (scan_id, ip) LEFT JOIN trusted t ON t.ip = l.ip"""


#: Features of all hosts over the ports that are not ignored; ``obs`` may stand for other rows.
def visible_features(obs: str = "obs") -> str:
    columns = ", ".join(f"CAST(coalesce(f.{n}, 0) AS {'DOUBLE' if n == 'avg_port_risk_score' else 'INT'}) AS {n}" for n in FEATURE_NAMES)
    return (f"\nvisible AS (SELECT * FROM {obs} WHERE port NOT IN (SELECT port FROM ignored)),\n"
            + PROFILED.replace("FROM obs o", "FROM visible o").strip() + "," + FEATURES + "," + LABELLED + "," + ALERTS
            + f",\nall_hosts AS (SELECT h.scan_id, h.ip, h.hostname, {columns} FROM hosts h LEFT JOIN features f USING (scan_id, ip))")


POLICY_JOB = with_views("obs hosts ignored trusted", job_rows("all_hosts"), visible_features() + "," + forest_views("all_hosts") + ",\n" + score_views())


@query("train_job", with_views("labelled", METRICS, SPLIT))
def train_job(spark, d):
    out = new_path(spark, "train-job")
    jobs.train_job(training(spark, d), out)
    return checked_metrics(spark.read.schema(MO.METRICS_SCHEMA).json(f"{out}/metrics"))


@query("predict_job", POLICY_JOB)
def predict_job(spark, d):
    """Policy comes before training here too: the model knows no ignored port."""
    path, hosts, wanted = new_path(spark, "model"), D.hosts(spark, d), policy(spark, d)
    rows = FE.host_features(PY.ignore_ports(D.port_obs(spark, d), wanted.ignored), hosts)
    MO.save_bundle(MO.train_models(stored(TR.build_training(rows), "training"))[0], path)
    bundle = MO.load_bundle(spark, path)
    found = jobs.predict_job(D.host_records(spark, d), bundle, new_path(spark, "predict-job"), wanted)
    return checked_predictions(found, bundle.model, wanted.trusted)


@query("analyze_job", POLICY_JOB)
def analyze_job(spark, d):
    out, wanted = new_path(spark, "analyze-job"), policy(spark, d)
    found = jobs.analyze_job(D.host_records(spark, d), out, RUN_AT, wanted)[0]
    return checked_predictions(found, MO.load_bundle(spark, f"{out}/model").model, wanted.trusted)


#: Ports after the second pass; a run remembers each record once and trains on these.
SECOND_PASS = """
second_obs AS (
  SELECT * REPLACE (
    CASE WHEN looked_at THEN 'resolved-' || port ELSE service END AS service, CASE WHEN looked_at THEN 'second look' ELSE product END AS product)
  FROM (SELECT *, trim(lower(service)) IN ('', 'unknown') AND version NOT IN ('', 'vN') AS looked_at FROM obs)),"""
REMEMBERED = "," + SIGNED.replace("FROM obs)", "FROM visible)") + """,
firsts AS (SELECT * FROM signed QUALIFY row_number() OVER (PARTITION BY signature ORDER BY scan_id) = 1),
remembered AS (SELECT * FROM all_hosts SEMI JOIN firsts USING (scan_id, ip)),"""
EVERY_HOST = f""",
every_host AS (SELECT scan_id || ' ' || ip AS rid, [{", ".join(f"CAST({n} AS DOUBLE)" for n in FEATURE_NAMES)}] AS vs FROM all_hosts),
"""


@query("full_job", with_views("obs hosts ignored trusted", job_rows("all_hosts"), SECOND_PASS + visible_features("second_obs") + REMEMBERED
                              + forest_views("remembered") + EVERY_HOST + score_views(scored="every_host")))
def full_job(spark, d):
    out, wanted = new_path(spark, "full-job"), policy(spark, d)
    found = jobs.full_job(D.host_records(spark, d), out, RUN_AT, policy=wanted, second=D.second_pass(spark, d))[0]
    return checked_predictions(found, MO.load_bundle(spark, f"{out}/model").model, wanted.trusted)


@query("fixture_train_job", with_views("labelled alerts", job_rows("labelled"), """
trusted AS (SELECT NULL AS ip WHERE false),""" + forest_views() + ",\n" + score_views()))
def fixture_train_job(spark, d):
    out = new_path(spark, "fixture-job")
    found = jobs.fixture_train_job(D.host_records(spark, d), out, RUN_AT)
    return checked_predictions(found, MO.load_bundle(spark, f"{out}/model").model)
