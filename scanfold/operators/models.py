"""Model training, selection, storage and prediction with MLlib."""

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.functions import hashing
from scanfold.operators import forest
from scanfold.operators.features import feature_columns, zero_fill
from scanfold.operators.training import binary_metrics, class_weights, train_gate
from scanfold.sources.workspace import stored
from scanfold.values import rules as R

LABELS = ["normal", "suspicious"]


#: One row per candidate; a failed one has an error and no numbers.
METRICS_SCHEMA = ("model_name string, is_best boolean, error string, rows long, true_normal long, false_suspicious long, "
                  "false_normal long, true_suspicious long, accuracy double, precision_suspicious double, "
                  "recall_suspicious double, f1_suspicious double, precision_normal double, recall_normal double, f1_normal double")


@dataclass
class ModelBundle:
    """Trained classifier, its metrics per candidate, and the anomaly forest."""

    model_name: str
    model: PipelineModel
    features: list
    metrics: DataFrame
    nodes: DataFrame | None = None
    errors: dict = field(default_factory=dict)


#: Bits of the mix that one pass of the split tells apart.
SPLIT_BITS = 11


def split_mix_sql() -> str:
    """Spark SQL text of the number that rows are split by."""
    return hashing.draw_sql(hashing.row_hash_sql(["scan_id", "ip"]), R.SEED)


def split_rows(training: DataFrame) -> DataFrame:
    """Add ``is_test``: a stratified split by hash order, the same on every run.

    Each label gives exactly its share of rows, those with the smallest hashes; equal hashes go by
    the keys. The last test row of a label is found by counting rows per range of the hash and
    refining the range that it lies in, so rows are neither sorted nor shuffled; only counts are.
    A label with one row goes to the training side; in a set where every row would
    do so, training and test are the same rows.
    """
    by_label = {r.label: r.n for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(by_label.values())
    share = R.TEST_SHARE_SMALL if total <= R.SMALL_SET_ROWS else R.TEST_SHARE
    stratified = min(by_label.values(), default=0) >= R.MIN_CLASS_ROWS_TO_STRATIFY
    group = F.col("label") if stratified else F.lit("")
    wanted = {g: math.ceil(round(n * share, 6)) for g, n in (by_label if stratified else {"": total}).items()}
    keys = stored(training.select("scan_id", "ip", group.alias("g"), F.expr(split_mix_sql()).alias("mix")), "split-keys")

    # Per group: the range of hashes that holds its last test row, and the test rows left in it.
    bits = 3 * SPLIT_BITS
    ranges = {g: (0, n) for g, n in wanted.items() if n > 0}
    for width in range(bits - SPLIT_BITS, -1, -SPLIT_BITS):
        place = F.shiftright("mix", width)
        inside = _any([(F.col("g") == g) & (F.shiftright("mix", width + SPLIT_BITS) == low >> width + SPLIT_BITS) for g, (low, _) in ranges.items()])
        counts = keys.filter(inside).groupBy("g", place.alias("place")).agg(F.count("*").alias("n")).orderBy("g", "place").collect()
        for g, (_, left) in list(ranges.items()):
            for row in (r for r in counts if r.g == g):
                if left <= row.n:
                    ranges[g] = (row.place << width, left)
                    break
                left -= row.n
    chosen = []
    for g, (mix, left) in ranges.items():
        # Rows with one hash of 31 bits are few; the last test row among them by its keys.
        last = keys.filter((F.col("g") == g) & (F.col("mix") == mix)).orderBy("scan_id", "ip").limit(left).agg(
            F.max(F.struct("scan_id", "ip")).alias("k")).first().k
        in_order = F.struct("scan_id", "ip") <= F.struct(F.lit(last.scan_id).alias("scan_id"), F.lit(last.ip).alias("ip"))
        chosen.append((F.col("_g") == g) & ((F.col("_mix") < mix) | ((F.col("_mix") == mix) & in_order)))
    return training.withColumns({"_g": group, "_mix": F.expr(split_mix_sql())}).withColumn(
        "is_test", F.coalesce(_any(chosen), F.lit(False))).select(*training.columns, "is_test")


def _any(conditions: list) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def label_index() -> Column:
    return F.when(F.col("label") == LABELS[1], 1.0).otherwise(0.0)


def candidates(rows: int, weight_sum: float) -> list:
    """Models to try, in order of preference on a tie."""
    models = []
    if rows >= R.MIN_ROWS_FOR_LINEAR:
        models.append(("logistic_regression", LogisticRegression(
            featuresCol="vector", labelCol="label_index", weightCol="weight",
            maxIter=R.LINEAR_MAX_ITER, regParam=1.0 / weight_sum, elasticNetParam=0.0,
            standardization=False)))
    models.append(("decision_tree", DecisionTreeClassifier(
        featuresCol="vector", labelCol="label_index", weightCol="weight",
        maxDepth=R.TREE_MAX_DEPTH, minInstancesPerNode=1, seed=R.SEED)))
    return models


def fit_candidate(model, train: DataFrame) -> PipelineModel:
    assembler = VectorAssembler(inputCols=feature_columns(), outputCol="vector")
    return Pipeline(stages=[assembler, model]).fit(train)


def score_rows(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add prediction and probability of ``suspicious``; absent features are zero."""
    filled = zero_fill(rows, feature_columns())
    scored = model.transform(filled)
    return scored.withColumns({
        "predicted_probability_suspicious": vector_to_array("probability")[1],
        "prediction": F.when(F.col("prediction") == 1.0, LABELS[1]).otherwise(LABELS[0]),
    }).select(*rows.columns, "prediction", "predicted_probability_suspicious")


def _tree_sql(node, features: list) -> str:
    """Nested CASE of a decision tree's node; a leaf gives its share of ``suspicious``."""
    if node.getClass().getSimpleName() == "LeafNode":
        shares = list(node.impurityStats().stats())
        return f"{shares[1] / sum(shares)!r}D"
    split = node.split()
    return (f"CASE WHEN {features[split.featureIndex()]} <= {float(split.threshold())!r}D "
            f"THEN {_tree_sql(node.leftChild(), features)} ELSE {_tree_sql(node.rightChild(), features)} END")


def scoring_sql(model: PipelineModel, features: list | None = None) -> str:
    """The model's probability of ``suspicious`` as SQL text over the feature columns, for scoring
    without the model's library. A tree has 127 nodes at most."""
    names, last = features or feature_columns(), model.stages[-1]
    if hasattr(last, "coefficients"):
        terms = [f"{float(c)!r}D * {name}" for name, c in zip(names, last.coefficients.toArray()) if c != 0]
        return f"1D / (1D + exp(-({' + '.join([f'{float(last.intercept)!r}D', *terms])})))"
    return _tree_sql(last._java_obj.rootNode(), names)


def train_models(training: DataFrame, with_forest: bool = True) -> tuple:
    """Fit all candidates and keep the best by F1; returns (bundle, note)."""
    note = train_gate(training).first().note
    if note is not None:
        return None, note
    # Read many times from here on.
    training = stored(training, "training-rows")
    split = split_rows(training)
    # Classes are balanced on the training side.
    train = class_weights(split.filter(~F.col("is_test"))).withColumn("label_index", label_index()).persist()
    test = split.filter("is_test").persist()
    try:
        state = train.agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"),
                          F.count_distinct("label").alias("labels")).first()
        if state.labels < 2:
            return None, R.NOTE_ONE_CLASS_SPLIT
        names = feature_columns()
        total = state.rows + test.count()
        best, reports, errors = None, [], {}
        for name, model in candidates(total, state.weight):
            try:
                fitted = fit_candidate(model, train)
                report = binary_metrics(score_rows(test, fitted)).withColumn("model_name", F.lit(name))
                row = report.first()
            except Exception as error:  # one failing candidate must not stop the others
                errors[name] = str(error)
                continue
            reports.append(row.asDict())
            if best is None or row.f1_suspicious > best[2]:
                best = (name, fitted, row.f1_suspicious)
        if best is None:
            return None, R.NOTE_ALL_FAILED
        spark = training.sparkSession
        failed = [{"model_name": name, "error": text} for name, text in errors.items()]
        metrics = spark.createDataFrame([{**r, "is_best": r["model_name"] == best[0]} for r in reports + failed], METRICS_SCHEMA)
        nodes = forest.fit_forest(training) if with_forest else None
        return ModelBundle(best[0], best[1], names, metrics, nodes, errors), None
    finally:
        train.unpersist()
        test.unpersist()


def feature_importance(spark: SparkSession, bundle: ModelBundle, top_n: int = 20) -> DataFrame:
    """Most important features of the chosen model; one row per feature at most."""
    model = bundle.model.stages[-1]
    if hasattr(model, "featureImportances"):
        values, method = model.featureImportances.toArray(), "tree_importance"
    else:
        values, method = abs(model.coefficients.toArray()), "absolute_coefficient"
    rows = [(name, float(v), method) for name, v in zip(bundle.features, values)]
    frame = spark.createDataFrame(rows, "feature string, importance double, method string")
    return frame.orderBy(F.desc("importance"), "feature").limit(top_n)


def save_bundle(bundle: ModelBundle, path: str) -> None:
    """Model, forest nodes, metrics and names below one folder."""
    spark = bundle.metrics.sparkSession
    bundle.model.write().overwrite().save(f"{path}/classifier")
    if bundle.nodes is not None:
        bundle.nodes.write.mode("overwrite").parquet(f"{path}/forest")
    bundle.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    spark.createDataFrame([(bundle.model_name, bundle.features, bundle.nodes is not None)],
                          "model_name string, features array<string>, has_forest boolean"
                          ).write.mode("overwrite").parquet(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    about = spark.read.parquet(f"{path}/about").first()
    nodes = spark.read.parquet(f"{path}/forest") if about.has_forest else None
    return ModelBundle(about.model_name, PipelineModel.load(f"{path}/classifier"), list(about.features),
                       spark.read.parquet(f"{path}/metrics"), nodes)


def predict_scores(features: DataFrame, bundle: ModelBundle) -> DataFrame:
    """Features with prediction, probability and anomaly score per scan."""
    from scanfold.operators.hosts import score_anomaly
    scored = score_rows(features, bundle.model)
    if bundle.nodes is None:
        return scored.withColumn("anomaly_score", F.lit(0.0))
    # Written once: the bounds and the scores both read what was scored.
    return score_anomaly(stored(forest.score_forest(scored, bundle.nodes), "raw-scores")).drop("raw_score")
