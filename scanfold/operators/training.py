"""Training table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanfold.operators.hosts import add_labels
from scanfold.values import rules as R

MIN_REAL_ROWS = 4


def build_training(features: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Features with label and confidence; samples join in when the data cannot train."""
    training = add_labels(features).drop("heuristic_score")
    if samples is None:
        return training
    return augment_training(training, add_labels(samples).drop("heuristic_score"))


def augment_training(training: DataFrame, samples: DataFrame) -> DataFrame:
    """Add the sample rows, without copies, if there are few rows or one label.

    The check reads one aggregated row; when it fails the training plan is unchanged.
    """
    state = training.agg(F.count("*").alias("rows"), F.min("label").alias("low"),
                         F.max("label").alias("high")).first()
    if state.rows >= MIN_REAL_ROWS and state.low != state.high:
        return training
    return training.unionByName(samples).dropDuplicates()


def class_weights(training: DataFrame) -> DataFrame:
    """Balanced class weight times label confidence, as column ``weight``."""
    counts = training.groupBy("label").agg(F.count("*").alias("_n"))
    balanced = counts.agg(F.sum("_n").alias("_total"), F.count("*").alias("_k"), F.collect_list(
        F.struct("label", "_n")).alias("_c")).select(F.explode("_c").alias("c"), "_total", "_k").select(
        "c.label", (F.col("_total") / (F.col("_k") * F.col("c._n"))).alias("class_weight"))
    # One row per label, and there are two labels.
    return training.join(F.broadcast(balanced), "label").withColumn(
        "weight", F.col("class_weight") * F.col("label_confidence")).select(
        *training.columns, "class_weight", "weight")


def train_gate(training: DataFrame) -> DataFrame:
    """One row: the note that stops training, or null."""
    if "label" not in training.columns:
        return training.sparkSession.range(1).select(F.lit(R.NOTE_NO_LABEL).alias("note"))
    return training.agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels")).select(
        "rows", "labels", F.when(F.col("rows") < R.MIN_TRAIN_ROWS, R.NOTE_FEW_ROWS)
        .when(F.col("labels") < 2, R.NOTE_ONE_CLASS).alias("note"))


def binary_metrics(scored: DataFrame, keys: list | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and confusion counts for ``suspicious``."""
    def cell(label, prediction):
        return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))
    counts = scored.groupBy(*(keys or [])).agg(
        F.count("*").alias("rows"), cell("normal", "normal").alias("true_normal"),
        cell("normal", "suspicious").alias("false_suspicious"),
        cell("suspicious", "normal").alias("false_normal"),
        cell("suspicious", "suspicious").alias("true_suspicious"))

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in (
        "true_suspicious", "false_suspicious", "false_normal", "true_normal"))
    return counts.withColumns({
        "accuracy": ratio(tp + tn, F.col("rows")), "precision_suspicious": ratio(tp, tp + fp),
        "recall_suspicious": ratio(tp, tp + fn), "f1_suspicious": ratio(2 * tp, 2 * tp + fp + fn),
        "precision_normal": ratio(tn, tn + fn), "recall_normal": ratio(tn, tn + fp),
        "f1_normal": ratio(2 * tn, 2 * tn + fp + fn)})
