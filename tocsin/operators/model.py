"""Row weights, Spark ML learners and causal scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.operators.metrics import threshold_free
from tocsin.session import materialize


def positive_fraction(rows: DataFrame) -> DataFrame:
    """Mean over episodes of the share of positive rows (column pi_y)."""
    return rows.groupBy("episode_id").agg(F.avg("label").alias("_f")).agg(F.avg("_f").alias("pi_y"))


def _scaled(rows: DataFrame, weight: str) -> DataFrame:
    return rows.withColumn(weight, F.col(weight) / rows.agg(F.avg(weight)).scalar())


def training_weights(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Episode-equal, class-balanced weights with mean one over all rows."""
    pi = positive_fraction(rows).scalar()
    n = F.count("*").over(Window.partitionBy("episode_id"))
    y = F.col("label").cast("double")
    out = rows.withColumn("_n", n).withColumn("pi_y", pi).withColumn(
        weight, (1.0 / F.col("_n")) * (y / (2 * F.col("pi_y")) + (1 - y) / (2 * (1 - F.col("pi_y")))))
    return _scaled(out.drop("_n", "pi_y"), weight)


def validation_weights(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Episode-equal weights with mean one over all rows."""
    out = rows.withColumn(weight, 1.0 / F.count("*").over(Window.partitionBy("episode_id")))
    return _scaled(out, weight)


def _assembler(names: Sequence[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(names), outputCol="features")


def fit_logistic(train: DataFrame, names: Sequence[str], reg: float = 0.01, max_iter: int = 25):
    """Weighted logistic regression on imputed features; the cheap default."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    train = materialize(train, "logistic-train")  # the solver scans it many times
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, maxIter=max_iter)
    return Pipeline(stages=[_assembler(names), lr]).fit(train)


def fit_boosted(train: DataFrame, validation: DataFrame | None, names: Sequence[str], *, depth: int, eta: float,
                min_child: int, rounds: int, seed: int, subsample: float = 0.8, columns: float = 0.8):
    """Weighted boosted trees; validation rows, when given, stop the boosting early."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    gbt = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxDepth=depth, stepSize=eta,
        minInstancesPerNode=min_child, maxIter=rounds, subsamplingRate=subsample,
        featureSubsetStrategy=str(columns), seed=seed)
    rows = train
    if validation is not None:
        gbt = gbt.setValidationIndicatorCol("is_validation")
        rows = train.withColumn("is_validation", F.lit(False)).unionByName(
            validation.withColumn("is_validation", F.lit(True)))
    return Pipeline(stages=[_assembler(names), gbt]).fit(rows)


def score_rows(model, rows: DataFrame, keep: Sequence[str] = ("episode_id", "t")) -> DataFrame:
    """Risk per row, ready for the trajectory operators."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*keep, F.element_at(vector_to_array("probability"), 2).alias("risk"))


def fit_grid(train: DataFrame, validation: DataFrame, names: Sequence[str], grid: Sequence[Mapping], *,
             rounds: int, seed: int) -> tuple[list, DataFrame]:
    """Fit every setting and score it by the episode-equal PR-AUC on the validation rows.

    Returns the models in grid order and the grid table (grid_no, max_depth, eta,
    min_child, best_score, trees_used).
    """
    from tocsin.functions.tables import values

    train, validation = materialize(train, "grid-train"), materialize(validation, "grid-validation")
    models, rows = [], []
    for no, g in enumerate(grid):
        model = fit_boosted(train, validation, names, depth=g["max_depth"], eta=g["eta"],
                            min_child=g["min_child"], rounds=rounds, seed=seed)
        scored = score_rows(model, validation, ("episode_id", "label")).withColumnRenamed("risk", "value")
        quality = threshold_free(scored).first()
        score = quality["pr_auc"] if quality else None  # NULL when the rows hold one class
        rows.append((no, int(g["max_depth"]), float(g["eta"]), int(g["min_child"]), score, len(model.stages[-1].trees)))
        models.append(model)
    return models, values(train.sparkSession, ["grid_no", "max_depth", "eta", "min_child", "best_score", "trees_used"], rows)


def select_setting(grid: DataFrame) -> DataFrame:
    """Best score first, then the shallower, slower, larger-leaf, smaller model."""
    return grid.orderBy(F.desc("best_score"), "max_depth", "eta", F.desc("min_child"), "trees_used").limit(1)


def feature_importance(model, names: Sequence[str], top: int = 20) -> DataFrame:
    from pyspark.sql import SparkSession

    from tocsin.functions.tables import values

    weights = model.stages[-1].featureImportances.toArray().tolist()
    table = values(SparkSession.getActiveSession(), ["feature", "importance"], list(zip(names, weights)))
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def learner_counts(rows: DataFrame, part: str = "split") -> DataFrame:
    """Rows, episodes, positive episodes and hours, and rows per episode, by part."""
    per = rows.groupBy(part, "episode_id").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    return per.groupBy(part).agg(
        F.count("*").alias("n_episodes"), F.sum("n").alias("n_rows"),
        F.count(F.when(F.col("pos") > 0, 1)).alias("n_positive_episodes"), F.sum("pos").alias("n_positive_hours"),
        F.min("n").alias("minimum_rows"), F.percentile("n", F.lit(0.5)).alias("median_rows"), F.max("n").alias("maximum_rows"))
