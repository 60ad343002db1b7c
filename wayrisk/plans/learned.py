"""The learned intensity model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayrisk.functions.risk import intensity_features
from wayrisk.sources.dimensions import FEATURE_WEIGHTS
from wayrisk.sources.sinks import exists

NAMES = list(FEATURE_WEIGHTS)


def featured(events: DataFrame) -> DataFrame:
    """``events`` with the six features, without keyword hits."""
    f = intensity_features(F.col("label"), F.col("label_confidence"), F.lit(0), F.lit(0), F.length("raw_text"))
    return events.withColumns({k: F.round(v.cast("double"), 6) for k, v in f.items()})


def training_set(events: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """(event_id, features, y) of confident events; y tells an intensity of at least one half (L3)."""
    known = featured(events.where(F.col("label_confidence") >= min_confidence))
    return known.select("event_id", *NAMES, (F.col("intensity_score") >= 0.5).cast("int").alias("y"))


def stages() -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=500)])


def balanced(train: DataFrame) -> DataFrame:
    """Weights that make both classes count the same."""
    n = train.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    total = n.agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k"))
    return train.join(F.broadcast(n.join(total)).select("y", (F.col("t") / (F.col("k") * F.col("c"))).alias("w")), "y")


def fit(train: DataFrame) -> PipelineModel:
    return stages().fit(balanced(train))


def cross_validated(train: DataFrame, folds: int = 5) -> float:
    """Mean area under the curve over folds."""
    cv = CrossValidator(estimator=stages(), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=folds, seed=1)
    return cv.fit(balanced(train)).avgMetrics[0]


def predict(featured_: DataFrame, model: PipelineModel, out: str = "probability") -> DataFrame:
    """``featured_``, which has the features as columns, with the probability of high intensity; nothing else is added."""
    scored = model.transform(featured_).withColumn("_p", vector_to_array("probability")[1])
    return scored.select(*featured_.columns, F.col("_p").alias(out))


def score(events: DataFrame, model: PipelineModel) -> DataFrame:
    """(event_id, probability) of high intensity."""
    return predict(featured(events), model).select("event_id", F.round("probability", 6).alias("probability"))


def save(model: PipelineModel, path: str) -> None:
    """Write the trained pipeline, over an older one (K7)."""
    model.write().overwrite().save(path)


def load(path: str, spark: SparkSession) -> PipelineModel | None:
    """The saved pipeline; None where there is none, so that the rules score instead (M9)."""
    return PipelineModel.load(path) if exists(spark, path) else None
