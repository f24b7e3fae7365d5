"""Classifier over look-back sequences of nights; hidden states by default, so that their order counts."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.learning.preprocess import stratified_split
from nocturne.learning.states import SequenceStates
from nocturne.learning.training import with_probability
from nocturne.operators.metrics import model_metrics
from nocturne.schemas import LABEL, NIGHT_FEATURES


def flatten(sequences: DataFrame, features: tuple[str, ...] = NIGHT_FEATURES) -> DataFrame:
    """The sequence as one vector, night after night."""
    cells = F.flatten(F.transform("sequence", lambda n: F.array(*[n[c] for c in features])))
    return sequences.withColumn("raw", array_to_vector(cells))


def train_longitudinal(
    sequences: DataFrame, classifier: Estimator | None = None, label: str = LABEL, seed: int = 42
) -> tuple[PipelineModel, DataFrame]:
    """The fitted pipeline and its one-row hold-out metrics."""
    rows = flatten(sequences).withColumn("_key", F.concat_ws("#", "SID", "night_index"))
    split = stratified_split(rows, label, 0.2, seed, "_key").persist()
    if classifier is None:
        first = split.select(F.size("sequence").alias("steps")).first()
        if first is None:
            raise ValueError("no sequences: several nights of a SID are needed")
        classifier = SequenceStates(steps=first["steps"], featuresCol="features", labelCol=label)
    pipeline = Pipeline(
        stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), classifier]
    )
    model = pipeline.fit(split.filter(~F.col("is_test")))
    tested = with_probability(model.transform(split.filter("is_test")), "p").select(
        F.lit("longitudinal").alias("model_name"), label, F.col("prediction").cast("int").alias("prediction"),
        F.col("p").alias("probability"),
    )
    return model, model_metrics(tested, ("model_name",), label)
