"""Trivial-feature baselines and the classifier that stands in for the image network."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vector(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``features`` from number columns, or from one array column."""
    if len(columns) == 1 and dict(df.dtypes)[columns[0]].startswith("array"):
        return df.withColumn("features", array_to_vector(columns[0]))
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


def fit(train: DataFrame, model: str, weight: str | None = None, seed: int = 42, trees: int = 200):
    """A pipeline of standardised features and 'lr' or 'rf' on (features, label)."""
    if model == "lr":
        learner = LogisticRegression(featuresCol="scaled", maxIter=100, regParam=1e-4, family="multinomial")
    elif model == "rf":
        learner = RandomForestClassifier(featuresCol="scaled", numTrees=trees, maxDepth=8, seed=seed)
    else:
        raise ValueError(f"unknown model {model}")
    if weight:
        learner.setWeightCol(weight)
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[scaler, learner]).fit(train)


def predict(model, rows: DataFrame, labels: list[str]) -> DataFrame:
    """Rows with probabilities in label order, the predicted class and its confidence.

    Refuses a model with another number of classes.
    """
    known = model.stages[-1].numClasses
    if known != len(labels):
        raise ValueError(f"the model has {known} classes, {len(labels)} labels were given")
    p = vector_to_array("probability")
    names = F.array(*map(F.lit, labels))
    x = model.transform(rows).withColumn("p", p)
    return x.withColumn("predicted_class", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))).withColumn("confidence", F.array_max("p")).drop("scaled", "rawPrediction", "probability", "prediction")
