"""Models that are trained here: a gate of two classes and a choice among many, on standardized features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.roles import logistic


@dataclass(frozen=True)
class Gate:
    """A standardized logistic model as plain numbers, so that it runs as an expression."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    threshold: float = 0.3

    def probability(self, features: Sequence[Column]) -> Column:
        return logistic(features, self.means, self.deviations, self.weights, self.bias)

    def opens(self, features: Sequence[Column]) -> Column:
        return self.probability(features) >= self.threshold


def assembled(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="model__features").transform(rows)


def train_gate(rows: DataFrame, names: Sequence[str], label: str, rounds: int = 200, penalty: float = 1e-3, threshold: float = 0.3) -> Gate:
    """rows: numeric features and a label of 0 and 1. Spark sums the gradients over all rows; only the weights come back."""
    figures = rows.agg(*(f(x).alias(f"{p}{i}") for i, x in enumerate(names) for f, p in ((F.avg, "m"), (F.stddev_pop, "d")))).first()
    means = tuple(float(figures[f"m{i}"] or 0.0) for i in range(len(names)))
    deviations = tuple(float(figures[f"d{i}"] or 0.0) or 1.0 for i in range(len(names)))
    scaled = rows.select(*(((F.col(x) - m) / d).alias(f"x{i}") for i, (x, m, d) in enumerate(zip(names, means, deviations, strict=True))), F.col(label).cast("double").alias("label"))
    fitted = LogisticRegression(featuresCol="model__features", labelCol="label", maxIter=rounds, regParam=penalty, standardization=False).fit(assembled(scaled, [f"x{i}" for i in range(len(names))]))
    return Gate(means, deviations, tuple(float(x) for x in fitted.coefficients), float(fitted.intercept), threshold)


def train_choice(rows: DataFrame, names: Sequence[str], label: str, rounds: int = 100, penalty: float = 1e-3):
    """A multinomial logistic model over numeric features; label: whole numbers from 0."""
    scaled = assembled(rows, names).withColumn("model__label", F.col(label).cast("double"))
    return LogisticRegression(featuresCol="model__features", labelCol="model__label", family="multinomial", maxIter=rounds, regParam=penalty).fit(scaled)


def choose(rows: DataFrame, names: Sequence[str], model, out: str = "choice") -> DataFrame:
    done = model.transform(assembled(rows, names))
    return done.withColumn(out, F.col("prediction").cast("int")).drop("model__features", "rawPrediction", "probability", "prediction")


def held_out_accuracy(rows: DataFrame, key: str, names: Sequence[str], label: str, folds: int = 5, **more) -> DataFrame:
    """fold, n, right: each fold, by the key's hash, is judged by a model of the others."""
    dealt = rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    out = None
    for fold in range(folds):
        model = train_choice(dealt.where(F.col("fold") != fold), names, label, **more)
        judged = choose(dealt.where(F.col("fold") == fold), names, model).groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == F.col(label)).alias("right"))
        out = judged if out is None else out.unionByName(judged)
    return out
