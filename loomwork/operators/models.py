"""Models on Spark ML: linear models, forests, ensembles, generalised linear models; empirical-Bayes shrinkage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Penalty mixtures of the linear models; the penalty itself is 0.1.
MIXTURES = {"ols": None, "ridge": 0.0, "lasso": 1.0, "elastic_net": 0.5}


def split(df: DataFrame, id_col: str, share: float = 0.75, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the id: the same rows on every run and cluster."""
    u = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    return df.where(u < share), df.where(u >= share)


def linear_model(kind: str, target: str, features: Sequence[str]) -> Pipeline:
    if kind not in MIXTURES:
        raise ValueError(f"no such model: {kind}")
    mixture = MIXTURES[kind]
    fit = LinearRegression(labelCol=target, featuresCol="features", regParam=0.0 if mixture is None else 0.1, elasticNetParam=mixture or 0.0)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), fit])


def fit_models(df: DataFrame, target: str, features: Sequence[str], kinds: Sequence[str] = tuple(MIXTURES)) -> dict[str, PipelineModel]:
    return {k: linear_model(k, target, features).fit(df) for k in kinds}


def tuned_linear(df: DataFrame, target: str, features: Sequence[str], folds: int = 3, penalties: Sequence[float] = (0.0, 0.01, 0.1), mixtures: Sequence[float] = (0.0, 0.5, 1.0), seed: int = 0):
    """The best of a grid of penalties and mixtures by cross-validated RMSE."""
    p = linear_model("ridge", target, features)
    grid = ParamGridBuilder().addGrid(p.getStages()[1].regParam, list(penalties)).addGrid(p.getStages()[1].elasticNetParam, list(mixtures)).build()
    return CrossValidator(estimator=p, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"), numFolds=folds, seed=seed).fit(df).bestModel


def predictions(df: DataFrame, models: Mapping[str, PipelineModel], keep: Sequence[str]) -> DataFrame:
    """A column of predictions per model, made one after the other on the same rows."""
    for name, m in models.items():
        df = m.transform(df).withColumnRenamed("prediction", f"p_{name}").drop("features", "rawPrediction", "probability")
    return df.select(*keep, *[f"p_{n}" for n in models])


def combined(columns: Sequence[str], how: str = "mean", weights: Sequence[float] | None = None) -> Column:
    """One prediction from several of the same row: mean, weighted (a weight per model) or median."""
    if how == "weighted":
        if weights is None or len(weights) != len(columns):
            raise ValueError("a weight per model is needed")
        return sum((F.col(c) * w for c, w in zip(columns, weights, strict=True)), F.lit(0.0)) / sum(weights)
    if how == "median":
        a, n = F.array_sort(F.array(*columns)), len(columns)
        return (F.get(a, (n - 1) // 2) + F.get(a, n // 2)) / 2
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)


def soft_votes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``vote``: predictions weighted by one over their variance in all rows."""
    v = df.agg(*[(1 / F.var_samp(c)).alias(f"__{c}") for c in columns])
    d = df.crossJoin(F.broadcast(v))  # one row
    total = sum((F.col(f"__{c}") for c in columns), F.lit(0.0))
    return d.withColumn("vote", sum((F.col(c) * F.col(f"__{c}") for c in columns), F.lit(0.0)) / total).drop(*v.columns)


def random_forest(df: DataFrame, target: str, features: Sequence[str], kind: str = "regress", trees: int = 50, seed: int = 0) -> PipelineModel:
    forest = RandomForestRegressor if kind == "regress" else RandomForestClassifier
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip"), forest(labelCol=target, featuresCol="features", numTrees=trees, seed=seed)]).fit(df)


def score(df: DataFrame, target: str, kind: str = "regress") -> float:
    """RMSE of regression, accuracy of classification."""
    if kind == "regress":
        return RegressionEvaluator(labelCol=target, metricName="rmse").evaluate(df)
    return MulticlassClassificationEvaluator(labelCol=target, metricName="accuracy").evaluate(df)


def tweedie_grid(df: DataFrame, target: str, features: Sequence[str], variances: Sequence[float] = (1.2, 1.5, 1.8)) -> list[tuple[float, float]]:
    """(variance power, deviance) of Tweedie models, the least deviance first."""
    x = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    out = []
    for v in variances:
        m = GeneralizedLinearRegression(family="tweedie", variancePower=v, linkPower=0.0, labelCol=target, featuresCol="features", maxIter=25).fit(x)
        out.append((v, m.summary.deviance))
    return sorted(out, key=lambda r: r[1])


def shrunken_rates(df: DataFrame, group: str, hits: str, trials: str) -> DataFrame:
    """Observed and empirical-Bayes rates per group: a beta prior by moments of the groups' rates."""
    g = df.groupBy(group).agg(F.sum(hits).cast("double").alias("hits"), F.sum(trials).cast("double").alias("trials")).withColumn("observed", F.col("hits") / F.col("trials"))
    p = g.agg(F.avg("observed").alias("m"), F.var_samp("observed").alias("v"))
    p = p.withColumn("k", F.greatest(F.col("m") * (1 - F.col("m")) / F.nullif("v", F.lit(0.0)) - 1, F.lit(1e-6)))
    d = g.crossJoin(F.broadcast(p))  # one row
    return d.select(group, "hits", "trials", "observed", F.coalesce((F.col("hits") + F.col("m") * F.col("k")) / (F.col("trials") + F.col("k")), F.col("m")).alias("shrunken"))


def inverse_error_weights(df: DataFrame, columns: Sequence[str], target: str) -> dict[str, float]:
    """A weight per column of predictions: one over its root mean squared error, scaled to sum 1; columns without predictions weigh 0."""
    rmse = df.agg(*[F.sqrt(F.avg((F.col(c) - F.col(target)) * (F.col(c) - F.col(target)))).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    perfect = [c for i, c in enumerate(columns) if rmse[f"e{i}"] == 0]
    if perfect:
        return {c: (1 / len(perfect) if c in perfect else 0.0) for c in columns}
    inverse = {c: 0.0 if rmse[f"e{i}"] is None else 1 / rmse[f"e{i}"] for i, c in enumerate(columns)}
    return {c: w / (sum(inverse.values()) or 1.0) for c, w in inverse.items()}


def stacked(df: DataFrame, target: str, features: Sequence[str], id_col: str, kinds: Sequence[str] = tuple(MIXTURES), folds: int = 3, seed: int = 0) -> tuple[dict[str, PipelineModel], PipelineModel]:
    """(base models, combiner): a linear model of the base models' predictions, each made for a fold by models that haven't seen it."""
    fold = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(folds))
    out = None
    for k in range(folds):
        held = predictions(df.where(fold == k), fit_models(df.where(fold != k), target, features, kinds), [target])
        out = held if out is None else out.unionByName(held)
    return fit_models(df, target, features, kinds), linear_model("ridge", target, [f"p_{k}" for k in kinds]).fit(out)


def stacked_predictions(df: DataFrame, models: tuple[dict[str, PipelineModel], PipelineModel], keep: Sequence[str]) -> DataFrame:
    """``keep``, the base models' predictions and the combiner's, ``p_stacked``."""
    base, top = models
    return top.transform(predictions(df, base, keep)).withColumnRenamed("prediction", "p_stacked").drop("features")


def tweedie_error(df: DataFrame, target: str, features: Sequence[str], id_col: str, folds: int = 5, variances: Sequence[float] = (1.2, 1.5, 1.8), seed: int = 0) -> float:
    """The mean squared error of Tweedie models over folds, mean of the folds; each fold's variance power is chosen on its training rows."""
    x = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)
    fold, errors = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(folds)), []
    for k in range(folds):
        power = tweedie_grid(df.where(fold != k), target, features, variances)[0][0]
        m = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=target, featuresCol="features", maxIter=25).fit(x.where(fold != k))
        e = F.col("prediction") - F.col(target)
        errors.append(m.transform(x.where(fold == k)).agg(F.avg(e * e)).first()[0])
    known = [e for e in errors if e is not None]
    return sum(known) / len(known)


def forest_selection(df: DataFrame, target: str, features: Sequence[str], kind: str = "regress", keep: int | None = None, trees: int = 50, seed: int = 0) -> DataFrame:
    """(feature, importance, selected) from a random forest, most important first: the first ``keep``, or those above the mean importance."""
    weights = random_forest(df, target, features, kind, trees, seed).stages[-1].featureImportances
    rows = sorted(((f, float(weights[i])) for i, f in enumerate(features)), key=lambda r: (-r[1], r[0]))
    mean = sum(w for _, w in rows) / max(len(rows), 1)
    return df.sparkSession.createDataFrame([(f, w, i < keep if keep is not None else w >= mean) for i, (f, w) in enumerate(rows)], "feature string, importance double, selected boolean")
