"""Leave-one-subject-out classification with small models in numpy, and its analysis.

A fold is (model, left-out subject) with the small matrix as its data; folds are
tasks.  Scaling is fitted inside the fold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.margins import SupportVectors
from pulseframe.operators.ranks import spread
from pulseframe.operators.trees import Forest, balanced_weights


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0):
    """L2-regularised logistic regression with balanced classes (Newton's method); returns a probability function."""
    w, z = balanced_weights(y), np.c_[x, np.ones(len(x))]
    beta, penalty = np.zeros(z.shape[1]), np.r_[np.ones(x.shape[1]), 0.0] / c
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        step = np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag(penalty + 1e-9), z.T @ (w * (p - y)) + penalty * beta)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return lambda v: 1 / (1 + np.exp(-(np.c_[v, np.ones(len(v))] @ beta)))


def forest(x: np.ndarray, y: np.ndarray, trees: int = 500) -> Forest:
    return Forest.grown(x, y, trees)


MODELS = {"logistic": logistic, "svm_rbf": SupportVectors, "forest": forest}


def leave_one_out(df: DataFrame, key: str, label: str, columns: list[str], models=tuple(MODELS), trees: int = 500) -> DataFrame:
    """model, key, y_true, y_pred, y_prob (4 digits), correct: each subject predicted by models of all others."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).cast(kind), F.col(label).cast("int").alias("__y"), *columns).dropna()
    folds = base.select(F.col(key).alias("__out")).crossJoin(spark.createDataFrame([(m,) for m in models], "model string"))  # models x subjects
    d = folds.crossJoin(base)  # the small matrix for each fold

    def run(p):
        import pandas as pd

        name, out = p["model"].iloc[0], p["__out"].iloc[0]
        p = p.sort_values(key)
        test = (p[key] == out).to_numpy()
        x, y = p[columns].to_numpy(float), p["__y"].to_numpy()
        mean, sd = x[~test].mean(0), x[~test].std(0)
        x = (x - mean) / np.where(sd > 0, sd, 1)
        more = {"trees": trees} if name == "forest" else {}
        model = MODELS[name](x[~test], y[~test], **more)
        prob = float(model(x[test])[0])
        # Support vectors decide by the side of the margin.
        truth, pred = int(y[test][0]), int(model.decide(x[test])[0] if hasattr(model, "decide") else prob >= 0.5)
        return pd.DataFrame([[name, out, truth, pred, round(prob, 4), truth == pred]], columns=["model", key, "y_true", "y_pred", "y_prob", "correct"])

    return spread(d, "model", "__out").groupBy("model", "__out").applyInPandas(run, f"model string, {key} {kind}, y_true int, y_pred int, y_prob double, correct boolean")


def consistency(folds: DataFrame, key: str) -> DataFrame:
    """all correct, all wrong or split over the models."""
    a = folds.groupBy(key).agg(F.bool_and("correct").alias("a"), F.bool_or("correct").alias("o"))
    return a.select(key, F.when(F.col("a"), "all correct").when(~F.col("o"), "all wrong").otherwise("split").alias("agreement"))


def prediction_table(folds: DataFrame, key: str, models: list[str]) -> DataFrame:
    return folds.groupBy(key, "y_true").pivot("model", models).agg(F.first("y_pred").alias("pred"), F.first("y_prob").alias("prob"), F.first("correct").alias("correct"))


def model_metrics(folds: DataFrame) -> DataFrame:
    """One row a model: balanced accuracy, area under the curve, sensitivity, specificity, predictive values, macro F1, accuracy, and the four counts.

    A rate without cases is 0, as is an F1 without any.
    """
    from pulseframe.operators.statistics import auc

    y, p = F.col("y_true") == 1, F.col("y_pred") == 1
    n = {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}
    a = folds.groupBy("model").agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    of = lambda x, whole: F.coalesce(F.try_divide(x, whole), F.lit(0.0))
    sens, spec = of(tp, tp + fn), of(tn, tn + fp)
    f1 = (of(2 * tp, 2 * tp + fp + fn) + of(2 * tn, 2 * tn + fp + fn)) / 2
    a = a.select("model", ((sens + spec) / 2).alias("balanced_accuracy"), sens.alias("sensitivity"), spec.alias("specificity"), of(tp, tp + fp).alias("ppv"), of(tn, tn + fn).alias("npv"), f1.alias("f1_macro"), of(tp + tn, tp + tn + fp + fn).alias("accuracy"), "tp", "tn", "fp", "fn")
    return a.join(auc(folds, "y_prob", y, ("model",)), "model", "left")


def truth(column: str = "y_true") -> Column:
    return F.col(column) == 1
