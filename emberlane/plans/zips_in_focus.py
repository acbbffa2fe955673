"""Which zip codes report more false alarms than the city's median: compare models, refit, predict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.functions.constants import THRESHOLD
from emberlane.functions.logic import above
from emberlane.models import evaluation
from emberlane.models.forest import fit_forest
from emberlane.models.kde_bayes import fit_kernel_bayes
from emberlane.models.knn import fit_knn
from emberlane.models.logistic import fit_logistic
from emberlane.models.split import split_exact
from emberlane.plans.zip_features import FEATURES, LABEL


def _part(features: DataFrame, *names: str) -> DataFrame:
    return features.where(F.col("split").isin(list(names)))


def compare_zip_models(features: DataFrame, threshold: float = THRESHOLD, model_features: list[str] | None = None) -> DataFrame:
    """Fit the four models on the train part and score them on the validate part.

    A row without a score counts for no model that leaves it unscored.
    """
    used = model_features or FEATURES
    divided = split_exact(features, "ZIPCODE")
    train, validate = _part(divided, "train"), _part(divided, "validate")
    logistic = fit_logistic(train, LABEL, used).score(validate)
    bayes = fit_kernel_bayes(train, LABEL, used).predict(validate)
    forest = fit_forest(train, LABEL, used, key="ZIPCODE").score(validate)
    neighbours = fit_knn(train, "ZIPCODE", LABEL, used).predict(validate)
    hard = lambda scored: scored.withColumn("prediction", above(F.col("probability"), threshold))
    return evaluation.compare(
        [
            evaluation.model_row(hard(logistic), "logistic", "prediction", LABEL),
            evaluation.model_row(neighbours, "knn", "prediction", LABEL),
            evaluation.model_row(hard(bayes), "kernel_bayes", "prediction", LABEL),
            evaluation.model_row(hard(forest), "forest", "prediction", LABEL),
        ]
    )


def refit_and_test(features: DataFrame, model_features: list[str] | None = None) -> DataFrame:
    """Nearest neighbours refitted on train and validate, measured on the test part."""
    divided = split_exact(features, "ZIPCODE")
    model = fit_knn(_part(divided, "train", "validate"), "ZIPCODE", LABEL, model_features or FEATURES)
    return evaluation.model_row(model.predict(_part(divided, "test")), "knn", "prediction", LABEL)


def zips_in_focus(features: DataFrame, model_features: list[str] | None = None) -> DataFrame:
    """All zip features with the refitted model's prediction, for the zips predicted above the median.

    ``model_features`` defaults to the five features without the label, the count
    it is made from and the zip code itself, which would all give the answer away.
    """
    divided = split_exact(features, "ZIPCODE")
    model = fit_knn(_part(divided, "train", "validate"), "ZIPCODE", LABEL, model_features or FEATURES)
    return model.predict(features, "predictions").where(F.col("predictions") == 1)
