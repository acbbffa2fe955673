"""Unpenalised logistic regression on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels that a factor may have; each is a term of the model and a number in the driver's memory.
MAX_LEVELS = 1000


@dataclass
class LogisticModel:
    """A fitted model; ``score`` adds ``probability`` and ``link`` (log-odds)."""

    pipeline: PipelineModel
    columns: list[str]
    schema: T.StructType
    levels: dict[str, list[str]]
    #: Factors with one level in the training rows, which have no term.
    constant: list[str]
    #: Whether the iterations ended by themselves and not at ``max_iter``.
    converged: bool

    def score(self, df: DataFrame) -> DataFrame:
        """All rows. A NULL (or NaN) in a model column, or a level the training rows lack, gives a NULL score."""
        return score_all_rows(df, self.pipeline.transform, self.columns, self.levels, ["probability", "link"])

    def coefficients(self, spark) -> DataFrame:
        """One row per term: estimate and odds ratio. As many rows as the model has terms."""
        fit = self.pipeline.stages[-1]
        features = self.pipeline.stages[0].transform(spark.createDataFrame([], self.schema)).schema["features"]
        named = sorted((a["idx"], a["name"]) for group in features.metadata["ml_attr"]["attrs"].values() for a in group)
        rows = [("(Intercept)", float(fit.intercept))]
        rows += [(name, float(value)) for (_, name), value in zip(named, fit.coefficients)]
        table = spark.createDataFrame(rows, "term string, estimate double")
        return table.withColumn("odds", F.exp("estimate"))


def factor_levels(df: DataFrame, categorical: Sequence[str], most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """The levels of each factor, in order, as many as the model has terms for it.

    They are held by the driver, so a factor of more than ``most`` levels is refused and no more rows than that are fetched.
    """
    if not categorical:
        return {}
    pairs = [F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in categorical]
    found = df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.*").where(F.col("level").isNotNull()).distinct()
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    for r in found.limit(most * len(categorical) + 1).collect():
        levels[r["factor"]].append(r["level"])
    for c, own in levels.items():
        if len(own) > most:
            raise ValueError(f"factor {c} has more than {most} levels")
    return {c: sorted(own) for c, own in levels.items()}


def score_all_rows(
    df: DataFrame, transform: Callable[[DataFrame], DataFrame], columns: Sequence[str], levels: dict[str, list[str]], added: Sequence[str | Column]
) -> DataFrame:
    """``df`` with the columns ``added`` by ``transform``, NULL where a row cannot be scored.

    Such rows go through the model with values it knows, in place of their own, and their scores are
    then taken away: one pass, and no row is lost.
    """
    known = F.lit(True)
    for c in columns:
        good = F.col(c).cast("string").isin(levels[c]) if c in levels else ~F.isnan(F.col(c).cast("double"))
        known = known & F.col(c).isNotNull() & good
    known = F.coalesce(known, F.lit(False))
    stand_in = lambda c: F.lit(levels[c][0] if levels[c] else "") if c in levels else F.lit(0.0)
    own = lambda c: F.col(c).cast("string" if c in levels else "double")
    filled = df.select(
        F.struct(*df.columns).alias("_row"), known.alias("_known"), *[F.when(known, own(c)).otherwise(stand_in(c)).alias(c) for c in columns]
    )
    made = [F.col(c) if isinstance(c, str) else c for c in added]
    scored = transform(filled).withColumns({f"_made{i}": m for i, m in enumerate(made)})
    names = [c if isinstance(c, str) else "probability" for c in added]
    return scored.select("_row.*", *[F.when(F.col("_known"), F.col(f"_made{i}")).alias(n) for i, n in enumerate(names)])


def fit_logistic(
    train: DataFrame,
    outcome: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    weight: Column | None = None,
    max_iter: int = 25,
    max_levels: int = MAX_LEVELS,
) -> LogisticModel:
    """Fit by iterated weighted least squares on the training rows without NULLs.

    Rows with equal features and outcome are first merged into one whose weight is
    their sum. The likelihood and so the estimates stay the same, and with factor
    features every iteration reads the distinct combinations, not the rows. The
    alphabetically first level of a factor is the reference. A factor with one level has no
    term; the model names it in ``constant``, and says in ``converged`` whether ``max_iter`` cut the
    iterations short. A factor of more than ``max_levels`` levels is an error.
    """
    used = train.select(
        F.col(outcome).cast("double").alias(outcome),
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in categorical],
        (F.lit(1.0) if weight is None else weight.cast("double")).alias("_weight"),
    ).na.drop("any")
    levels = factor_levels(used, categorical, max_levels)
    factors = [c for c in categorical if len(levels[c]) > 1]
    terms = [*factors, *numeric]
    merged = used.groupBy(outcome, *terms).agg(F.sum("_weight").alias("_weight")).persist()
    # The iterations start from means that large weights push to 0 and 1, where they can run off. The
    # estimates depend on the weights' proportions only.
    heaviest = merged.agg(F.max("_weight")).first()[0] or 1.0
    merged_scaled = merged.withColumn("_weight", F.col("_weight") / F.lit(float(heaviest)))
    formula = RFormula(
        formula=f"{outcome} ~ {' + '.join(terms)}",
        featuresCol="features",
        labelCol="_label",
        stringIndexerOrderType="alphabetDesc",
        handleInvalid="error",
    )
    regression = GeneralizedLinearRegression(
        family="binomial",
        link="logit",
        featuresCol="features",
        labelCol="_label",
        weightCol="_weight",
        predictionCol="probability",
        linkPredictionCol="link",
        maxIter=max_iter,
    )
    try:
        model = Pipeline(stages=[formula, regression]).fit(merged_scaled)
    finally:
        merged.unpersist()
    converged = model.stages[-1].summary.numIterations < max_iter
    constant = [c for c in categorical if c not in factors]
    return LogisticModel(model, terms, merged.schema, {c: levels[c] for c in factors}, constant, converged)
