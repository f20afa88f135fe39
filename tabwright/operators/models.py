"""Principal components, baseline random forests and the measures of a prediction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.schema import (
    as_list, column, columns, is_numeric, numeric_columns, require, type_of,
)
from tabwright.operators.columns import drop_nulls
from tabwright.operators.encode import auto_clean
from tabwright.operators.profile import _gram
from tabwright.plans.storage import written

# The baseline's settings.
TREES = 100
SEED = 42
TEST_SHARE = 0.2


@dataclass(frozen=True)
class Components:
    """Fitted components: standardise by ``means`` and ``deviations``, then weight by ``loadings``."""

    names: list[str]
    means: list[float]
    deviations: list[float]
    loadings: list[list[float]]
    explained: list[float]

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Scores PCA1, PCA2, ... as plain column expressions; rows with a null are left out."""
        kept = _complete(df, [*self.names, *keep])
        scaled = [(column(n).cast("double") - F.lit(m)) / F.lit(d or 1.0)
                  for n, m, d in zip(self.names, self.means, self.deviations)]
        scores = [reduce(add, [z * F.lit(w) for z, w in zip(scaled, weights)]).alias(f"PCA{i}")
                  for i, weights in enumerate(self.loadings, 1)]
        return kept.select(*columns(keep), *scores)


def _complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return drop_nulls(df, list(dict.fromkeys(names)), nan_as_null=True)


def fit_pca(df: DataFrame, names: Sequence[str] | None = None, hue: str | None = None,
            k: int = 2) -> Components:
    """Components of the standardised columns (population deviation), fitted on all complete rows.

    A scan finds means and deviations; in a second one every task adds up the products of the standardised
    columns in one matrix, and the components are those of this matrix of numbers for pairs of columns.
    The sign is fixed: the first loading of the largest size is positive.
    """
    names = as_list(names) or numeric_columns(df)
    require(df, *names, *([hue] if hue else []))
    if len(names) < 2:
        raise ValueError(f"components need two numeric columns or more, got {len(names)}")
    complete = _complete(df, [*names, *([hue] if hue else [])])
    row = complete.agg(F.count(F.lit(1)).alias("n"), *[
        f(column(n).cast("double")).alias(f"{label}{i}") for i, n in enumerate(names)
        for label, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not row["n"]:
        raise ValueError("no row has a value in every column")
    means = [row[f"m{i}"] for i in range(len(names))]
    deviations = [row[f"s{i}"] for i in range(len(names))]
    scaled = [(column(n).cast("double") - F.lit(m)) / F.lit(d or 1.0)
              for n, m, d in zip(names, means, deviations)]
    if row["n"] < 2:
        raise ValueError("components need two complete rows or more")
    # the columns have mean 0, so the sums of products are the covariances
    weights, spread, _ = np.linalg.svd(_gram(complete, scaled, row["n"]) / (row["n"] - 1))
    with np.errstate(invalid="ignore"):
        explained = spread / spread.sum()
    k = min(k, len(names))
    loadings = []
    for component in weights.T[:k]:
        largest = max(abs(w) for w in component)
        lead = next(w for w in component if abs(w) > largest - 1e-9)
        loadings.append([float(w if lead > 0 else -w) for w in component])
    return Components(list(names), means, deviations, loadings,
                      [float(v) for v in explained[:k]])


def pca(df: DataFrame, names: Sequence[str] | None = None, hue: str | None = None,
        k: int = 2) -> DataFrame:
    """(PCA1, PCA2, hue) for every complete row."""
    return fit_pca(df, names, hue, k).apply(df, [hue] if hue else [])


def pca_summary(df: DataFrame, names: Sequence[str] | None = None, hue: str | None = None,
                k: int = 2) -> DataFrame:
    """(component, explained) shares of the variance."""
    fitted = fit_pca(df, names, hue, k)
    return df.sparkSession.createDataFrame(
        [(f"PCA{i}", v) for i, v in enumerate(fitted.explained, 1)],
        "component string, explained double")


def split_by_key(df: DataFrame, key: str | Sequence[str], test_share: float = TEST_SHARE,
                 seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the md5 of the key: the same rows on every run and layout."""
    keys = as_list(key)
    require(df, *keys)
    text = F.concat_ws(":", *[F.coalesce(column(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 1_000_000
    bound = int(round(test_share * 1_000_000))
    return df.where(draw >= bound), df.where(draw < bound)


def train_baseline(df: DataFrame, target: str, key: str | Sequence[str],
                   kind: str = "classification", trees: int = TREES, max_depth: int = 10,
                   test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Train a random forest on the cleaned table; test rows as (key, label, prediction).

    All columns but target and key are features, imputed and encoded by ``auto_clean``; those of other
    types than numbers, text and booleans are no features. Only rows without a target are left out.
    Spark trees have a depth limit (at most 30).
    """
    keys = as_list(key)
    require(df, target, *keys)
    if kind not in ("classification", "regression"):
        raise ValueError(f"unknown kind {kind!r}; use classification or regression")
    kept = list(dict.fromkeys([target, *keys]))
    cleaned = written(auto_clean(_complete(df, [target]), keep=kept), "cleaned")
    features = [n for n in numeric_columns(cleaned) if n not in kept]
    if not features:
        raise ValueError("no feature column")
    train, test = split_by_key(cleaned, keys, test_share, seed)
    # a column without any value stays null; it counts as 0 then
    assembler = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features")

    def assembled(part: DataFrame) -> DataFrame:
        return assembler.transform(part.select(
            *columns(keys), column(target).alias("label_value"),
            *[F.coalesce(column(n).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, n in enumerate(features)]))

    settings = dict(numTrees=trees, seed=seed, maxDepth=max_depth, featuresCol="features",
                    predictionCol="predicted")
    if kind == "regression":
        if not is_numeric(type_of(df, target)):
            raise ValueError("a regression target must be numeric")
        ready = assembled(train).withColumn("label_index", F.col("label_value").cast("double"))
        model = RandomForestRegressor(labelCol="label_index", **settings).fit(ready)
        return model.transform(assembled(test)).select(
            *columns(keys), F.col("label_value").cast("double").alias("label"),
            F.col("predicted").alias("prediction"))
    named = assembled(train).withColumn("label_text", F.col("label_value").cast("string"))
    indexer = StringIndexer(inputCol="label_text", outputCol="label_index",
                            stringOrderType="alphabetAsc").fit(named)
    model = RandomForestClassifier(labelCol="label_index", **settings).fit(indexer.transform(named))
    labels = F.array(*[F.lit(v) for v in indexer.labels])
    return model.transform(assembled(test)).select(
        *columns(keys), F.col("label_value").cast("string").alias("label"),
        F.get(labels, F.col("predicted").cast("int")).alias("prediction"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, with accuracy, macro and weighted rows.

    Rows are first counted per (label, prediction); all further steps work on
    those counts. A ratio without a denominator is 0.
    """
    require(df, label, prediction)
    a, p = column(label).cast("string"), column(prediction).cast("string")
    pairs = df.groupBy(a.alias("a"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("hits")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")))
    totals = pairs.select(F.inline(sides)).groupBy("class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    rated = totals.select(
        "class", "support", "hits", ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    rated = rated.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both))
    measures = ("precision", "recall", "f1")
    weight = F.sum("support")
    overall = rated.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), weight).alias(f"weighted_{m}")
          for m in measures],
        F.try_divide(F.sum("hits"), weight).alias("accuracy"), weight.alias("support"))
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit("accuracy").alias("class"), none.alias("precision"),
                     none.alias("recall"), F.col("accuracy").alias("f1"), F.col("support"))]
    for name in ("macro", "weighted"):
        rows.append(F.struct(F.lit(f"{name} avg").alias("class"),
                             *[F.col(f"{name}_{m}").alias(m) for m in measures], F.col("support")))
    return rated.select("class", *measures, "support").unionByName(
        overall.select(F.inline(F.array(*rows))))


def mse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean squared error over rows with both values."""
    require(df, label, prediction)
    error = column(label).cast("double") - column(prediction).cast("double")
    return df.agg(F.avg(error * error).alias("mse"))
