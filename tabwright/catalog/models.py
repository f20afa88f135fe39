"""Principal components, random forests, measures of a prediction."""

from functools import reduce
from operator import add, and_

from pyspark.sql import Window
from pyspark.sql import functions as F

import tabwright as tw
from tabwright.catalog.profiling import NUMERIC
from tabwright.catalog.registry import Registry, rounded
from tabwright.plans import storage

QUERIES = Registry()

# With two columns the components are known: equal weights, and the sign of the correlation.
_PAIR = """fit AS (
      SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb,
             stddev_pop(l_extendedprice) AS sb, corr(l_quantity, l_extendedprice) AS r
      FROM lineitem)"""


@QUERIES.add("m1_pca", f"""
    WITH {_PAIR}, z AS (
      SELECT (l_quantity - ma) / sa AS a, sign(r) * (l_extendedprice - mb) / sb AS b, l_linestatus
      FROM lineitem, fit)
    SELECT l_linestatus, round((a + b) / sqrt(2), 5) AS "PCA1", round((a - b) / sqrt(2), 5) AS "PCA2"
    FROM z""")
def pca(t):
    result = tw.pca(t.lineitem, ["l_quantity", "l_extendedprice"], "l_linestatus")
    # adding zero turns a rounded -0.0 into 0.0
    return rounded(result, PCA1=5, PCA2=5).withColumns(
        {c: F.col(c) + F.lit(0.0) for c in ("PCA1", "PCA2")})


@QUERIES.add("m1_pca_summary", f"""
    WITH {_PAIR}
    SELECT 'PCA1' AS component, round((1 + abs(r)) / 2, 6) AS explained FROM fit
    UNION ALL SELECT 'PCA2', round((1 - abs(r)) / 2, 6) FROM fit""")
def pca_summary(t):
    return rounded(tw.pca_summary(t.lineitem, ["l_quantity", "l_extendedprice"]), explained=6)


@QUERIES.add("m1_pca_many", """
    SELECT count(*) AS n, 8.0::DOUBLE AS total_variance, TRUE AS uncorrelated, TRUE AS falling FROM lineitem
    WHERE COLUMNS(*) IS NOT NULL""")
def pca_many(t):
    """All components of all numeric columns: they keep the whole variance, uncorrelated and in falling order."""
    scores = tw.pca(t.lineitem, NUMERIC[:-1], k=8)
    names = [f"PCA{i}" for i in range(1, 9)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    # plain sums: 36 aggregates of moments are too much code for one compiled loop; the scores have mean 0
    sums = scores.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names], *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs])
    cov = {(a, b): F.col(a + b) / F.col("n") - F.col(a) / F.col("n") * F.col(b) / F.col("n") for a, b in pairs}
    var = [cov[n, n] for n in names]
    uncorrelated = [F.abs(F.try_divide(cov[a, b], F.sqrt(cov[a, a] * cov[b, b]))) < 1e-6 for a, b in pairs if a != b]
    falling = [x >= y - 1e-9 for x, y in zip(var, var[1:])]
    return sums.select("n", F.round(reduce(add, var), 6).alias("total_variance"),
                       reduce(and_, uncorrelated).alias("uncorrelated"), reduce(and_, falling).alias("falling"))


_TEST = """('0x' || substr(md5(CAST({} AS VARCHAR) || ':42'), 1, 8))::UBIGINT % 1000000 < 200000"""


@QUERIES.add("m2_train_classifier", f"""
    SELECT conv_id, role AS label, CAST(count(*) OVER (PARTITION BY role) AS BIGINT) AS support, TRUE AS beats_constant
    FROM conversations WHERE role IS NOT NULL AND {_TEST.format("conv_id")}""")
def train_classifier(t):
    """The test rows, and whether the forest is right more often on average over the classes than a constant."""
    predicted = storage.written(tw.train_baseline(
        t.conversations, "role", "conv_id", "classification"), "predicted")
    recall = predicted.groupBy("label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("r"))
    row = recall.agg(F.avg("r"), F.count("*")).first()
    support = F.count("*").over(Window.partitionBy("label"))
    return predicted.select("conv_id", "label", support.alias("support"), F.lit(row[0] > 1 / row[1]).alias("beats_constant"))


@QUERIES.add("m2_train_documents", f"""
    SELECT doc_id, CAST(quality AS VARCHAR) AS label, CAST(count(*) OVER (PARTITION BY quality) AS BIGINT) AS support, TRUE AS beats_constant
    FROM labels JOIN documents USING (doc_id) WHERE {_TEST.format("doc_id")}""")
def train_documents(t):
    """The labels of documents from the whole documents and measures of their texts."""
    words = F.size(F.split("text", r"\s+"))
    measured = t.documents.withColumns({
        "n_words": words, "n_distinct": F.size(F.array_distinct(F.split("text", r"\s+"))),
        "n_lines": F.size(F.split("text", "\n")), "n_distinct_lines": F.size(F.array_distinct(F.split("text", "\n"))),
        "symbols": F.length(F.regexp_replace("text", r"[\p{L}\s]", "")) / F.greatest(F.length("text"), F.lit(1)),
    })
    labelled = t.labels.select("doc_id", "quality").join(measured, "doc_id")
    predicted = storage.written(tw.train_baseline(labelled, "quality", "doc_id", "classification"), "predicted")
    recall = predicted.groupBy("label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("r"))
    row = recall.agg(F.avg("r"), F.count("*")).first()
    support = F.count("*").over(Window.partitionBy("label"))
    return predicted.select("doc_id", "label", support.alias("support"), F.lit(row[0] > 1 / row[1]).alias("beats_constant"))


@QUERIES.add("m2_train_regressor", f"""
    SELECT p_name, round(CAST(p_retailprice AS DOUBLE), 4) AS label, TRUE AS beats_constant
    FROM part WHERE {_TEST.format("p_name")}""")
def train_regressor(t):
    """The test rows, and whether the forest's error is below the variance of the labels."""
    predicted = storage.written(tw.train_baseline(t.part, "p_retailprice", "p_name", "regression"), "predicted")
    error = tw.mse(predicted, "label", "prediction").first()[0]
    spread = predicted.agg(F.var_pop("label")).first()[0]
    return rounded(predicted, label=4).select("p_name", "label", F.lit(error < spread).alias("beats_constant"))


def _predicted(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn(
        "guess", F.when(F.col("n_chars") > 300, 1).otherwise(0))


_PREDICTED = """predicted AS (
      SELECT quality, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS guess
      FROM labels JOIN documents USING (doc_id))"""


@QUERIES.add("m3_report", f"""
    WITH {_PREDICTED}, classes AS (
      SELECT CAST(quality AS VARCHAR) AS class FROM predicted
      UNION SELECT CAST(guess AS VARCHAR) FROM predicted),
    counts AS (
      SELECT class, count(*) FILTER (CAST(quality AS VARCHAR) = class) AS support,
             count(*) FILTER (CAST(guess AS VARCHAR) = class) AS chosen,
             count(*) FILTER (CAST(quality AS VARCHAR) = class AND quality = guess) AS hits
      FROM classes, predicted GROUP BY class),
    rated AS (SELECT *, coalesce(hits / NULLIF(CAST(chosen AS DOUBLE), 0), 0) AS p,
                     coalesce(hits / NULLIF(CAST(support AS DOUBLE), 0), 0) AS r FROM counts),
    scored AS (SELECT *, coalesce(2 * p * r / NULLIF(p + r, 0), 0) AS f FROM rated)
    SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support
    FROM scored
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / CAST(sum(support) AS DOUBLE), 6),
                     CAST(sum(support) AS BIGINT) FROM scored
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
                     CAST(sum(support) AS BIGINT) FROM scored
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
                     round(sum(r * support) / sum(support), 6),
                     round(sum(f * support) / sum(support), 6),
                     CAST(sum(support) AS BIGINT) FROM scored""")
def report(t):
    result = tw.classification_report(_predicted(t), "quality", "guess")
    return rounded(result, precision=6, recall=6, f1=6)


@QUERIES.add("m4_mse", f"""
    WITH {_PREDICTED} SELECT round(avg(pow(quality - guess, 2)), 8) AS mse FROM predicted""")
def mse(t):
    return rounded(tw.mse(_predicted(t), "quality", "guess"), mse=8)


@QUERIES.add("m3_report_of_model", f"""
    WITH test AS (SELECT CAST(role AS VARCHAR) AS class FROM conversations WHERE role IS NOT NULL AND {_TEST.format("conv_id")})
    SELECT class, count(*) AS support, TRUE AS agrees FROM test GROUP BY class
    UNION ALL SELECT total, count(*), TRUE FROM test, (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) AS t(total) GROUP BY total""")
def report_of_model(t):
    """The report on a trained forest's own predictions, and whether it agrees with plain counts of hits."""
    predicted = storage.written(tw.train_baseline(t.conversations, "role", "conv_id", "classification"), "predicted")
    hit = (F.col("label") == F.col("prediction")).cast("bigint")
    own = predicted.groupBy(F.col("label").alias("class")).agg(F.sum(hit).alias("hits"), F.count("*").alias("n"))
    chosen = predicted.groupBy(F.col("prediction").alias("class")).agg(F.count("*").alias("chosen"))
    plain = own.join(chosen, "class", "left").select(
        "class", F.coalesce(F.col("hits") / F.col("chosen"), F.lit(0.0)).alias("p"), (F.col("hits") / F.col("n")).alias("r"), "n")
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    totals = plain.withColumn("f", f1).agg(
        F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f").alias("f"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("wp"), (F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("wr"),
        (F.sum(F.col("f") * F.col("n")) / F.sum("n")).alias("wf")).first()
    accuracy = predicted.agg(F.avg(hit.cast("double"))).first()[0]
    rows = [("accuracy", None, None, accuracy), ("macro avg", totals["p"], totals["r"], totals["f"]),
            ("weighted avg", totals["wp"], totals["wr"], totals["wf"])]
    expected = plain.select("class", "p", "r", f1.alias("f")).union(
        t.spark.createDataFrame(rows, "class string, p double, r double, f double"))
    report = tw.classification_report(predicted, "label", "prediction").join(expected, "class")

    def close(a, b):
        return F.coalesce(F.abs(F.col(a) - F.col(b)) < 1e-9, F.col(a).isNull() & F.col(b).isNull())

    return report.select("class", "support", (close("precision", "p") & close("recall", "r") & close("f1", "f")).alias("agrees"))


@QUERIES.add("m4_mse_of_model", f"""
    SELECT count(*) AS n, TRUE AS agrees, TRUE AS beats_mean FROM part WHERE {_TEST.format("p_name")}""")
def mse_of_model(t):
    """The error of a trained forest, whether it agrees with a plain mean, and whether it is below the labels' variance."""
    predicted = storage.written(tw.train_baseline(t.part, "p_retailprice", "p_name", "regression"), "predicted")
    error = tw.mse(predicted, "label", "prediction").first()[0]
    plain = F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2)))
    return predicted.agg(F.count("*").alias("n"), (F.abs(plain - error) < 1e-6 * plain).alias("agrees"),
                         (F.var_pop("label") > error).alias("beats_mean"))
