"""Document quality by hierarchical empirical Bayes.

A logistic regression on measures of the whole text, fitted to labelled documents, gives each
document a probability of being good. These are summed by path (host and language) and by host
(``source``); labelled documents count with their label. A beta prior, fitted by moments to the hosts,
shrinks host rates toward the global rate, another shrinks path rates toward their host's. A
document's final odds are its own odds times how far its path's rate, without the document itself, stands
above the global one; ``SITE_WEIGHT`` tempers that, so that a clean document on a poor site stays.

The fit uses at most ``FIT_ROWS`` labelled documents, those with the smallest hash of their id;
everything else covers all rows. A null text counts as empty; null hosts and languages are values of
their own. A document with several labels counts as good when most are. Repeated rows are scored each on
their own. Without labels of both kinds every document gets the global rate of what labels there are
(0.5 without any). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathgram.llm.common import small, whole
from pathgram.llm.rules import beta_prior, measure
from pathgram.session import materialise

FIT_ROWS = 50_000
SITE_WEIGHT = 0.5
KEEP = 0.5
FEATURES = ("log_words", "few_words", "symbols", "bars", "shouts", "capitals", "repeats", "line_repeats", "word_chars", "long_words")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang and the features of every row."""
    text = whole("text")
    pieces = lambda pattern: (F.size(F.split(text, pattern, -1)) - 1).cast("long")
    rows = docs.select("doc_id", "source", "lang", "text", pieces("[A-Z]").alias("n_capitals"), pieces("!").alias("n_shouts"), pieces(r"\|").alias("n_bars"))
    rows = measure(rows, "doc_id", "source", "lang", "n_capitals", "n_shouts", "n_bars")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c, cap=1.0: F.least(F.lit(cap), F.col(c) / n)
    mean = F.col("word_chars") / n
    return rows.select(
        "doc_id", "source", "lang",
        F.log1p(F.col("n_words").cast("double")).alias("log_words"), (F.col("n_words") < 20).cast("double").alias("few_words"),
        share("n_symbols").alias("symbols"), share("n_bars").alias("bars"), share("n_shouts").alias("shouts"),
        F.least(F.lit(1.0), F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capitals"),
        share("n_repeat_words").alias("repeats"), (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("line_repeats"),
        F.least(F.lit(20.0), mean).alias("word_chars"), F.greatest(F.lit(0.0), F.least(F.lit(20.0), mean) - 8).alias("long_words"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(rows)


def fit(labelled: DataFrame) -> LogisticRegressionModel | None:
    """A model of ``good`` (0 or 1) on the features; None unless both values occur."""
    if labelled.select("good").distinct().count() < 2:
        return None
    rows = _vectors(labelled.withColumn("label", F.col("good").cast("double")))
    scaler = StandardScaler(inputCol="__x", outputCol="__z").fit(rows)
    model = LogisticRegression(featuresCol="__z", regParam=1e-4, maxIter=60, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c").fit(scaler.transform(rows))
    model.scaler = scaler
    return model


def probabilities(rows: DataFrame, model: LogisticRegressionModel | None, otherwise: float) -> DataFrame:
    """``rows`` with ``p_document``."""
    if model is None:
        return rows.withColumn("p_document", F.lit(otherwise))
    scored = model.transform(model.scaler.transform(_vectors(rows)))
    return scored.withColumn("p_document", F.get(vector_to_array("__p"), F.lit(1))).drop("__x", "__z", "__p", "__r", "__c")


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, p_document, p_host, p_path, p_good, kept."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
    rows = materialise(features(docs).join(small(materialise(marks, "site-labels")), "doc_id", "left"), "site-features")
    known = rows.filter("good IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    known = materialise(known, "site-fit")
    share = known.agg(F.avg("good")).first()[0]
    rows = probabilities(rows, fit(known), 0.5 if share is None else float(share))

    own = F.coalesce(F.col("good").cast("double"), F.col("p_document"))
    rows = materialise(rows.select("doc_id", "source", "lang", "p_document", own.alias("own")), "site-scored")
    paths = rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("failed"))
    paths = materialise(paths, "site-paths")
    hosts = materialise(paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed")), "site-hosts")
    alpha, beta = beta_prior(hosts)
    overall, strength = alpha / (alpha + beta), sum(beta_prior(paths))

    hosts = hosts.select(F.col("source").alias("__s"), F.col("n").alias("host_n"), F.col("failed").alias("host_sum"))
    sites = paths.join(hosts, F.col("source").eqNullSafe(F.col("__s"))).select(
        F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("n").alias("path_n"), F.col("failed").alias("path_sum"), "host_n", "host_sum"
    )
    sites = small(materialise(sites, "site-sites"))
    rows = rows.join(sites, F.col("source").eqNullSafe(F.col("__source")) & F.col("lang").eqNullSafe(F.col("__lang")))
    host = (F.col("host_sum") - F.col("own") + alpha) / (F.col("host_n") - 1 + alpha + beta)
    rows = rows.withColumn("p_host", host)
    path = (F.col("path_sum") - F.col("own") + F.col("p_host") * strength) / (F.col("path_n") - 1 + strength)
    rows = rows.withColumn("p_path", path)
    odds = _logit(F.col("p_document")) + SITE_WEIGHT * (_logit(F.col("p_path")) - _logit(F.lit(overall)))
    good = 1 / (1 + F.exp(-odds))
    return rows.select("doc_id", "p_document", "p_host", "p_path", good.alias("p_good"), (good >= KEEP).alias("kept"))
