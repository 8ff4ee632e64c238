"""Marker discovery and classification of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.linear import two_group_statistics
from quillon.operators.robust import back


def otsu(cells: DataFrame, max_bins: int = 100) -> DataFrame:
    """feature_id, threshold: the cut of maximal between-class variance of each feature's histogram; the median below ten values."""
    s = cells.filter("value is not null").groupBy("feature_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.median("value").alias("med"))
    s = s.withColumn("bins", F.least(F.lit(max_bins), F.floor(F.col("n") / 5)).cast("int"))
    j = back(cells.filter("value is not null"), s, ["feature_id"]).filter("n >= 10 and hi > lo")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    bin_ = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.col("bins") - 1).cast("int")
    h = j.withColumn("bin", bin_).groupBy("feature_id", "bin").agg(F.count("*").alias("c"))
    grid = s.filter("n >= 10 and hi > lo").withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    g = grid.join(h, ["feature_id", "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width)
    before = Window.partitionBy("feature_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("feature_id")
    g = g.withColumn("w0", F.sum("c").over(before)).withColumn("m0", F.sum(F.col("c") * F.col("centre")).over(before)).withColumn("mt", F.sum(F.col("c") * F.col("centre")).over(every))
    p = F.col("w0") / F.col("n")
    gap = F.try_divide(F.col("m0"), F.col("w0")) - F.try_divide(F.col("mt") - F.col("m0"), F.col("n") - F.col("w0"))
    g = g.withColumn("v", F.when((F.col("w0") > 0) & (F.col("w0") < F.col("n")), F.round(p * (1 - p) * gap * gap, 12)))
    best = g.filter("v is not null").groupBy("feature_id").agg(F.max_by("centre", F.struct("v", -F.col("bin"))).alias("cut"))
    return back(s, best, ["feature_id"]).select("feature_id", F.coalesce("cut", "med").alias("threshold"))


def marker_scores(cells: DataFrame, labels: DataFrame, min_effect: float = 0.5) -> DataFrame:
    """feature_id, d_labeled, balance, consistency, score, threshold of features that separate the labels (sample_id, label 0/1).

    score = d * consistency * (0.5 + 0.5 * balance), with the Otsu split over all samples."""
    lab = cells.join(labels, "sample_id")
    d = two_group_statistics(lab, "label", 1, 0).select("feature_id", F.col("cohens_d").alias("d_labeled")).filter(F.col("d_labeled") >= min_effect)
    t = otsu(cells)
    j = back(back(cells.join(labels, "sample_id", "left"), t, ["feature_id"]), d, ["feature_id"]).filter("d_labeled is not null and value is not null")
    high = F.col("value") > F.col("threshold")
    g = j.groupBy("feature_id", "d_labeled", "threshold").agg(F.count_if(high).alias("n1"), F.count_if(~high).alias("n0"), F.avg((high.cast("int") == F.col("label")).cast("double")).alias("agree"))
    balance = F.coalesce(F.try_divide(F.least("n0", "n1"), F.greatest("n0", "n1")), F.lit(0.0))
    consistency = F.greatest(F.col("agree"), 1 - F.col("agree"))
    return g.select("feature_id", "d_labeled", balance.alias("balance"), consistency.alias("consistency"), (F.col("d_labeled") * consistency * (0.5 + 0.5 * balance)).alias("score"), "threshold", F.when(F.col("agree") >= 0.5, 1).otherwise(0).alias("high_label"))


def predict_by_marker(cells: DataFrame, scores: DataFrame) -> DataFrame:
    """sample_id, predicted, confidence from the best marker: side of its threshold, logistic in distance over spread."""
    best = scores.orderBy(F.col("score").desc(), "feature_id").limit(1)
    j = cells.join(best, "feature_id")
    sd = j.agg(F.stddev_samp("value").alias("_sd"))
    p = 1 / (1 + F.exp(-4 * (F.col("value") - F.col("threshold")) / F.nullif(F.col("_sd"), F.lit(0.0))))
    label = F.when(F.col("value") > F.col("threshold"), F.col("high_label")).otherwise(1 - F.col("high_label"))
    return back(j, sd, []).select("sample_id", label.alias("predicted"), F.greatest(p, 1 - p).alias("confidence"))


def welch_top(cells: DataFrame, labels: DataFrame, n: int = 50) -> DataFrame:
    """The n features of largest |Welch t| between labels 0 and 1."""
    w = two_group_statistics(cells.join(labels, "sample_id"), "label", 1, 0)
    return w.orderBy(F.abs("welch_t").desc_nulls_last(), "feature_id").limit(n)


def sample_vectors(cells: DataFrame, features: list[str]) -> DataFrame:
    """sample_id, features (vector): a bounded pivot; missing values become the feature's mean."""
    from pyspark.ml.feature import Imputer, VectorAssembler

    wide = cells.groupBy("sample_id").pivot("feature_id", features).agg(F.first("value"))
    safe = {f: f"f{i}" for i, f in enumerate(features)}
    wide = wide.select("sample_id", *(F.col(f"`{f}`").alias(s) for f, s in safe.items()))
    cols = list(safe.values())
    wide = Imputer(inputCols=cols, outputCols=cols).fit(wide).transform(wide)
    return VectorAssembler(inputCols=cols, outputCol="features").transform(wide).select("sample_id", "features")


class Ensemble:
    """Mean probability of a random forest, gradient-boosted trees and a logistic regression on the top features."""

    def __init__(self, n_features: int = 30, seed: int = 0, trees: int = 30):
        self.n_features, self.seed, self.trees = n_features, seed, trees

    def fit(self, cells: DataFrame, labels: DataFrame) -> Ensemble:
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
        from pyspark.ml.feature import StandardScaler

        self.features = [r["feature_id"] for r in welch_top(cells, labels, self.n_features).collect()]  # bounded
        x = sample_vectors(cells, self.features).join(labels.select("sample_id", F.col("label").cast("double")), "sample_id").cache()
        scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
        self.models = [
            RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=self.trees, seed=self.seed).fit(x),
            GBTClassifier(featuresCol="features", labelCol="label", maxIter=10, maxDepth=3, seed=self.seed).fit(x),
            Pipeline(stages=[scale, LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.1)]).fit(x),
        ]
        x.unpersist()
        return self

    def predict(self, cells: DataFrame) -> DataFrame:
        """sample_id, probability of label 1, predicted, confidence = 2 |p - 0.5|."""
        from functools import reduce

        from pyspark.ml.functions import vector_to_array

        x = sample_vectors(cells, self.features)
        each = [m.transform(x).select("sample_id", vector_to_array("probability")[1].alias("p")) for m in self.models]
        p = reduce(DataFrame.unionByName, each).groupBy("sample_id").agg(F.avg("p").alias("probability"))
        return p.select("sample_id", "probability", (F.col("probability") >= 0.5).cast("int").alias("predicted"), (2 * F.abs(F.col("probability") - 0.5)).alias("confidence"))


def classify_samples(cells: DataFrame, samples: DataFrame, label: str, classes: tuple[str, str], overwrite: bool = False) -> DataFrame:
    """sample_id, label, confidence, source: known labels stay with confidence 1; at least 50 known train an ensemble,
    at least 10 a marker, fewer leave 'U'."""
    known = samples.filter(F.col(label).isin(*classes)).select("sample_id", (F.col(label) == classes[1]).cast("int").alias("label"))
    n = known.count()
    if n >= 50:
        p, source = Ensemble().fit(cells, known).predict(cells).select("sample_id", "predicted", "confidence"), "ensemble"
    elif n >= 10:
        p, source = predict_by_marker(cells, marker_scores(cells, known)), "marker"
    else:
        p, source = None, "none"
    s = samples.select("sample_id", F.col(label).alias("_known")).withColumn("_is", F.coalesce(F.col("_known").isin(*classes), F.lit(False)))
    if p is None:
        return s.select("sample_id", F.when(F.col("_is"), F.col("_known")).otherwise("U").alias(label), F.when(F.col("_is"), 1.0).otherwise(0.0).alias("confidence"), F.when(F.col("_is"), "known").otherwise("none").alias("source"))
    j = s.join(p, "sample_id", "left")
    guess = F.when(F.col("predicted") == 1, classes[1]).when(F.col("predicted") == 0, classes[0]).otherwise("U")
    keep = F.col("_is") & F.lit(not overwrite)
    return j.select("sample_id", F.when(keep, F.col("_known")).otherwise(guess).alias(label), F.when(keep, 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.when(keep, "known").otherwise(source).alias("source"))
