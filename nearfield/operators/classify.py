"""Classification by the labels of the neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.plans.model import MinHash, WtaHash


def votes(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, n): how many neighbours have each label; ``labels`` is (id, label)."""
    named = labels.where("label is not null").select(F.col("id").alias("neighbor_id"), "label")
    return neighbors.select("id", "neighbor_id").join(named, "neighbor_id").groupBy("id", "label").agg(F.count("*").alias("n"))


def majority(voted: DataFrame, ids: DataFrame, none=-1) -> DataFrame:
    """(id, label): the most frequent label, ties to the smallest; ``none`` without
    neighbours."""
    order = Window.partitionBy("id").orderBy(F.col("n").desc(), "label")
    best = voted.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "label")
    return ids.select("id").join(best, "id", "left").select("id", F.coalesce("label", F.lit(none).cast(dict(voted.dtypes)["label"])).alias("label"))


def probabilities(voted: DataFrame, ids: DataFrame, classes: list) -> DataFrame:
    """(id, and a column p_<class> for each class): shares of the votes, 0 without."""
    wide = voted.groupBy("id").agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"p_{c}") for c in classes], F.sum("n").alias("_all"))
    share = [F.coalesce(F.col(f"p_{c}") / F.col("_all"), F.lit(0.0)).alias(f"p_{c}") for c in classes]
    return ids.select("id").join(wide, "id", "left").select("id", *share)


def accuracy(predicted: DataFrame, truth: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: the (weighted) share of right predictions; ``truth`` is (id, label)."""
    w = F.col(weight) if weight else F.lit(1.0)
    named = truth.withColumnRenamed("label", "_true").withColumn("_w", w)
    return predicted.join(named, "id").agg((F.sum(F.col("_w") * (F.col("label") == F.col("_true")).cast("int")) / F.sum("_w")).alias("accuracy"))


class _Classifier:
    model_class: type

    def __init__(self, n_neighbors: int = 5, fast: bool = False, **options):
        self.model = self.model_class(n_neighbors=n_neighbors, fast=fast, **options)
        self.labels: DataFrame | None = None
        self.outputs: list[str] = []

    def fit(self, X: DataFrame, y: DataFrame):
        """``y`` is (id, label), or (id and several other columns): a column each for
        the outputs of a task, which predict and predict_proba then have by name."""
        self.model.fit(X)
        self.outputs = [c for c in y.columns if c != "id"]
        self.labels = y.select("id", *self.outputs)
        return self

    def partial_fit(self, X: DataFrame, y: DataFrame):
        if self.labels is None:
            return self.fit(X, y)
        self.model.partial_fit(X)
        self.labels = self.labels.unionByName(y.select("id", *self.outputs))
        return self

    def kneighbors(self, X: DataFrame | None = None, **options) -> DataFrame:
        return self.model.kneighbors(X, **options)

    def kneighbors_graph(self, X: DataFrame | None = None, **options) -> DataFrame:
        return self.model.kneighbors_graph(X, **options)

    def _voted(self, X, options) -> tuple[dict[str, DataFrame], DataFrame]:
        ids = (self.model.rows if X is None else X).select("id")
        found = self.model.kneighbors(X, **options)
        return {c: votes(found, self.labels.select("id", F.col(c).alias("label"))) for c in self.outputs}, ids

    def predict(self, X: DataFrame | None = None, **options) -> DataFrame:
        """(id, and a column for each output)."""
        voted, ids = self._voted(X, options)
        out = ids
        for c in self.outputs:
            one = majority(voted[c], ids).withColumnRenamed("label", c)
            out = one if len(self.outputs) == 1 else out.join(one, "id")
        return out

    def predict_proba(self, X: DataFrame | None = None, classes: list | dict | None = None, **options) -> DataFrame:
        """(id, p_<class> ...), with several outputs <output>_p_<class>; ``classes`` are
        those of the output, or of each by name."""
        voted, ids = self._voted(X, options)
        out = ids
        for c in self.outputs:
            named = classes.get(c) if isinstance(classes, dict) else classes
            if named is None:  # a row for each class
                named = sorted(r[c] for r in self.labels.where(F.col(c).isNotNull()).select(c).distinct().collect())
            one = probabilities(voted[c], ids, named)
            if len(self.outputs) == 1:
                return one
            out = out.join(one.select("id", *[F.col(x).alias(f"{c}_{x}") for x in one.columns[1:]]), "id")
        return out

    def score(self, X: DataFrame, y: DataFrame, sample_weight: str | None = None, **options) -> float:
        """The share of right predictions, all outputs of a row being right;
        ``sample_weight`` is a column of ``y``."""
        predicted = self.predict(X, **options)
        if len(self.outputs) > 1:
            whole = lambda d, *more: d.select("id", F.to_json(F.struct(*self.outputs), {"ignoreNullFields": "false"}).alias("label"), *more)
            predicted, y = whole(predicted), whole(y, *[sample_weight] * (sample_weight is not None))
        else:
            predicted, y = (d.withColumnRenamed(self.outputs[0], "label") for d in (predicted, y))
        return accuracy(predicted, y, sample_weight).first()["accuracy"]


class MinHashClassifier(_Classifier):
    model_class = MinHash


class WtaHashClassifier(_Classifier):
    model_class = WtaHash
