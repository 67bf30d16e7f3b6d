"""Classification of products from vectors: forests, networks, discriminants, neighbours, boosting."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, PCA, IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.draws import key_number
from larder.operators.metrics import class_weights, classification_metrics, cosine
from larder.operators.ordering import split_flag
from larder.operators.relational import bounded_rows, keep_first

MAX_CLASSES = 2000
#: Distances between two blocks that are held at a time.
DISTANCES = 1 << 20


def vectors(df: DataFrame, array: str = "embedding") -> DataFrame:
    """Float arrays as ML vectors in ``features``."""
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def _named(stages: list, model, label: str, train: DataFrame) -> PipelineModel:
    index = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip").fit(train)
    back = IndexToString(inputCol="prediction_index", outputCol="prediction", labels=index.labels)
    return Pipeline(stages=[index, *stages, model, back]).fit(train)


def fit_forest(train: DataFrame, label: str, trees: int = 200, depth: int = 20, min_leaf: int = 5, balanced: bool = True, seed: int = 42) -> PipelineModel:
    """Random forest, by default with balanced class weights."""
    if balanced:
        train = train.join(class_weights(train, label), label)
    rf = RandomForestClassifier(labelCol="label_index", predictionCol="prediction_index", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)
    return _named([], rf.setWeightCol("weight") if balanced else rf, label, train)


def fit_network(train: DataFrame, label: str, hidden: list[int], steps: int = 100, seed: int = 42) -> PipelineModel:
    """Feed-forward network; its input and output layers follow from the data."""
    size = train.select(F.size("embedding")).first()[0]
    classes = train.select(label).distinct().count()
    net = MultilayerPerceptronClassifier(labelCol="label_index", predictionCol="prediction_index", layers=[size, *hidden, classes], maxIter=steps, seed=seed)
    return _named([], net, label, train)


def fit_boosted(train: DataFrame, label: str, steps: int = 20, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Boosted trees, one model per class against the rest."""
    gbt = GBTClassifier(maxIter=steps, maxDepth=depth, seed=seed, minInstancesPerNode=5)
    return _named([], OneVsRest(classifier=gbt, labelCol="label_index", predictionCol="prediction_index"), label, train)


def predict(model: PipelineModel, df: DataFrame, prefix: str) -> DataFrame:
    """Adds ``<prefix>`` and ``<prefix>_prob``, the predicted class and its probability."""
    index, *inner, back = model.stages
    out = PipelineModel([*inner, back]).transform(df)
    prob = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(*df.columns, F.col("prediction").alias(prefix), prob.alias(f"{prefix}_prob"))


def top_class(scores: Column, names: list[str]) -> Column:
    """Name of the class with the highest score."""
    return F.get(F.array(*[F.lit(n) for n in names]), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


class Discriminant:
    """Linear discriminant analysis: class means and a pooled covariance from one pass of sums."""

    def __init__(self, names: list[str], weights: np.ndarray, offsets: np.ndarray):
        self.names, self.weights, self.offsets = names, weights, offsets

    @classmethod
    def fit(cls, train: DataFrame, label: str, array: str = "embedding") -> Discriminant:
        """One model over all rows."""
        return cls.fit_each(train, F.lit("all"), label, array)["all"]

    @classmethod
    def fit_each(cls, train: DataFrame, model: Column, label: str, array: str = "embedding") -> dict[str, Discriminant]:
        """A model for each value of ``model``, all from one pass over the rows.

        Tasks send sums of a few numbers per class and one matrix of products per model; the solves are d x d.
        """

        def sums(batches):
            by_class, squares = {}, {}
            for pdf in batches:
                x = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.empty((0, 0))
                for m, rows in pdf.groupby("m").indices.items():
                    squares[m] = squares.get(m, 0.0) + x[rows].T @ x[rows]
                for k, rows in pdf.groupby(["m", "k"]).indices.items():
                    n, s = by_class.get(k, (0, 0.0))
                    by_class[k] = (n + len(rows), s + x[rows].sum(0))
            if squares:
                rows = [(m, None, 0, v.ravel().tolist()) for m, v in squares.items()] + [(m, k, n, s.tolist()) for (m, k), (n, s) in by_class.items()]
                yield pd.DataFrame(rows, columns=["m", "k", "n", "v"])

        rows = train.select(model.cast("string").alias("m"), F.col(label).cast("string").alias("k"), F.col(array).cast("array<double>").alias("x"))
        parts = rows.where("m IS NOT NULL AND k IS NOT NULL AND x IS NOT NULL").mapInPandas(sums, "m string, k string, n long, v array<double>")
        total = parts.groupBy("m", "k").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
        by_model: dict[str, dict] = {}
        for r in bounded_rows(total, MAX_CLASSES, "the class table"):
            by_model.setdefault(r["m"], {})[r["k"]] = (r["n"], np.array(r["v"]))
        return {m: cls._solved(classes) for m, classes in sorted(by_model.items())}

    @classmethod
    def _solved(cls, classes: dict) -> Discriminant:
        """From (rows, sum) of each class and, under None, the sum of products of all rows."""
        square = classes.pop(None)[1]
        names = sorted(classes)
        n = np.array([classes[k][0] for k in names], float)
        means = np.array([classes[k][1] / classes[k][0] for k in names])
        d = means.shape[1]
        within = square.reshape(d, d) - (means * n[:, None]).T @ means
        cov = within / max(n.sum() - len(names), 1)
        weights = np.linalg.lstsq(cov, means.T, rcond=None)[0]
        offsets = -0.5 * np.einsum("kd,dk->k", means, weights) + np.log(n / n.sum())
        return cls(names, weights, offsets)

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best class of each row, and its probability."""
        z = x @ self.weights + self.offsets
        z = np.exp(z - z.max(1, keepdims=True))
        return z.argmax(1), z.max(1) / z.sum(1)

    def predict(self, df: DataFrame, prefix: str, array: str = "embedding") -> DataFrame:
        """Adds the predicted class and its probability; one matrix product per Arrow batch."""
        model = self

        @F.pandas_udf("struct<name:string,prob:double>")
        def score(x: pd.Series) -> pd.DataFrame:
            best, prob = model.scores(np.stack(x.to_numpy()).astype(float))
            return pd.DataFrame({"name": [model.names[i] for i in best], "prob": prob})

        out = df.withColumn("__s", score(F.col(array).cast("array<double>")))
        return out.select(*df.columns, F.col("__s.name").alias(prefix), F.col("__s.prob").alias(f"{prefix}_prob"))


def per_level(train: DataFrame, df: DataFrame, levels: list[str]) -> DataFrame:
    """One discriminant per level of the hierarchy, each on its own."""
    for level in levels:
        df = Discriminant.fit(train.where(F.col(level).isNotNull()), level).predict(df, f"{level}_pred")
    return df


class Levels:
    """A model of the top classes and one for each top class with several classes below; stored as one small table."""

    SCHEMA = "model string, class string, weights array<double>, offset double"

    def __init__(self, top: Discriminant, low: dict[str, Discriminant]):
        self.top, self.low = top, low

    @classmethod
    def fit(cls, train: DataFrame, top: str, low: str, leaves: list[str], array: str = "embedding") -> Levels:
        """Classes in ``leaves`` get no model below.  All lower models come from one pass."""
        few = Discriminant.fit_each(train.where(~F.col(top).isin(leaves)) if leaves else train, F.col(top), low, array)
        return cls(Discriminant.fit(train, top, array), {m: d for m, d in few.items() if len(d.names) > 1})

    def save(self, spark, path: str) -> None:
        """The top model has no name."""
        rows = [(m, c, d.weights[:, i].tolist(), float(d.offsets[i])) for m, d in [(None, self.top), *self.low.items()] for i, c in enumerate(d.names)]
        spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Levels:
        by_model: dict = {}
        for r in sorted(bounded_rows(spark.read.schema(cls.SCHEMA).parquet(path), MAX_CLASSES, "the stored models"), key=lambda r: r["class"]):
            by_model.setdefault(r["model"], []).append(r)
        read = {m: Discriminant([r["class"] for r in rows], np.array([r["weights"] for r in rows]).T, np.array([r["offset"] for r in rows])) for m, rows in by_model.items()}
        return cls(read.pop(None), read)

    def predict(self, df: DataFrame, top: str, low: str, array: str = "embedding") -> DataFrame:
        """Adds ``<top>_pred``, ``<low>_pred`` and their probabilities in one pass.

        Where the top class has no model below, its name is repeated without a probability.  Rows without a vector get no class.
        """
        upper, lower = self.top, self.low

        @F.pandas_udf("struct<top:string,top_prob:double,low:string,low_prob:double>")
        def score(x: pd.Series) -> pd.DataFrame:
            names, probs = np.full((2, len(x)), None, object), np.full((2, len(x)), np.nan)
            there = np.flatnonzero(x.notna().to_numpy())
            if len(there):
                v = np.stack(x.to_numpy()[there]).astype(float)
                best, probs[0, there] = upper.scores(v)
                names[0, there] = names[1, there] = np.array(upper.names, object)[best]
                for i in np.unique(best):
                    if (model := lower.get(upper.names[i])) is not None:
                        own = best == i
                        at, probs[1, there[own]] = model.scores(v[own])
                        names[1, there[own]] = np.array(model.names, object)[at]
            return pd.DataFrame({"top": names[0], "top_prob": probs[0], "low": names[1], "low_prob": probs[1]})

        out = df.withColumn("__s", score(F.col(array).cast("array<double>")))
        prob = lambda c: F.nanvl(F.col(f"__s.{c}"), F.lit(None).cast("double"))
        return out.select(
            *df.columns, F.col("__s.top").alias(f"{top}_pred"), prob("top_prob").alias(f"{top}_pred_prob"),
            F.col("__s.low").alias(f"{low}_pred"), prob("low_prob").alias(f"{low}_pred_prob"),
        )


def hierarchical(train: DataFrame, df: DataFrame, top: str, low: str, leaves: list[str]) -> DataFrame:
    """Two steps: the top class first, then the lower class by a model of that top class; see :class:`Levels`."""
    return Levels.fit(train, top, low, leaves).predict(df, top, low)


def centre_scores(train: DataFrame, df: DataFrame, label: str, array: str = "embedding") -> DataFrame:
    """Adds ``scores``, an array of (score, class) by class: the cosine of a row and the mean vector of each class."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(array).cast("array<double>"))))
    centres = bounded_rows(train.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(mean.alias("centre")), MAX_CLASSES, "the class centres")
    scored = [F.struct(cosine(F.col(array), F.lit(r["centre"])).alias("score"), F.lit(r["class"]).alias("class")) for r in sorted(centres, key=lambda r: r["class"])]
    return df.withColumn("scores", F.array(*scored))


def confidence(scores: Column) -> Column:
    """Share of the highest score among the exponentials of all scores."""
    top = F.array_max(scores)
    return 1 / F.aggregate(scores, F.lit(0.0), lambda total, s: total + F.exp(s - top))


def nearest(train: DataFrame, df: DataFrame, key: str, label: str, k: int = 5, array: str = "embedding", rows_per_block: int = 20000) -> DataFrame:
    """Exact k nearest neighbours: the majority label, the smaller label on ties.

    Both sides are dealt into blocks by hash; each pair of blocks is one bounded task that keeps its k best per
    row, and the best of all blocks are merged.  No side is collected or broadcast.
    """
    blocks = lambda d: max(1, -(-d.count() // rows_per_block))
    nt, nq = blocks(train), blocks(df)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    t = train.select(F.col(key).alias("t_key"), F.col(label).cast("string").alias("label"), F.col(array).alias("v"), place(key, nt).alias("tb"))
    t = t.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = df.select(F.col(key).alias("q_key"), F.col(array).alias("v"), place(key, nq).alias("qb"))
    q = q.withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q_key": [], "t_key": [], "label": [], "dist": []})
        right = right.sort_values("t_key")
        a, b = np.stack(left["v"]).astype(float), np.stack(right["v"]).astype(float)
        names, ids, asked = right["label"].to_numpy(), right["t_key"].to_numpy(), left["q_key"].to_numpy()
        square, out = (b * b).sum(1), []
        rows_at_once = max(1, min(256, DISTANCES // len(b)))
        for at in range(0, len(a), rows_at_once):  # a matrix of some rows by one block at a time, and a few copies of it
            part = a[at : at + rows_at_once]
            dist = np.maximum((part * part).sum(1)[:, None] + square - 2 * part @ b.T, 0).round(12)
            rows, cols = np.nonzero(dist <= np.partition(dist, min(k, len(b)) - 1, axis=1)[:, [min(k, len(b)) - 1]])
            order = np.lexsort((cols, dist[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k  # of ties at the last place, the smaller keys
            rows, cols = rows[first], cols[first]
            out.append(pd.DataFrame({"q_key": asked[at + rows], "t_key": ids[cols], "label": names[cols], "dist": dist[rows, cols]}))
        return pd.concat(out)

    found = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInPandas(best, "q_key long, t_key long, label string, dist double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("q_key").orderBy("dist", "t_key"))).where(F.col("r") <= k)
    votes = ranked.groupBy("q_key", "label").agg(F.count("*").alias("votes"))
    return keep_first(votes, ["q_key"], [F.desc("votes"), F.col("label")]).select(F.col("q_key").alias(key), F.col("label").alias("prediction"))


def bake_off(df: DataFrame, key: str, label: str, trees: int = 50) -> DataFrame:
    """Forest, discriminant, neighbours and boosted trees on the same split, with their test metrics."""
    flagged = df.withColumn("part", split_flag([key]))
    train, test = flagged.where("part = 'train'").drop("part"), flagged.where("part = 'test'").drop("part")
    said = {
        "RF": predict(fit_forest(train, label, trees, 8), test, "p"),
        "LDA": Discriminant.fit(train, label).predict(test, "p"),
        "KNN": nearest(train, test, key, label).withColumnRenamed("prediction", "p").join(test.select(key, label), key),
        "GBT": predict(fit_boosted(train, label, 5, 3), test, "p"),
    }
    return reduce(DataFrame.unionByName, [classification_metrics(p, label, "p").withColumn("model", F.lit(m)) for m, p in said.items()])


def grid_search(df: DataFrame, key: str, label: str, grid: list[dict]) -> DataFrame:
    """Validation metrics of forests over a parameter grid; ``best`` marks the highest Matthews' correlation."""
    flagged = df.withColumn("part", split_flag([key]))
    train, test = flagged.where("part = 'train'").drop("part"), flagged.where("part = 'test'").drop("part")
    results = []
    for i, params in enumerate(grid):
        m = classification_metrics(predict(fit_forest(train, label, **params), test, "p"), label, "p")
        results.append(m.withColumn("candidate", F.lit(i)).withColumn("params", F.lit(str(params))))
    table = reduce(DataFrame.unionByName, results)
    winner = table.agg(F.max_by("candidate", F.struct("mcc", -F.col("candidate")))).scalar()
    return table.withColumn("best", F.col("candidate") == winner)


def principal_components(df: DataFrame, share: float = 0.8, array: str = "embedding") -> tuple[DataFrame, int]:
    """Project on as many principal components as explain ``share`` of the variance."""
    v = vectors(df, array)
    size = v.select(F.size(array)).first()[0]
    model = PCA(k=size, inputCol="features", outputCol="pca").fit(v)
    k = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), share - 1e-12) + 1)
    return model.transform(v).withColumn("pca", F.slice(vector_to_array("pca"), 1, k)).drop("features"), k


def text_vectors(df: DataFrame, text: str, size: int = 1024) -> DataFrame:
    """Hashed term counts weighted by rarity; words end at white space, and a word's place is its digest modulo ``size``."""
    place = lambda w: (key_number(w) % size).cast("int")
    counted = df.withColumn("__places", F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s"), place))

    @F.pandas_udf("array<double>")
    def counts(places: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(p, minlength=size).astype(float) for p in places])

    counted = counted.withColumn("__tf", array_to_vector(counts("__places")))
    return IDF(inputCol="__tf", outputCol="features").fit(counted).transform(counted).drop("__places", "__tf")
