"""Multi-class models on numeric features, text and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizerModel, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BOOSTING, FEATURES, GRADES, MIN_QUERY_TEXT, MIN_TRAIN_TEXT, SPLIT_SEED
from ..functions.grades import label_grade
from ..functions.text import col, corpus_text
from ..sources.sinks import append_metrics
from ..staging import scratch_path, stage
from .boosting import BoostedTrees, fit_boosted
from .evaluation import classification_report, confusion_matrix, metrics
from .sampling import sample_rows, stratified_split


def feature_rows(df: DataFrame, columns: Sequence[str] = FEATURES, label: str | None = "nutriscore_label", keep: Sequence[str] = ()) -> DataFrame:
    """The present features as doubles in one vector, missing values as 0."""
    held = [c for c in columns if c in df.columns]
    doubles = df.select(
        *[col(k) for k in keep], *([col(label)] if label else []), *[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in held]
    )
    return VectorAssembler(inputCols=held, outputCol="features").transform(doubles).drop(*[c for c in held if c not in keep])


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1 per column; a constant column becomes 0."""
    one = df.agg(
        *[F.avg(col(c)).alias(f"m_{c}") for c in columns], *[F.stddev_pop(col(c)).alias(f"s_{c}") for c in columns]
    ).first()
    return df.withColumns(
        {
            c: (col(c) - F.lit(one[f"m_{c}"])) / F.lit(one[f"s_{c}"] or 1.0)
            for c in columns
        }
    )


def train_boosted(train: DataFrame, columns: Sequence[str] = FEATURES, label: str = "nutriscore_label", seed: int = SPLIT_SEED, bins_from: DataFrame | None = None, **settings) -> BoostedTrees:
    """Boosted trees, one a class and round, fitted on all rows of ``train``; the bins are those of ``bins_from``, if given."""
    s = {**BOOSTING, **settings}
    held = [c for c in columns if c in train.columns]
    share = float(s.pop("feature_subset"))
    return fit_boosted(train if bins_from is None else bins_from, train, held, label, feature_subset=share, seed=seed, **s)


def train_forest(train: DataFrame, columns: Sequence[str] = FEATURES, label: str = "nutriscore_label", seed: int = SPLIT_SEED, **settings) -> PipelineModel:
    """As many trees of the same depth in one multi-class forest: a few dozen jobs instead of thousands."""
    s = {**BOOSTING, **settings}
    held = [c for c in columns if c in train.columns]
    forest = RandomForestClassifier(
        numTrees=s["max_iter"], maxDepth=s["max_depth"], subsamplingRate=s["subsample"], featureSubsetStrategy=s["feature_subset"],
        seed=seed, labelCol=label, featuresCol="features", predictionCol="prediction",
    )
    stages = [
        VectorAssembler(inputCols=held, outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        forest,
    ]
    rows = train.select(*[F.coalesce(col(c).cast("double"), F.lit(0.0)).alias(c) for c in held], col(label).cast("double").alias(label))
    return Pipeline(stages=stages).fit(rows)


def model_columns(model: PipelineModel | BoostedTrees) -> list[str]:
    return model.columns if isinstance(model, BoostedTrees) else model.stages[0].getInputCols()


def score_boosted(model: PipelineModel | BoostedTrees, df: DataFrame, grade: str = "predicted_nutriscore") -> DataFrame:
    """Adds the predicted grade; features that are missing count as 0."""
    held = model_columns(model)
    names = {c: f"_feature_{c}" for c in held}
    values = {
        names[c]: F.coalesce(col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in held
    }
    if isinstance(model, BoostedTrees):
        return df.withColumn(grade, label_grade(model.predicted([F.coalesce(F.nanvl(v, F.lit(None)), F.lit(0.0)) for v in values.values()])))
    scored = df.withColumns(values)
    for s in model.stages:
        scored = s.transform(scored, {s.inputCols: list(names.values())}) if isinstance(s, VectorAssembler) else s.transform(scored)
    done = ("raw", "features", "prediction", "rawPrediction", "probability", *names.values())
    return scored.withColumn(grade, label_grade("prediction")).drop(*[c for c in done if c not in df.columns])


def feature_importance(model: PipelineModel | BoostedTrees) -> DataFrame:
    """Features by their share of the importance: mean gain of a boosted model, impurity of a forest."""
    from pyspark.sql import SparkSession

    shares = model.importance() if isinstance(model, BoostedTrees) else model.stages[-1].featureImportances.toArray()
    rows = [(c, float(v)) for c, v in zip(model_columns(model), shares)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def text_corpus(df: DataFrame, columns: Sequence[str] = ("product_name", "ingredients_text", "categories_en"), longer_than: int = MIN_TRAIN_TEXT, text: str = "text") -> DataFrame:
    """Adds the joined text of the present columns; rows with too short a text are dropped."""
    held = [c for c in columns if c in df.columns]
    return df.withColumn(text, corpus_text(held)).where(F.length(text) > longer_than)


def query_corpus(df: DataFrame, columns: Sequence[str] = ("product_name", "ingredients_text"), at_least: int = MIN_QUERY_TEXT, text: str = "text") -> DataFrame:
    """Texts to be scored: name and ingredients, of at least so many characters."""
    return text_corpus(df, columns, at_least - 1, text)


def hashed_text(text: str = "text", size: int = 4096) -> list:
    """Stages for weighted hashed words: an encoder that needs no model file.

    A word's bucket comes from its MD5, which every engine has.
    """
    bucket = f"transform(words, w -> cast(conv(substr(md5(w), 1, 8), 16, 10) % {size} AS string))"
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="buckets", outputCol="counts")
    return [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
        SQLTransformer(statement=f"SELECT *, {bucket} AS buckets FROM __THIS__"),
        counts,
        IDF(inputCol="counts", outputCol="features", minDocFreq=2),
    ]


def encode_text(df: DataFrame, load: Callable[[], Callable[[list[str]], Sequence]], text: str = "text", vector: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds an ``array<float>`` from a sentence encoder, loaded once per Python worker.

    ``load()`` returns a function from a list of texts to a list of vectors.
    """

    @F.pandas_udf("array<float>")
    def encoded(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in chunks:
            out: list = []
            values = texts.fillna("").tolist()
            for i in range(0, len(values), batch):
                out.extend(list(v) for v in encode(values[i : i + batch]))
            yield pd.Series(out, index=texts.index)

    return df.withColumn(vector, encoded(col(text)))


def embedding_rows(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(col(embedding).cast("array<double>")))


def train_logistic(train: DataFrame, label: str, stages: Sequence = (), max_iter: int = 1000, c: float = 1.0) -> PipelineModel:
    """Multinomial logistic regression; the penalty is that of an unaveraged loss with weight 1/c."""
    rows = train.count()
    model = LogisticRegression(
        labelCol=label, featuresCol="features", family="multinomial", maxIter=max_iter,
        regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False,
    )
    fitted = Pipeline(stages=[*stages, model]).fit(train.withColumn(label, col(label).cast("double")))
    # A freshly fitted two-class model holds its training summary, and with it the session and the
    # training rows, inside the functions sent to executors. The stored form is the model alone.
    path = scratch_path(train.sparkSession, "logistic")
    save_model(fitted, path)
    return PipelineModel.load(path)


def score_classes(model: PipelineModel, df: DataFrame, names: Sequence[str] = GRADES, digits: int = 3, predicted: str = "predicted") -> DataFrame:
    """Adds the predicted class name and the probability of every class, rounded."""
    scored = model.transform(df)
    known = F.array(*[F.lit(n) for n in names])
    chances = F.transform(vector_to_array("probability"), lambda p: F.round(p, digits))
    # Trailing classes that never occurred in training have no entry in the probability vector.
    seen = F.slice(known, 1, F.size(chances))
    return scored.withColumns(
        {
            predicted: F.element_at(known, F.col("prediction").cast("int") + 1),
            "probabilities": F.map_from_arrays(seen, chances),
        }
    ).drop("features", "rawPrediction", "probability", "prediction", "words", "buckets", "counts")


@dataclass(frozen=True)
class Trained:
    """A saved model, its test rows with predictions, and its figures on them."""

    model: PipelineModel
    scored: DataFrame
    report: DataFrame
    accuracy: float
    f1_score: float


def _finish(model, scored, actual, predicted, domain, name, path, metrics_path, **extra) -> Trained:
    matrix = stage(confusion_matrix(scored, actual, predicted, domain), "confusion").frame  # all rows are scored once
    report, figures = classification_report(matrix), metrics(matrix)
    spark = scored.sparkSession
    if metrics_path:
        append_metrics(spark, metrics_path, name, figures["accuracy"], figures["f1_score"], **extra)
    save_model(model, path)
    return Trained(model, scored, report, figures["accuracy"], figures["f1_score"])


def train_and_save(df: DataFrame, key: str, path: str, metrics_path: str | None = None, label: str = "nutriscore_label", grade: str = "nutriscore_grade", columns: Sequence[str] = FEATURES, fit_rows: int | None = None, train=train_boosted, **settings) -> Trained:
    """Split, fit on all training rows (or, where a caller asks for that, on ``fit_rows`` of them), score all test rows,
    record, save.

    The split rows are staged: they are the caller's scope to drop.
    """
    rows = stage(stratified_split(df, label, key), "labelled").frame
    learn = rows.where("NOT is_test")
    if fit_rows is not None and train is train_boosted:
        settings = {"bins_from": learn, **settings}
    model = train(_fitted(learn, fit_rows, key), columns, label, **settings)
    scored = score_boosted(model, rows.where("is_test"))
    n_samples = learn.count() if fit_rows is None else fit_rows
    return _finish(model, scored, grade, "predicted_nutriscore", GRADES, train.__name__, path, metrics_path, n_samples=n_samples)


def _fitted(learn: DataFrame, fit_rows: int | None, key: str) -> DataFrame:
    return learn if fit_rows is None else sample_rows(learn, fit_rows, key)


def train_text_and_save(df: DataFrame, key: str, path: str, metrics_path: str | None = None, label: str = "label", names: Sequence[str] = GRADES, encoder: Sequence | None = None, fit_rows: int | None = None, **settings) -> Trained:
    """The same for texts (column ``text``) or vectors (``features``, with ``encoder=[]``) and a logistic model.

    The label is the place of a class in ``names``.
    """
    rows = stage(stratified_split(df, label, key), "texts").frame
    encoder = hashed_text() if encoder is None else encoder
    learn = rows.where("NOT is_test")
    model = train_logistic(_fitted(learn, fit_rows, key), label, encoder, **settings)
    known = F.array(*[F.lit(n) for n in names])
    scored = score_classes(model, rows.where("is_test"), names).withColumn("actual", F.get(known, col(label).cast("int")))
    n_samples = learn.count() if fit_rows is None else fit_rows
    return _finish(model, scored, "actual", "predicted", names, "logistic", path, metrics_path, n_samples=n_samples, encoder="hashed words" if encoder else None)


def save_model(model: PipelineModel | BoostedTrees, path: str) -> None:
    if isinstance(model, BoostedTrees):
        from pyspark.sql import SparkSession

        model.nodes(SparkSession.getActiveSession()).coalesce(1).write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load_model(spark, path: str) -> PipelineModel | BoostedTrees:
    """A saved model of either kind."""
    from ..sources.files import exists

    if not exists(spark, path):
        raise FileNotFoundError(f"no model at {path}; train one first")
    if exists(spark, f"{path}/stages"):
        return PipelineModel.load(path)
    return BoostedTrees.from_nodes(spark.read.parquet(path))
