"""The rectangle classifier as an Estimator and Model of pyspark.ml: for pipelines, cross-validation, saving and loading."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import RectangleClassifier, TrainerConfig


class _RectangleParams(HasLabelCol, HasPredictionCol, HasSeed):
    featureCols = Param(Params._dummy(), "featureCols", "numeric columns", typeConverter=TypeConverters.toListString)
    voters = Param(Params._dummy(), "voters", "number of voters", typeConverter=TypeConverters.toInt)
    pairs = Param(Params._dummy(), "pairs", "axis pairs drawn for each rule", typeConverter=TypeConverters.toInt)
    coveredPairs = Param(Params._dummy(), "coveredPairs", "of these, the purest that are covered", typeConverter=TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(labelCol="label", predictionCol="prediction", seed=1, voters=7, pairs=25, coveredPairs=6)


class RectangleEstimator(Estimator, _RectangleParams, DefaultParamsReadable, DefaultParamsWritable):
    """Trains a RectangleClassifier on featureCols and labelCol; rows with a null label aren't used."""

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol="label", predictionCol="prediction", seed=1, voters=7, pairs=25, coveredPairs=6):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RectangleModel:
        config = TrainerConfig(pairs=self.getOrDefault("pairs"), covered_pairs=self.getOrDefault("coveredPairs"))
        fitted = RectangleClassifier(self.getOrDefault("voters"), self.getSeed(), config).fit(dataset, self.getOrDefault("featureCols"), self.getLabelCol())
        return self._copyValues(RectangleModel(fitted))


class RectangleModel(Model, _RectangleParams, MLReadable, MLWritable):
    """Adds predictionCol, the label that the voters give a row, to all its columns."""

    def __init__(self, classifier: RectangleClassifier | None = None):
        super().__init__()
        self.classifier = classifier

    def _transform(self, dataset: DataFrame) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in dataset.columns]).alias("__row")
        packed = dataset.select(row, *[F.col(f"`{f}`") for f in self.getOrDefault("featureCols")])
        out = self.classifier.transform(packed, "__row")
        return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in dataset.columns if c != self.getPredictionCol()], F.col("label_pred").alias(self.getPredictionCol()))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RectangleModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark.sparkContext)
        spark.createDataFrame([(self.model.classifier.to_json(),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> RectangleModel:
        spark = self.sparkSession
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        model = RectangleModel(RectangleClassifier.from_json(spark.read.text(f"{path}/data", wholetext=True).first()[0]))
        model._resetUid(meta["uid"])
        for group, put in (("defaultParamMap", model._setDefault), ("paramMap", model._set)):
            put(**meta[group])
        return model
