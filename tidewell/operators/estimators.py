"""Classifiers as Spark ML estimators, with parameters and persistence.

Label columns hold class numbers from 0, features are a vector column, and
predictions are class numbers, as with Spark's own classifiers; so these stand
in pipelines and tuners, and Spark's or a caller's stand in the library's
cross-validation. An estimator that is also a FoldEstimator fits all folds of a
cross-validation in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidewell.operators import boosting
from tidewell.operators.fits import Fits, Logistic, Table, fit_logistic

#: A model that is sent to the tasks with their code.
MODEL_MB = 256


class FoldEstimator:
    """Fits all folds of a table at once."""

    def fold_codes(self, table: Table, fits: Fits) -> Callable[[np.ndarray, int], np.ndarray]:
        """A function from values and the number of a fit to class numbers."""
        raise NotImplementedError


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    """The columns of a classifier."""


def _numbered(data: DataFrame, features: str, label: str) -> Table:
    """A table of all rows with labels as whole numbers; a row's id is a hash of what it holds."""
    rows = data.select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"))
    return Table(rows.withColumn("pid", F.xxhash64(vector_to_array("x"), "y")), "x", "y")


class _ArrayModel(_Columns, Model, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose numbers are parameters, so that they are saved with it."""

    classes = Param(Params._dummy(), "classes", "class numbers", TypeConverters.toListInt)
    arrays = Param(Params._dummy(), "arrays", "names, shapes and values of the model's arrays", TypeConverters.identity)

    def __init__(self):
        super().__init__()
        self._setDefault(classes=[], arrays={})

    @classmethod
    def of(cls, estimator: _Columns, classes: list[int], **arrays: np.ndarray) -> _ArrayModel:
        made = cls()
        for p in ("featuresCol", "labelCol", "predictionCol", "probabilityCol"):
            made._set(**{p: estimator.getOrDefault(p)})
        # infinite cuts aren't JSON numbers
        made._set(classes=classes, arrays={k: {"shape": list(v.shape), "kind": str(v.dtype), "values": [x if np.isfinite(x) else None for x in v.ravel().tolist()]} for k, v in arrays.items()})
        return made

    def array(self, name: str) -> np.ndarray:
        own = self.getOrDefault(self.arrays)[name]
        return np.array([np.inf if x is None else x for x in own["values"]], own["kind"]).reshape(own["shape"])

    def probabilities_of(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from values to the probabilities of the classes."""
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """dataset with prediction (class number, as a double) and probability (array of the classes' probabilities)."""
        given, names = self.getOrDefault("featuresCol"), (self.getOrDefault("predictionCol"), self.getOrDefault("probabilityCol"))
        score, classes = self.probabilities_of(), np.array(self.getOrDefault(self.classes), float)
        if (size := sum(len(v["values"]) for v in self.getOrDefault(self.arrays).values()) * 8 / 1e6) > MODEL_MB:
            raise ValueError(f"a model of {size:.0f} MB; at most {MODEL_MB} MB are sent to the tasks")
        base = dataset.drop(*names)
        schema = StructType([*base.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], ArrayType(DoubleType()))])
        width = len(base.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(width).flatten().to_numpy(zero_copy_only=False)
                p = score(values.reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, len(classes)))
                made = [pa.array(classes[p.argmax(axis=1)] if len(p) else [], pa.float64()), pa.array(list(p), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], schema.names)

        return base.withColumn("_tw_values", vector_to_array(given)).mapInArrow(run, schema)


class BalancedLogistic(_Columns, Estimator, FoldEstimator, DefaultParamsReadable, DefaultParamsWritable):
    """L2 logistic regression with balanced class weights on standardised columns."""

    c = Param(Params._dummy(), "c", "inverse of the penalty", TypeConverters.toFloat)
    tolerance = Param(Params._dummy(), "tolerance", "how far a coefficient may be off", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", c=1.0, tolerance=1e-7):
        super().__init__()
        self._setDefault(c=1.0, tolerance=1e-7)
        self._set(**self._input_kwargs)

    def fold_codes(self, table: Table, fits: Fits) -> Callable[[np.ndarray, int], np.ndarray]:
        return fit_logistic(table, fits, self.getOrDefault(self.c), self.getOrDefault(self.tolerance)).codes

    def _fit(self, dataset: DataFrame) -> BalancedLogisticModel:
        table = _numbered(dataset, self.getOrDefault("featuresCol"), self.getOrDefault("labelCol"))
        made = fit_logistic(table, None, self.getOrDefault(self.c), self.getOrDefault(self.tolerance))
        table.discard()
        return BalancedLogisticModel.of(self, table.classes[0], weights=made.weights, intercepts=made.intercepts, present=made.present)


class BalancedLogisticModel(_ArrayModel):
    def probabilities_of(self) -> Callable[[np.ndarray], np.ndarray]:
        made = Logistic(self.array("weights"), self.array("intercepts"), self.array("present"))
        return lambda x: made.probabilities(x, 0)


class BoostedTrees(_Columns, Estimator, FoldEstimator, DefaultParamsReadable, DefaultParamsWritable):
    """Second-order boosted trees on the softmax, for any number of rows and classes."""

    rounds = Param(Params._dummy(), "rounds", "trees for each class", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "cuts on a path", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "shrinkage of the leaves", TypeConverters.toFloat)
    share = Param(Params._dummy(), "share", "part of rows and columns in a round", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a column", TypeConverters.toInt)
    ridge = Param(Params._dummy(), "ridge", "added to a leaf's second derivatives", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the rounds' samples", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", rounds=200, depth=4, rate=0.05, share=0.8, bins=32, ridge=1.0, seed=42):
        super().__init__()
        self._setDefault(rounds=200, depth=4, rate=0.05, share=0.8, bins=32, ridge=1.0, seed=42)
        self._set(**self._input_kwargs)

    def boosted(self, table: Table, fits: Fits | None = None) -> boosting.Boosted:
        own = {p: self.getOrDefault(p) for p in ("rounds", "depth", "rate", "share", "ridge", "seed")}
        return boosting.fit_boosted(table, boosting.column_cuts(table, self.getOrDefault(self.bins)), fits, **own)

    def fold_codes(self, table: Table, fits: Fits) -> Callable[[np.ndarray, int], np.ndarray]:
        return self.boosted(table, fits).codes

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        table = _numbered(dataset, self.getOrDefault("featuresCol"), self.getOrDefault("labelCol"))
        made = self.boosted(table)
        table.discard()
        return BoostedTreesModel.of(self, table.classes[0], columns=made.columns, cuts=made.cuts, values=made.values, cover=made.cover, present=made.present)


class BoostedTreesModel(_ArrayModel):
    @property
    def boosted(self) -> boosting.Boosted:
        return boosting.Boosted(*[self.array(k) for k in ("columns", "cuts", "values", "cover", "present")])

    def probabilities_of(self) -> Callable[[np.ndarray], np.ndarray]:
        made = self.boosted
        return lambda x: made.probabilities(x, 0)

    def attributions(self, rows: DataFrame, columns: list[str], key: str = "pid") -> DataFrame:
        """(key, class, feature, base, value) along the trees' paths; columns in the order of the features."""
        return boosting.tree_attributions(self.boosted, self.getOrDefault(self.classes), rows, columns, key=key)
