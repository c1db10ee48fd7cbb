"""Quality classifier: hashed word n-gram logistic regression, FTRL updates, scores as sparse dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinetrail.llm import linear
from kinetrail.llm.labelled import sample


class QualityClassifier:
    """fit() learns from at most max_rows labelled documents; score() adds ``quality_score`` and keep() filters by it.

    Inputs of a score are the text's token n-grams only. A null text is empty; an empty text scores by the bias. Rows are scored one by
    one, so repeated rows agree and ties do not matter; extra columns are ignored by score() and kept by keep(). An empty table gives an
    empty result. Without any usable label every score is 0.5 and everything stays. A document as large as memory for a few copies of it is fine.
    """

    def __init__(self, max_rows: int = 6000, held_out: int | None = 1, features: linear.Features | None = None, threshold: float = 0.5):
        self.max_rows, self.held_out, self.threshold = max_rows, held_out, threshold
        self.features = features or linear.Features()
        self.model: linear.Model | None = None

    def fit(self, docs: DataFrame, labels: DataFrame) -> QualityClassifier:
        data = linear.rows(docs, sample(labels, "quality", self.max_rows, self.held_out), self.features)
        self.model = linear.train(data, self.features)
        return self

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, quality_score"""
        model = linear.spread(docs.sparkSession, self.model)

        def run(batches):
            for b in batches:
                p = np.round(model.value.probability(b.column("text")), 9)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "quality_score"])

        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return docs.mapInArrow(run, "doc_id long, quality_score double")

    def keep(self, docs: DataFrame) -> DataFrame:
        model, threshold = linear.spread(docs.sparkSession, self.model), self.threshold

        def run(batches):
            for b in batches:
                yield b.filter(pa.array(np.round(model.value.probability(b.column("text")), 9) >= threshold))

        return docs.mapInArrow(run, docs.schema)
