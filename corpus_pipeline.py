"""A training corpus from documents: quality classifier, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes each
stage's rows to the shared folder and rereads them for the next one.

Odd rows, in every stage: a null text counts as empty. An empty text has the quality model's bias as its score, is near to nothing, holds no benchmark item, is kept once by
the mixing and lies in a shard. Texts are read whole, however long. Repeated rows share their fate up to near_duplicates, which keeps one row of each id; rows without an id stay there,
and further on they are treated alike. An empty table, of documents or of labels or of benchmark items, gives what the other tables leave: without labels every score is 0.5 and all
stays, without items nothing goes, and posteriors are uniform. Extra columns are carried along whatever their names; only the last stage replaces columns named shard, slot and grown_shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrail.llm.decontaminate import Decontaminate
from kinetrail.llm.jaccard_join import JaccardJoin
from kinetrail.llm.mixing import Mixer
from kinetrail.llm.quality_classifier import QualityClassifier
from kinetrail.llm.queries import TARGETS, domains, table
from kinetrail.llm.sharding import Sharding
from kinetrail.llm.store import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Ties at the threshold stay."""
    return QualityClassifier().fit(docs, table(spark, sf_dir, "labels")).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the smallest id stays; of rows that share an id, one. Empty texts are linked with nothing."""
    return JaccardJoin().first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty items match nothing."""
    return Decontaminate().clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of domains below their target share are repeated; none goes (rates are at least 1)."""
    mixer = Mixer(TARGETS, grow=True, least=1.0).fit(docs, domains(docs, table(spark, sf_dir, "labels")))
    return mixer.mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs with shard, slot and grown_shard; slots are gapless in a shard, copies of a document share their shard."""
    return Sharding(shards=24).shuffled(docs)


STAGES = [("quality_classifier", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: No stage but the last two could be told in SQL: the models are trained here and the shards follow xxhash64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
