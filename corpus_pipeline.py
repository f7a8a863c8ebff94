"""The corpus pipeline: five stages over ``documents``, each a function of (spark, docs, sf_dir).

Each stage returns what it keeps, with the columns of ``documents``; the last one, which mixes, adds the
copy columns of the mixture. ``run`` writes each stage as Parquet in the shared folder and reads it back.

Edge cases of all stages: a row with a null id is told by a hash of its text, so that decisions take effect on
it as well; rows of one id are judged together: where one of them goes, all go; null and empty texts are kept by
every stage that takes rows away; an empty table stays empty; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.llm.common import unused, work_path
from cohorta.llm.decontaminate import contaminated
from cohorta.llm.minhash import near_duplicates
from cohorta.llm.mixing import mix
from cohorta.llm.pii import pseudonymize
from cohorta.llm.quality import quality
from cohorta.llm.queries import WEIGHTS, pseudonym_key, table


def _ids(docs: DataFrame) -> Column:
    """The id of a row; where it is null, a number beyond those of ids, from a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))


def _named(docs: DataFrame) -> DataFrame:
    """What operators need of ``docs``, without null ids."""
    return docs.select(_ids(docs).alias("doc_id"), "text", "lang")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in ``gone``."""
    own = unused(docs, "own_id")
    return docs.withColumn(own, _ids(docs)).join(gone.select(F.col("doc_id").alias(own)).distinct(), own, "left_anti").select([f"`{c}`" for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _without(docs, quality(_named(docs), trusted).where(~F.col("kept")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document with the smallest id stays; of rows with one id and text, one."""
    kept = _without(docs, near_duplicates(_named(docs)).where("component_id != doc_id"))
    own, said = unused(docs, "own_id"), unused(docs, "said")
    if docs.where("text != ''").groupBy(_ids(docs)).count().where("count > 1").isEmpty():
        return kept
    told = kept.withColumns({own: _ids(kept), said: F.when(F.col("text") != "", F.xxhash64("text"))})
    some = told.where(F.col(said).isNotNull()).dropDuplicates([own, said])
    return some.unionByName(told.where(F.col(said).isNull())).drop(own, said)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, contaminated(_named(docs), table(spark, sf_dir, "benchmark")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms; ``n_chars`` follows the new text."""
    said = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return pseudonymize(docs, pseudonym_key(spark), count_col=None).withColumn("n_chars", said)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to the target shares and shuffled."""
    return mix(docs, WEIGHTS)


STAGES = [("quality", quality_stage), ("dedup", dedup_stage), ("decontaminate", decontamination_stage), ("pii", pii_stage), ("mix", mixing_stage)]

#: The quality model and the sketches cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
