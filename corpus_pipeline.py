"""From raw documents to mixed shards in five stages, each one operator of folio.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. Null and empty texts
pass through: they are not toxic, copy nothing, hold no benchmark words and have the prior as domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from folio.runtime import drop_stash, stash, table

#: The token shares that the mixing stage aims at, of the two qualities; it repeats documents, and drops none.
WEIGHTS = {"high": 0.9, "low": 0.1}
#: Ids up to which the ids to drop are broadcast (a few dozen bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7."""
    scored = toxicity.score(docs, toxicity.learned(spark, sf_dir))
    return scored.where(F.col("toxicity") < 0.7).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more join, the one of the least id, null ids first.

    A row is known by its id and its text, so ids may repeat. Of rows that agree in both the one that sorts first
    by all its columns stays; null and empty texts all stay.
    """
    t = F.coalesce("text", F.lit(""))
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), (t != "").alias("worded"))
    classes = jaccard_join.similar(docs.select(key.alias("key"), "text"), row_id="key")
    gone = stash(classes.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("key")).distinct(), "copies")
    kept = keyed.join(_near(gone), "key", "left_anti")
    again = stash(keyed.where("worded").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    if not again.isEmpty():
        repeated = kept.join(_near(again), "key", "left_semi").where("worded")
        single = kept.join(_near(again.withColumn("repeats", F.lit(True))), "key", "left").where("not worded or repeats is null")
        kept = single.select("row").unionByName(repeated.groupBy("key").agg(F.min("row").alias("row")).select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _near(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate, at least once, says."""
    model = mixing.fit(docs, mixing.quality_domains(table(spark, sf_dir, "labels")))
    return mixing.repeat(mixing.mix(docs, model, WEIGHTS, least=1.0), docs.columns)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", to_shards),
]

#: SQL can't express the learned stages and the random paths; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage{k}-{name}")
            drop_stash(before)
    return docs
