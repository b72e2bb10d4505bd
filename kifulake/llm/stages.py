"""The stages of the document pipeline: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``docs`` as they are, whatever else these are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from . import decontaminate, language, mixing, sharding, simhash
from .common import free_name, row_hash, stash, table

MIX_SEED = 7
SHARD_SEED = 11
SHARDS = 40


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts, texts without a letter and texts that score
    below ``language.least_score`` go."""
    ship_package(spark)
    labelled = docs.select("doc_id", "text", "lang")
    net = language.fit(labelled)
    return language.keep_identified(docs, net, min_score=language.least_score(labelled, net))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of smallest doc_id (null last); a row of it is
    kept once even if the input repeats it."""
    ship_package(spark)
    stay = stash(simhash.representatives(docs), "representatives")
    stay = stay.select(F.col("doc_id").alias("_stay_doc"), F.col("text_hash").alias("_stay_hash"), F.col("rows").alias("_stay_rows"))
    code = free_name(docs, "_text_hash")
    rows = docs.withColumn(code, F.xxhash64(F.col("text").cast("string")))
    names = {c: free_name(docs, c) for c in stay.columns}
    stay = stay.withColumnsRenamed(names)
    on = F.col("doc_id").eqNullSafe(F.col(names["_stay_doc"])) & (F.col(code) == F.col(names["_stay_hash"]))
    joined = rows.join(stay, on)
    once = joined.where(F.col(names["_stay_rows"]) == 1).select(*_columns(docs))
    if stay.where(F.col(names["_stay_rows"]) > 1).isEmpty():
        return once
    nth = free_name(joined, "_nth")
    first = Window.partitionBy("doc_id", code).orderBy(row_hash(docs))
    many = joined.where(F.col(names["_stay_rows"]) > 1).withColumn(nth, F.row_number().over(first))
    return once.union(many.where(F.col(nth) == 1).select(*_columns(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    ship_package(spark)
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    gone = stash(found.select("doc_id", "text_hash").distinct(), "contaminated")
    code, id_, hash_ = (free_name(docs, x) for x in ("_text_hash", "_gone_doc", "_gone_hash"))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    rows = docs.withColumn(code, F.xxhash64(F.col("text").cast("string")))
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(code) == F.col(hash_))
    return rows.join(gone, on, "left_anti").select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it."""
    copies = free_name(docs, "_times_copies")
    mixed = mixing.mix(docs, MIX_SEED, prefix=copies.removesuffix("copies"))
    many = F.explode(F.array_repeat(F.lit(1), F.col(copies)))
    return mixed.where(F.col(copies) > 0).select(*_columns(docs), many.alias(free_name(docs, "_copy"))).select(*_columns(docs))


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ``shard`` and ``slot`` (input columns of those names are replaced)."""
    return sharding.shard(docs, SHARDS, SHARD_SEED)
