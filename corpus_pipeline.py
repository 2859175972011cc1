"""A training corpus from raw documents, stage by stage.

Each stage is written as Parquet and read again as the next one's input.  All
but the last return the columns of documents, of whatever names; every stage
takes null and empty texts, null and repeated ids and an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwise.llm import _store, decontam, mixing, neardup, quality, token_files

#: A document stays if its probability of good quality is at least this.
LEAST_QUALITY = 0.3


def _of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of `docs` whose columns named as those of the written `keys` are
    among them (left_semi) or not (left_anti); nulls are equal."""
    keys = _store.small(keys)
    return docs.join(keys, [docs[k].eqNullSafe(keys[k]) for k in keys.columns], how)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; null and empty texts
    are judged like others."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(model)("text") >= LEAST_QUALITY)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five-word
    shingles, similarity 0.8), and of the rows of one doc_id the first by text.
    Documents without a word or an id are copies of nothing and stay."""
    with _store.temporary(spark):
        found, _ = _store.written(neardup.near_duplicates(docs.select("doc_id", "text")), "copies")
        gone, _ = _store.written(found.where("not kept").select("doc_id").distinct(), "gone", keep=True)
        again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
        again, _ = _store.written(again, "again", keep=True)
    kept = _of(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    by = Window.partitionBy("row.doc_id").orderBy(F.col("row.text").asc_nulls_last(), F.to_json("row"))
    first = _of(kept, again, "left_semi").select(F.struct("*").alias("row")).withColumn("n", F.row_number().over(by)).where("n = 1")
    return _of(kept, again, "left_anti").union(first.select("row.*"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lie in
    benchmark passages; of rows that repeat an id those with such a text."""
    with _store.temporary(spark):
        found = decontam.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        gone, _ = _store.written(found.where("contaminated").select("doc_id", "text_hash").distinct(), "gone", keep=True)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    return _of(rows, gone, "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source weights, a partition and file for each shard; a
    document that is drawn more than once appears as often."""
    return mixing.mix(docs, into=None)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, of the shards as they lie and in their
    shuffled order, read back: ids and offsets."""
    path = _store.new_path(spark, "corpus-tokens", keep=True)
    token_files.write_tokens(docs, path, token_files.vocabulary(), by_id=False)
    return token_files.read_tokens(spark, path)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", keep_one_of_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("source mixing", mix_sources),
    ("token files", to_token_files),
]

#: The classifier and the tokenizer cannot be said in SQL; tests/llm/test_pipeline.py
#: holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs, path = _store.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        _store.drop(spark, *before)
        before = [path]
    return docs
