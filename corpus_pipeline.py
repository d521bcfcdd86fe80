"""A training corpus from raw documents: quality, near-duplicates, benchmark leaks, source mix, token shards.

Each stage takes the documents that its predecessor kept and returns documents; the last returns the index of the
shards it wrote (doc_id, start, n_tokens, ids_crc32). Between stages the documents are a Parquet table in the shared
folder.

Defined cases, for every stage: null texts read as empty ones; null identifiers, sources and languages are values like
any other; repeated rows are judged alike (near-duplicates keeps one); empty tables give empty tables; columns beyond
those of `documents` are left behind, whatever their names, and a missing one of lang, source or n_chars is null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm import decontaminate, mixing, ranking, simhash, sstable
from marlspike.llm.queries import tokenizer_path
from marlspike.session import discard, left_over, materialize, remove, table

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clearing(stage: Stage) -> Stage:
    """`stage`, which first deletes the working tables of the stage called before it.

    A stage's result is written before the next stage starts, so nothing reads them any more; tables that `docs` itself
    is read from stay.
    """

    @wraps(stage)
    def cleared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sc = spark.sparkContext
        if spent := getattr(sc, "_pipeline_spent", []):
            read = docs.inputFiles()
            remove(spark, [p for p in spent if not any(p.rpartition("/")[2] in f for f in read)])
        before = {*left_over(spark)}
        out = stage(spark, docs, sf_dir)
        sc._pipeline_spent = [p for p in left_over(spark) if p not in before]
        return out

    return cleared


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns of `documents`, a missing one null."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


@clearing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts. It learns from every labelled document, read from the table."""
    model = ranking.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return ranking.keep_good(columns_of(docs), model)


@clearing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more."""
    return simhash.deduplicate(columns_of(docs))


@clearing
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(columns_of(docs), table(spark, sf_dir, "benchmark"))


@clearing
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document is there once for each time it is taken."""
    return mixing.mixed(columns_of(docs))


@clearing
def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token shards, read back from them."""
    return sstable.write_and_index(spark, docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources", source_mix),
    ("token shards", token_shards),
]

#: A trained model, fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the token shards of all documents that the stages keep. A table between stages goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
