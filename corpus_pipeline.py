"""From crawled documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
that they were given, whatever their names. Every stage's defined results for null ids, null and empty texts, repeated rows
and empty tables are those of its operator, and stated below where the stage decides more.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chapterloom.llm import decontam, jaccard, langid, packing, quality
from chapterloom.llm.frames import SWEPT, column, ready, session_settings, stored
from chapterloom.llm.queries import grades, learning, table

#: A document stays if this share of its letters is of one language, and if good quality is at least this likely.
LANGUAGE_SHARE = 0.5
QUALITY_CHANCE = 0.5
#: Near duplicates: words a shingle, similarity in hundredths.
SHINGLE, SIMILAR = 5, 80
TOKENIZER = "byte_bpe_50k.json"


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns under names of no meaning beside ``text``, so that no name can clash with a result's."""
    held = [f"__{i}" for i in range(len(docs.columns))]
    return docs.select(*[column(docs, c).alias(h) for c, h in zip(docs.columns, held, strict=True)], column(docs, "text")), held


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts without a main language.

    Where no document has a language to learn from, all are rejected.
    """
    ready(spark)
    model = langid.fit(learning(docs), column(docs, "lang"))
    aside, held = _aside(docs)
    found = langid.identify(aside, model, held)
    return _back(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE)), docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose grade is more likely the lowest; learned from ``labels``."""
    ready(spark)
    with session_settings(spark, SWEPT):
        model = quality.fit(docs, grades(spark, sf_dir))
    aside, held = _aside(docs)
    return _back(quality.grade(aside, model, held, above=0).where(F.col("tail") >= QUALITY_CHANCE), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies.

    Of rows equal in doc_id and text one stays; rows with a null doc_id stay; rows of one doc_id with different
    texts go if one of them belongs to a group with a smaller id.
    """
    ready(spark)
    with session_settings(spark, SWEPT):
        groups = jaccard.similar_sets(docs, SHINGLE, SIMILAR, 100)
        copies = stored(groups.where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(copies, "doc_id", "left_anti")
    repeated = stored(
        docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids"
    )
    single = kept.join(repeated, "doc_id", "left_anti")
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    ready(spark)
    with session_settings(spark, SWEPT):
        found, _ = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
        hits = stored(
            found.where("n_hit > 0").select(F.col("doc_id").alias("__hit"), F.col("text_key").alias("__key")).distinct(), "leaks"
        )
    same = column(docs, "doc_id").eqNullSafe(F.col("__hit")) & F.xxhash64(column(docs, "text")).eqNullSafe(F.col("__key"))
    return docs.join(hits, same, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids, see ``packing.PIECES``."""
    ready(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), known=400_000, last=True)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", packed),
]

#: The models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
